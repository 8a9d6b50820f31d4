"""Post analytics on Spark: short texts in, labelled rows and aggregates out."""
