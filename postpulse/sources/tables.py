"""Tables by file extension, and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _format(path: str) -> str:
    lowered = path.rstrip("/").lower()
    for extension in ("parquet", "csv"):
        if lowered.endswith("." + extension):
            return extension
    raise ValueError(f"unsupported file format: {path}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``.parquet`` or ``.csv`` (any case) from any file system Spark knows.

    CSV follows the usual quoting (doubled quotes, newlines inside quotes).  Without
    a schema every CSV column is a string: types are decided where a column is used,
    not by a second scan.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if _format(path) == "parquet":
        return reader.parquet(path)
    return reader.csv(path, header=True, multiLine=True, quote='"', escape='"')


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested types: arrays and structs are written as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_table(df: DataFrame, path: str) -> str:
    """Overwrite ``path`` in the format of its extension (a folder of part files)."""
    if _format(path) == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        export_csv(df, path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    _flat(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")
    return path
