"""A training corpus from ``documents``: quality, exact copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir), reads all that the stage before kept and returns the
columns of ``documents``; the last returns ids and decoded text.  Between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse.llm.bpe import encode_and_decode
from postpulse.llm.exact_dedup import drop_copies
from postpulse.llm.ngram_join import jaccard_classes
from postpulse.llm.quality import judge_quality, train
from postpulse.llm.queries import TOKENIZERS
from postpulse.llm.source_mix import mix, word_count
from postpulse.session import materialize, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier.  A null text has no words: it goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, names = judge_quality(docs, train(docs, labels))
    return judged.where(F.col(names[-1])).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, and of its rows one."""
    return drop_copies(docs, one_row=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 80 % of their five-word shingles, the one with the smallest id.
    Documents without words or without an id are linked with nothing and stay."""
    classes = jaccard_classes(docs)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number: texts stay whole.
    (Part of a text is taken only at the two ends of a shard's run.)"""
    key = ["_id", "_source", "_size"]
    alike = Window.partitionBy(*key)
    times = materialize(mix(docs).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.coalesce(F.round(F.try_divide("taken", "size")), F.lit(0)).cast("int").alias("_times"),
    ).withColumns({
        "_n": F.count(F.lit(1)).over(alike), "_number": F.row_number().over(alike.orderBy(F.desc("_times"))),
    }).where("_times > 0"), "mix-times")
    sized = docs.withColumns({"_i": F.col("doc_id"), "_s": F.col("source").cast("string"), "_w": word_count(F.col("text"))})
    same = F.expr("_i <=> _id and _s <=> _source and _w = _size")
    copies = sized.join(times.where("_n = 1"), same).select(*docs.columns, "_times")
    repeated = times.where("_n > 1")
    if not repeated.isEmpty():  # rows alike in id, source and size: each has its own count
        order = Window.partitionBy("_i", "_s", "_w").orderBy(F.sha2("text", 256))
        numbered = sized.join(repeated.select(*key).distinct(), same, "left_semi").withColumn("_row", F.row_number().over(order))
        own = numbered.join(repeated, same & F.expr("_row = _number")).select(*docs.columns, "_times")
        copies = copies.unionByName(own)
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian unsigned 32-bit integers), n_tokens, decoded."""
    coded, (ids, decoded) = encode_and_decode(
        docs.select("doc_id", "source", "text"), f"{TOKENIZERS}/byte_bpe_50k.json"
    )
    return coded.select(
        "doc_id", "source", F.expr(f"octet_length({ids}) div 4").cast("bigint").alias("n_tokens"),
        F.col(ids).alias("ids"), F.col(decoded).alias("decoded"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("BPE encoding", bpe_encoding),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
