"""Answers of models by content: a text is sent once, whatever row, run or table it stands in.

A store is a Parquet folder of ``(model=, key, answer)``, where the key is the SHA-256 of the text.
The distinct texts of a frame are anti-joined with what the store has of that model; only the rest
is sent, and what succeeds is appended.  Failures are not stored, so the next run asks again.
Another model id is another partition: it asks for everything anew.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.functions.text import text_or_empty
from postpulse.operators.joins import spread_join
from postpulse.session import materialize
from postpulse.sources.staged import exists


def stored_answers(df: DataFrame, store: str, model: str, kind: T.DataType) -> DataFrame:
    """``(key, answer)`` of a model, one row a key (two runs at once may both have asked)."""
    spark, path = df.sparkSession, f"{store}/model={quote(model, safe='')}"
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("answer", kind)])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).dropDuplicates(["key"])


def with_answers(
    df: DataFrame,
    column: str,
    name: str,
    *,
    store: str,
    model: str,
    kind: T.DataType,
    ask: Callable[[Column], Column],
    failed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``df`` with the model's answer to ``column`` (null counts as empty) as ``name``.

    ``ask`` gives the answer of type ``kind`` to a text column, ``failed`` tells whether an answer
    is a failure.  A text that a large share of the rows have meets its answer in several tasks.
    """
    keyed = df.withColumn("_key", F.sha2(text_or_empty(F.col(column)), 256))
    known = materialize(stored_answers(df, store, model, kind), "answers-known")
    texts = keyed.select("_key", text_or_empty(F.col(column)).alias("_text")).groupBy("_key").agg(F.first("_text").alias("_text"))
    unknown = texts.join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
    # Written before it is used: a model is never asked twice because a task is repeated later.
    new = materialize(unknown.select(F.col("_key").alias("key"), ask(F.col("_text")).alias("answer")), "answers-new")
    good = new.filter(~failed(F.col("answer"))) if failed else new
    good.write.mode("append").parquet(f"{store}/model={quote(model, safe='')}")
    every = known.unionByName(new).select(F.col("key").alias("_key"), F.col("answer").alias(name))
    return spread_join(keyed, every, ["_key"], "left", spread_by=[c for c in df.columns if c != column][:4] or [column]).select(*df.columns, name)
