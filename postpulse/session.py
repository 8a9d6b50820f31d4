"""Session defaults and the shared work folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "postpulse", **settings: str) -> SparkSession:
    """A session with the settings every rule here assumes (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """What every query relies on: UTC timestamps, and this package on the executors
    (needed by the few steps that run Python)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if not any(name.endswith("/postpulse.zip") for name in context.listFiles):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='postpulse-')}/postpulse", "zip", package.parent, package.name
        )
        context.addPyFile(archive)  # Spark copies it to every executor
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only when the session names none (local tests) a temporary one is chosen.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postpulse-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody else writes to, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Session setting: shuffle files go when the execution that wrote them ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """For writes, which are executed once: else shuffle files stay until the driver collects its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a written table: survives the loss of executors."""
    return store(df, new_folder(df.sparkSession, name))


def store(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a new folder and read from it."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
