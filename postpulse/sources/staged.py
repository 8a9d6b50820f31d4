"""Rewrites of several tables that readers see all at once or not at all.

A run writes every table into a folder of its own below ``_staged``.  Nothing refers to that folder
until the run *commits*: one small manifest, created under the next free number, says where each
table is now.  Readers and later writers ask ``table_path``, which follows the newest whole
manifest; a crash before the commit leaves the old tables, a crash after it the new ones.  (Spark
and Hive take no notice of names that begin with an underscore.)

Folders of the generation before stay for readers that have begun; older ones go at the next
commit.  A folder that was never staged, where a table began, is left to its owner.  Rows that
somebody else writes to a table while it is being rewritten are not in the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, STAGED = "_manifests", "_staged"


def files_at(spark: SparkSession, path: str):
    """(Hadoop path, its file system): the same stores that Spark itself can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = files_at(spark, path)
    return files.exists(place)


def _read(spark: SparkSession, path) -> dict[str, str] | None:
    """A manifest; None for one whose writer was stopped half-way."""
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def manifests(spark: SparkSession, root: str) -> list[tuple[int, dict[str, str] | None]]:
    folder, files = files_at(spark, f"{root}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json")]
    return sorted((int(p.getName().partition(".")[0]), _read(spark, p)) for p in found)


def current(spark: SparkSession, root: str) -> dict[str, str]:
    whole = [m for _, m in manifests(spark, root) if m is not None]
    return whole[-1] if whole else {}


def table_path(spark: SparkSession, root: str, table: str) -> str:
    """Where ``table`` (a path below ``root``) is now."""
    return f"{root}/{current(spark, root).get(table, table)}"


def commit(spark: SparkSession, root: str, moved: dict[str, str]) -> int:
    """Point readers to the folders of ``moved``; tables it does not name stay where they are.
    Of two writers that take the same number one fails and changes nothing."""
    known = manifests(spark, root)
    number = known[-1][0] + 1 if known else 0
    place, files = files_at(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    stream = files.create(place, False)
    try:
        stream.write(bytearray(json.dumps({**current(spark, root), **moved}, sort_keys=True).encode()))
    finally:
        stream.close()
    whole = [m for _, m in manifests(spark, root) if m is not None]
    kept = {folder for m in whole[-2:] for folder in m.values()}
    for folder in {f for m in whole[:-2] for f in m.values()} - kept:
        if folder.startswith(f"{STAGED}/"):
            place, files = files_at(spark, f"{root}/{folder}")
            files.delete(place, True)
    return number


def rewrite(
    spark: SparkSession,
    root: str,
    tables: dict[str, tuple[DataFrame, Callable[[DataFrame, str], object]]],
    *,
    run: str | None = None,
    notes: dict[str, str] | None = None,
) -> dict[str, str]:
    """Stage each table's new rows with its own writer ``(rows, folder)``, then commit them together;
    ``notes`` are further entries of the manifest."""
    run = run or uuid.uuid4().hex
    moved = {table: f"{STAGED}/{run}/{table}" for table in tables}
    for table, (rows, write) in tables.items():
        write(rows, f"{root}/{moved[table]}")
    if moved:
        commit(spark, root, {**moved, **(notes or {})})
    return moved
