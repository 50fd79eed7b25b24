"""Runs of numbered stages that reuse what an earlier run has written.

A stage is a function of the table before it; each is written as ``S<n>_<key>`` in the
run's folder and read back.  A run reuses a stage's table if the table is complete, no
stage before it ran anew, the run isn't forced from that stage or an earlier one, and source and
version are those that the table was made from: the folder notes the source's fingerprint
and each stage's version.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stage(NamedTuple):
    """``run(table) -> table``; ``option`` names the choice that leaves the stage out, ``version`` what the function is: another one makes the table anew."""

    number: int
    key: str
    run: Callable[[DataFrame], DataFrame]
    option: str | None = None
    version: str = ""


def _path(folder: str, stage: Stage) -> str:
    return f"{folder}/S{stage.number}_{stage.key}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def has_stage(spark: SparkSession, folder: str, stage: Stage, force_from: int | None = None) -> bool:
    """Whether a complete table is there that may be used again; a write that broke off leaves no ``_SUCCESS``."""
    return (force_from is None or stage.number < force_from) and _exists(spark, f"{_path(folder, stage)}/_SUCCESS")


def fingerprint(table: DataFrame) -> str:
    """Count and sum of the rows' hashes: alike for the same rows in any order."""
    r = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h'] or 0}"


def changed_since(spark: SparkSession, folder: str, name: str, table: DataFrame) -> bool:
    """Whether a table that stages depend on differs from the run before; notes what it is now."""
    path, now = f"{folder}/{name}.fingerprint", fingerprint(table)
    before = spark.read.schema("value string").parquet(path).first() if _exists(spark, f"{path}/_SUCCESS") else None
    if before is None or before["value"] != now:
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").parquet(path)
    return before is not None and before["value"] != now


def _noted(spark: SparkSession, path: str, value: str) -> bool:
    """Whether a note with this value is there; notes it otherwise."""
    if _exists(spark, f"{path}/_SUCCESS") and spark.read.schema("value string").parquet(path).first()["value"] == value:
        return True
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").parquet(path)
    return False


def run(source: DataFrame, stages: Sequence[Stage], folder: str, force_from: int | None = None, skip: Collection[str] = ()) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """The last stage's table, and (number, key, what was done: skipped, reused, run) of each."""
    spark, table, log = source.sparkSession, source, []
    if not _noted(spark, f"{folder}/source.fingerprint", fingerprint(source)):
        force_from = min([s.number for s in stages], default=None)
    for stage in sorted(stages, key=lambda s: s.number):
        if stage.option in skip:
            log.append((stage.number, stage.key, "skipped"))
            force_from = stage.number if force_from is None and _exists(spark, _path(folder, stage)) else force_from  # later tables may rest on it
            continue
        if not _noted(spark, f"{_path(folder, stage)}.version", stage.version):
            force_from = stage.number if force_from is None else min(force_from, stage.number)
        if has_stage(spark, folder, stage, force_from):
            log.append((stage.number, stage.key, "reused"))
        else:
            stage.run(table).write.mode("overwrite").parquet(_path(folder, stage))
            force_from = stage.number if force_from is None else min(force_from, stage.number)
            log.append((stage.number, stage.key, "run"))
        table = spark.read.parquet(_path(folder, stage))
    return table, log
