"""Versioned tables of files: a commit log, whole versions or nothing, old versions stay.

A table is a folder with ``data/<id>`` (rows of one commit) and ``_log/<number>.json``
(its manifest).  A commit writes the rows that differ from the newest ones, reads them
back and compares, then moves its manifest to the next number, which fails if another
writer has it: then the rows are compared with that writer's and written again.  Rows
without a manifest were never committed and nobody reads them.  The move is atomic where the
file system's rename without overwriting is (as on HDFS).

Rows have a key; their content is everything but ``volatile`` columns, so a file that
differs only there is no new version.  Every ``SNAPSHOT``-th commit holds all rows, so a
reader opens a bounded number of commits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = 20
TRIES = 10
_OWN = ("_hash", "_gone", "_version")


class Commit(NamedTuple):
    number: int
    data: str
    rows: int
    hashes: str
    whole: bool


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The manifests in their order."""
    where, fs = _fs(spark, f"{path}/_log")
    if not fs.exists(where):
        return []
    out = []
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if name.endswith(".json") and not name.startswith((".", "_")):
            stream = fs.open(s.getPath())
            out.append(Commit(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
            stream.close()
    return sorted(out)


def _publish(spark: SparkSession, path: str, commit: Commit) -> bool:
    """Whether the manifest got its number."""
    jvm = spark._jvm
    draft, fs = _fs(spark, f"{path}/_log/.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(commit._asdict()).encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_log/{commit.number:012d}.json")
    never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, never_over)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)


def _digest(spark: SparkSession, path: str) -> tuple[int, str]:
    r = spark.read.schema("_hash string, _gone boolean").parquet(path).agg(F.count("*"), F.sum(F.xxhash64("_hash", "_gone").cast("decimal(38,0)"))).first()
    return r[0], str(r[1] or 0)


def _content(df: DataFrame, keys: Collection[str], volatile: Collection[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in volatile and c not in _OWN]
    return df.withColumn("_hash", F.sha2(F.to_json(F.struct(*sorted(rest))), 256) if rest else F.lit(""))


def _newest(spark: SparkSession, path: str, keys: Collection[str], log: list[Commit]) -> DataFrame | None:
    """The newest row of each key, deleted ones too."""
    since = max((i for i, c in enumerate(log) if c.whole), default=0)
    if not log[since:]:
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/data/{c.data}" for c in log[since:]])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "_version").alias("_r"))
    return last.select(*keys, "_r.*")


def current(spark: SparkSession, path: str, keys: Collection[str] = ("doc_id",), version: int | None = None) -> DataFrame | None:
    """The table as of a version (the newest by default) with ``_version``, the commit that each row came with; nothing where nothing is committed."""
    log = [c for c in commits(spark, path) if version is None or c.number <= version]
    rows = _newest(spark, path, keys, log)
    return None if rows is None else rows.where(~F.col("_gone")).drop("_hash", "_gone")


def commit(rows: DataFrame, path: str, keys: Collection[str] = ("doc_id",), volatile: Collection[str] = (), replace: bool = False, before_publish: Callable[[], None] | None = None) -> int | None:
    """Commits the rows that are new or differ and, with ``replace``, that keys are gone which ``rows`` lacks; the commit's number, or nothing if nothing changed.

    ``before_publish`` is called between writing and publishing (tests put another writer there).
    """
    spark, keys = rows.sparkSession, list(keys)
    fresh = _content(rows, keys, volatile).withColumn("_gone", F.lit(False))
    for _ in range(TRIES):
        log = commits(spark, path)
        number, old = (log[-1].number if log else 0) + 1, _newest(spark, path, keys, log)
        changed = fresh
        if old is not None:
            same = _content(old.where(~F.col("_gone")), keys, volatile).select(*keys, "_hash")
            changed = fresh.join(same, [*keys, "_hash"], "left_anti")
            if replace:
                gone = old.where(~F.col("_gone")).join(fresh.select(*keys), keys, "left_anti").withColumn("_gone", F.lit(True)).drop("_version")
                changed = changed.unionByName(gone, allowMissingColumns=True)
        whole = number % SNAPSHOT == 0 and old is not None
        data = uuid.uuid4().hex
        made = changed.withColumn("_version", F.lit(number))
        if whole:
            kept = old.join(changed.select(*keys), keys, "left_anti")
            made = made.unionByName(kept, allowMissingColumns=True)
        made.write.parquet(f"{path}/data/{data}")
        back = spark.read.schema(made.schema).parquet(f"{path}/data/{data}")
        n_new = back.where(F.col("_version") == number).count()
        if n_new:
            if back.groupBy(*keys).count().where("count > 1").limit(1).count():
                _drop(spark, f"{path}/data/{data}")
                raise ValueError("a key has several rows")
            n, hashes = _digest(spark, f"{path}/data/{data}")
            if before_publish:
                before_publish()
            if (n, hashes) == _digest(spark, f"{path}/data/{data}") and _publish(spark, path, Commit(number, data, n, hashes, whole)):
                return number
        _drop(spark, f"{path}/data/{data}")
        if not n_new:
            return None
    raise RuntimeError(f"other writers were faster {TRIES} times")


def _drop(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def verify(spark: SparkSession, path: str) -> list[int]:
    """Numbers of commits whose rows aren't what their manifests say."""
    bad = []
    for c in commits(spark, path):
        where, fs = _fs(spark, f"{path}/data/{c.data}")
        if not fs.exists(where) or _digest(spark, f"{path}/data/{c.data}") != (c.rows, c.hashes):
            bad.append(c.number)
    return bad
