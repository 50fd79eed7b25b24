"""What the training-data operators share: shipping, scratch tables and byte-level text arrays.

Texts are handled in Arrow batches as UTF-8 bytes.  ``TextBlock`` concatenates a
bounded number of documents, so that numpy passes over some megabytes at a time
whatever the length of one document.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.session import ship  # noqa: F401

BLOCK_BYTES = 4 << 20
#: Words are maximal runs of other bytes than these; ``bytes.split()`` uses the same set.
SPACES = b" \t\n\x0b\x0c\r"

def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.environ.get("SUBTIDE_SCRATCH") or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/subtide-{uuid.uuid4().hex}"


def scratch_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its folder there."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    return scratch_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_at`` wrote and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(docs: DataFrame, name: str = "numbered") -> DataFrame:
    """``row`` and ``doc`` (a struct of all columns), written once: rows numbered by a scan keep their numbers only there.

    Another scan of the same files can be split in another way, when executors come or go.
    """
    return scratch(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), name)


def summed(df: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Aggregates by ``keys`` that are to be joined back to many rows of a key.

    They are dealt by one column more, so the join has exchanges of its own on both
    sides, where adaptive execution can split a hot key's rows over tasks.
    """
    return df.groupBy(*keys, F.xxhash64(*keys).alias("dealt_by")).agg(*sums).drop("dealt_by")


def by_group(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """``f(key, table)`` for each group.  (Spark reads type hints of functions; a bare lambda has none to misread.)"""
    return df.groupBy(*keys).applyInArrow(lambda key, table: f(key, table), schema)


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` (and ``extra``), so other columns can have any name."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def blocks(rows: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows with about ``limit`` bytes each (one row at least)."""
    start = size = 0
    for i, x in enumerate(rows):
        if i > start and size + len(x) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(x)
    if start < len(rows):
        yield slice(start, len(rows))


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _pow[key] = a
    return _pow["p"][:n], _pow["q"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


class TextBlock:
    """Documents joined by line feeds, with the words of all of them as hashes.

    ``data`` bytes, ``start``/``stop`` of each document in it; ``w0``/``w1`` bounds and
    ``word`` the 64-bit hash of each word; ``first`` the index of each document's first
    word, with the number of words at its end.
    """

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.start = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if rows else np.zeros(0, np.int64)
        self.stop = self.start + size
        self.size = size
        self.data = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
        self.space = _SPACE[self.data]
        edge = np.flatnonzero(self.space != np.concatenate(([True], self.space[:-1])))
        self.w0, self.w1 = edge[0::2], edge[1::2]
        p, q = _powers(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.add(self.data, np.uint64(1), out=total[1:])
        total[1:] *= p
        np.cumsum(total[1:], out=total[1:])
        self.word = mix64((total[self.w1] - total[self.w0]) * q[self.w0])
        self.first = np.concatenate((np.searchsorted(self.w0, self.start), [len(self.w0)]))
        self.n_words = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(rows)), self.n_words)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of ``mask`` in each document."""
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[self.stop] - c[self.start]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``n`` words that lies in one document."""
        if len(self.word) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = len(self.word) - n + 1
        h = self.word[:last].copy()
        for k in range(1, n):
            h = h * _P + self.word[k : k + last]
        at = np.flatnonzero(self.owner[:last] == self.owner[n - 1 :])
        return at, mix64(h[at])

    def repeat_words(self) -> np.ndarray:
        """Words that lie in a window of three words found twice or more in their document."""
        at, h = self.windows(3)
        h = h ^ mix64(self.owner[at].astype(np.uint64) + _P)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(self.word) + 3, np.int8)
        for k in range(3):
            hit[at[twice] + k] = 1
        c = np.concatenate(([0], np.cumsum(hit[: len(self.word)], dtype=np.int64)))
        return c[self.first[1:]] - c[self.first[:-1]]

    def dup_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those among them that equal an earlier line of the document."""
        n = np.zeros((2, len(self.rows)), np.int64)
        for i, x in enumerate(self.rows):
            lines = [y for y in x.split(b"\n") if y and not y.isspace()]
            n[:, i] = len(lines), len(lines) - len(set(lines))
        return n[0], n[1]
