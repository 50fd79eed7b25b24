"""Many names against many texts, without comparing each name with each text.

A name is known by an anchor: eight of its bytes that the fewest other names have (all
bytes of a shorter name).  A pass over the texts slides over all their bytes at once,
sends the few that can be an anchor through a small table of hashes, finds the names of
an anchor by binary search, and compares first eight, last eight and then all bytes of
the name.  So a text costs the same with ten names and with a million.

The texts are never shuffled.  The names' anchors go to all tasks in blocks of at most
``BLOCK_BYTES`` of names, which bounds the broadcast whatever the table's size; a larger
table takes as many passes over the texts as it has blocks.  What comes back is combined
by name in each task first.

Names are compared as UTF-8 bytes, which is the same as by characters.  Null and empty
names occur nowhere, null texts have no names; repeated names count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.session import ship

BLOCK_BYTES = 8 << 20
TEXT_BYTES = 4 << 20
GRAM = 8
COMPARE = 8 << 20  # bytes that are compared at a time


def _words(data: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` bytes from each place on as one number (zeros beyond the end)."""
    padded = np.concatenate((data, np.zeros(k, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(k):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def _slots(words: np.ndarray, bits: int) -> np.ndarray:
    return ((words ^ (words >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Patterns:
    """One block of distinct names, found by their anchors."""

    def __init__(self, names: list[bytes]) -> None:
        self.names = names
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        word = _words(self.flat, GRAM)
        last = self.start[1:] - GRAM
        self.head, self.tail = word[np.minimum(self.start[:-1], max(len(word) - 1, 0))], word[np.maximum(last, 0)]
        self.kinds = []  # for each length of anchor: hash table, anchors, first entry of each, names and places
        for k in range(1, GRAM + 1):
            some = np.flatnonzero(self.size >= GRAM if k == GRAM else self.size == k)
            if not len(some):
                continue
            word_k = word if k == GRAM else _words(self.flat, k)
            at = np.zeros(len(some), np.int64)
            if k == GRAM:
                count = self.size[some] - GRAM + 1
                base = np.concatenate(([0], np.cumsum(count)))
                place = np.arange(base[-1]) - np.repeat(base[:-1], count)
                w = word[np.repeat(self.start[:-1][some], count) + place]
                _, number, times = np.unique(w, return_inverse=True, return_counts=True)
                # the rarest gram; among equally rare ones any will do, a hash spreads them
                rank = (times[number].astype(np.uint64) << np.uint64(32)) | _slots(w, 32)
                best = np.minimum.reduceat(rank, base[:-1])
                hit = np.flatnonzero(rank == np.repeat(best, count))
                owner = np.searchsorted(base, hit, side="right") - 1
                owner, one = np.unique(owner, return_index=True)
                at = place[hit[one]]
            anchor = word_k[self.start[:-1][some] + at]
            order = np.argsort(anchor, kind="stable")
            values, first = np.unique(anchor[order], return_index=True)
            bits = min(24, max(12, int(math.log2(len(values))) + 5))
            table = np.zeros(1 << bits, bool)
            table[_slots(values, bits)] = True
            self.kinds.append((k, bits, table, values, np.append(first, len(order)), some[order], at[order]))

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and name of every occurrence in ``data``, overlapping ones too."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        head = _words(data, GRAM)
        for k, bits, table, values, first, name, at in self.kinds:
            word = head if k == GRAM else head >> np.uint64(8 * (GRAM - k))
            place = np.flatnonzero(table[_slots(word, bits)])
            place = place[place + k <= len(data)]
            number = np.minimum(np.searchsorted(values, word[place]), len(values) - 1)
            hit = values[number] == word[place]
            place, number = place[hit], number[hit]
            count = np.diff(first)[number]
            entry = np.repeat(first[number] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            start, who = np.repeat(place, count) - at[entry], name[entry]
            if k == GRAM:
                ok = (start >= 0) & (start + self.size[who] <= len(data))
                start, who = start[ok], who[ok]
                ok = (head[start] == self.head[who]) & (head[start + self.size[who] - GRAM] == self.tail[who])
                start, who = self._same(data, start[ok], who[ok])
            starts.append(start)
            found.append(who)
        start, who = np.concatenate(starts), np.concatenate(found)
        order = np.lexsort((who, start))
        return start[order], who[order]

    def _same(self, data: np.ndarray, start: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose bytes between the first and the last eight are the name's as well."""
        ok = np.ones(len(start), bool)
        rest = np.flatnonzero(self.size[who] > 2 * GRAM)
        total = np.cumsum(self.size[who[rest]])
        a = 0
        while a < len(rest):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + COMPARE, side="right")))
            some = rest[a:b]
            size = self.size[who[some]]
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            step = np.arange(size.sum()) - np.repeat(begin, size)
            same = data[np.repeat(start[some], size) + step] == self.flat[np.repeat(self.start[who[some]], size) + step]
            ok[some] = np.logical_and.reduceat(same, begin)
            a = b
        return start[ok], who[ok]


def _apart(doc: np.ndarray, start: np.ndarray, who: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which occurrences count if one that overlaps a counted one of the same name and text doesn't."""
    order = np.lexsort((start, who, doc))
    d, s, w = doc[order], start[order], who[order]
    near = np.zeros(len(s), bool)
    near[1:] = (d[1:] == d[:-1]) & (w[1:] == w[:-1]) & (s[1:] - s[:-1] < size[w[1:]])
    keep, end = np.ones(len(s), bool), 0
    for i in np.flatnonzero(near):  # only within runs of a name that overlaps itself
        if not near[i - 1]:
            end = s[i - 1] + size[w[i - 1]]
        if s[i] < end:
            keep[i] = False
        else:
            end = s[i] + size[w[i]]
    out = np.empty(len(s), bool)
    out[order] = keep
    return out


def _texts(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def _found(patterns: Patterns, rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in it, name) of every occurrence, texts in blocks of some megabytes."""
    a = 0
    while a < len(rows):
        b, total = a, 0
        while b < len(rows) and (b == a or total + len(rows[b]) <= TEXT_BYTES):
            total += len(rows[b]) + 1
            b += 1
        begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in rows[a:b]])))
        start, who = patterns.find(np.frombuffer(b"\n".join(rows[a:b]), np.uint8))
        doc = np.searchsorted(begin, start, side="right") - 1
        inside = start + patterns.size[who] < begin[doc + 1]
        yield a + doc[inside], (start - begin[doc])[inside], who[inside]
        a = b


def _blocks(names: DataFrame, limit: int) -> Iterator[Patterns]:
    """The distinct names in blocks of about ``limit`` bytes; one block at a time is on the driver."""
    names = names.where(F.length("name") > 0).distinct()
    total = names.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    parts = -(-total // limit)
    for i in range(parts):
        some = names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i) if parts > 1 else names
        if rows := sorted(_texts(some.toArrow().column("name").combine_chunks())):
            yield Patterns(rows)


def counts(names: DataFrame, texts: DataFrame, name: str = "name", text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """name, n, n_texts of the names that occur: occurrences that don't overlap, and the texts that have one."""
    spark = texts.sparkSession
    ship(spark)
    source = texts.select(F.col(text).cast("string").alias("text"))
    parts = []
    for patterns in _blocks(names.select(F.col(name).cast("string").alias("name")), limit):
        sent = spark.sparkContext.broadcast(patterns)

        def count(batches, sent=sent):
            p = sent.value
            n = np.zeros((2, len(p.names)), np.int64)
            for batch in batches:
                for row, start, who in _found(p, _texts(batch.column("text"))):
                    n[0] += np.bincount(who[_apart(row, start, who, p.size)], minlength=len(p.names))
                    n[1] += np.bincount(np.unique(row * len(p.names) + who) % len(p.names), minlength=len(p.names))
            for a in range(0, len(p.names), 10_000):
                hit = a + np.flatnonzero(n[0, a : a + 10_000])
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array([p.names[i].decode() for i in hit]), pa.array(n[0, hit]), pa.array(n[1, hit])], ["name", "n", "n_texts"])

        parts.append(source.mapInArrow(count, "name string, n long, n_texts long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts")))
    return _all(parts, spark, "name string, n long, n_texts long")


def matches(names: DataFrame, texts: DataFrame, keys: list[str], name: str = "name", text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """``keys`` of the text, name, at (characters before it), counted (whether ``counts`` counts it) of every occurrence, overlapping ones too."""
    spark = texts.sparkSession
    ship(spark)
    source = texts.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "name string, at long, counted boolean"])
    parts = []
    for patterns in _blocks(names.select(F.col(name).cast("string").alias("name")), limit):
        sent = spark.sparkContext.broadcast(patterns)

        def find(batches, sent=sent):
            p = sent.value
            for batch in batches:
                rows = _texts(batch.column("_text"))
                for row, start, who in _found(p, rows):
                    at = [len(rows[i][:b].decode()) for i, b in zip(row.tolist(), start.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(pa.array(row)) for k in keys), pa.array([p.names[i].decode() for i in who], pa.string()), pa.array(at, pa.int64()), pa.array(_apart(row, start, who, p.size))], [*keys, "name", "at", "counted"]
                    )

        parts.append(source.mapInArrow(find, schema))
    return _all(parts, spark, schema)


def _all(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
