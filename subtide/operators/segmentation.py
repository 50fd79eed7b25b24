"""Words of texts that have no spaces: the likeliest path through a lexicon that is a table.

A lexicon (word, weight) gives each of its words the logarithm of its share of all
weights; a character that is no word counts as a word of weight 1.  A text's words are
those of the path with the greatest sum; of equal sums the one with the longer last word.

A lexicon of at most ``TRIE_ROWS`` words (counted first) goes to every task as a packed
trie: a sorted array of (node, character) for each depth, which all places of all texts
of a batch walk down side by side.  A larger one stays a table: parts of the texts meet
its words in a join, and a fold over a text's places finds its path.  Both give the same words.

Null and empty texts have no words; null words and weights of 0 or less aren't read; the
weights of repeated words add up; words beyond ``longest`` characters are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.session import ship

LONGEST = 8
TRIE_ROWS = 1_000_000
#: Sums that differ by less than this are equal, whatever the order in which they were added.
SAME = 1e-9
_POINT = 21  # bits of a code point


class Trie:
    """``levels[d]``: sorted keys (node << 21 | code point) of the nodes of depth d + 1, and their words' logarithms."""

    def __init__(self, words: list[str], logs: np.ndarray, unknown: float) -> None:
        self.unknown, self.levels = unknown, []
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in words]
        size = np.array([len(p) for p in points], np.int64)
        node, live = np.zeros(len(words), np.int64), np.arange(len(words))
        for depth in range(int(size.max(initial=0))):
            live = live[size[live] > depth]
            key = (node[live] << _POINT) | np.array([points[i][depth] for i in live], np.int64)
            keys, node[live] = np.unique(key, return_inverse=True)
            log = np.full(len(keys), -np.inf)
            ends = live[size[live] == depth + 1]
            log[node[ends]] = logs[ends]
            self.levels.append((keys, log))

    def arcs(self, text: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Logarithm of the word of each length from each place on (places x lengths), -inf where there is none; ``room`` places are left in its text."""
        out = np.full((len(text), max(1, len(self.levels))), -np.inf)
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        for depth, (keys, log) in enumerate(self.levels):
            some = room[at] > depth
            at, node = at[some], node[some]
            key = (node << _POINT) | text[at + depth]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[found] == key
            at, node = at[hit], found[hit]
            out[at, depth] = log[node]
        out[:, 0] = np.where(np.isneginf(out[:, 0]), self.unknown, out[:, 0])
        return out

    def cut(self, texts: list[str]) -> list[list[str]]:
        """Words of each text; a step goes over one place of all texts."""
        size = np.array([len(x) for x in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))
        text = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        room = np.repeat(begin[1:], size) - np.arange(len(text))
        arcs = self.arcs(text, room)
        order = np.argsort(-size, kind="stable")
        base = begin[:-1] + np.arange(len(texts))  # a text has one place more than letters
        best, last = np.full(len(text) + len(texts), -np.inf), np.zeros(len(text) + len(texts), np.int64)
        best[base] = 0.0
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        for i, n in enumerate(alive, 1):
            some = order[:n]
            top, width = np.full(n, -np.inf), np.ones(n, np.int64)
            for k in range(min(i, arcs.shape[1]), 0, -1):  # longer last words first: a shorter one must be better
                sum_ = best[base[some] + i - k] + arcs[begin[some] + i - k, k - 1]
                better = sum_ > top + SAME
                top, width = np.where(better, sum_, top), np.where(better, k, width)
            best[base[some] + i], last[base[some] + i] = top, width
        out = []
        for x, b in zip(texts, base.tolist(), strict=True):
            words, j = [], len(x)
            while j:
                k = int(last[b + j])
                words.append(x[j - k : j])
                j -= k
            out.append(words[::-1])
        return out


def _weights(lexicon: DataFrame, longest: int) -> tuple[DataFrame, float, int]:
    """(word, log) of the lexicon, the logarithm of the weights' sum, and the number of words."""
    d = lexicon.select(F.col("word").cast("string").alias("word"), F.col("weight").cast("double").alias("weight"))
    d = d.where(F.col("weight") > 0).groupBy("word").agg(F.sum("weight").alias("weight")).where(F.length("word").between(1, longest))
    total, n = d.agg(F.sum("weight"), F.count("*")).first()
    log = math.log(total) if total else 0.0
    return d.select("word", (F.ln("weight") - log).alias("log")), log, n


def segment(texts: DataFrame, lexicon: DataFrame, text: str = "text", longest: int = LONGEST, most: int = TRIE_ROWS) -> DataFrame:
    """``texts`` with ``words``, the words of their column ``text``."""
    weights, total, n = _weights(lexicon, longest)
    return _by_trie(texts, weights, total, text) if n <= most else _by_join(texts, weights, total, text, longest)


def _by_trie(texts: DataFrame, weights: DataFrame, total: float, text: str) -> DataFrame:
    spark = texts.sparkSession
    ship(spark)
    rows = weights.toArrow()  # at most TRIE_ROWS
    sent = spark.sparkContext.broadcast(Trie(rows.column("word").to_pylist(), rows.column("log").to_numpy(), -total))
    names = texts.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), "words array<string>"])

    def cut(batches):
        for batch in batches:
            words = sent.value.cut([x or "" for x in batch.column(names.index(text)).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], [*names, "words"])

    return texts.mapInArrow(cut, schema)


def _by_join(texts: DataFrame, weights: DataFrame, total: float, text: str, longest: int) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    distinct = texts.select(body.alias("_body")).distinct()
    places = distinct.where(F.length("_body") > 0).select("_body", F.explode(F.sequence(F.lit(1), F.length("_body"))).alias("i"))
    widths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_body") - F.col("i") + 1))
    parts = places.select("_body", "i", F.explode(widths).alias("k")).withColumn("word", F.substr("_body", F.col("i"), F.col("k")))
    arcs = parts.join(weights, "word", "left").where("log is not null or k = 1").withColumn("log", F.coalesce("log", F.lit(-total)))
    # arcs by the place where they end, longer ones first
    ends = arcs.groupBy("_body", (F.col("i") + F.col("k") - 1).alias("j")).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "log"))).alias("arcs"))
    whole = ends.groupBy("_body").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "arcs"))), lambda x: x["arcs"]).alias("ends"))
    step_ = "struct<best:double,k:int>"
    zero = F.array(F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("k")).cast(step_))

    def place(acc: Column, arcs_: Column) -> Column:
        # acc has an entry for each place so far: the arc of k letters begins k entries before the next one
        def better(top: Column, a: Column) -> Column:
            sum_ = F.element_at(acc, a["k"])["best"] + a["log"]
            return F.when(top["best"].isNull() | (sum_ > top["best"] + SAME), F.struct(sum_.alias("best"), (-a["k"]).alias("k")).cast(step_)).otherwise(top)

        return F.concat(acc, F.array(F.aggregate(arcs_, F.struct(F.lit(None).alias("best"), F.lit(None).alias("k")).cast(step_), better)))

    walk = F.aggregate("ends", zero, place, lambda acc: F.transform(acc, lambda x: x["k"]))

    def back(acc: Column, _: Column) -> Column:
        k = F.element_at("walk", acc["j"] + 1)
        moved = F.struct((acc["j"] - k).alias("j"), F.concat(F.array(F.substr("_body", acc["j"] - k + 1, k)), acc["words"]).alias("words"))
        return F.when(acc["j"] > 0, moved).otherwise(acc)

    start = F.struct(F.length("_body").alias("j"), F.array().cast("array<string>").alias("words"))
    found = whole.select("_body", walk.alias("walk")).select("_body", F.aggregate("walk", start, back, lambda acc: acc["words"]).alias("words"))
    out = texts.join(found, body == found["_body"], "left").drop("_body")
    return out.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
