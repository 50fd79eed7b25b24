"""Whether a pinyin is a reading of its Chinese cluster, with the readings as a table.

A cluster is looked up as a whole first; else its characters' readings are a lattice, and
the pinyin must be one way through it.  The lattice is walked by a fold that keeps the
lengths of the pinyin's beginnings that the characters so far can spell.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide import resources as R
from subtide.functions import text

#: The range of Han that has readings, in the syntax of Spark's patterns.
_HAN = re.sub(r"\\U0*([0-9a-fA-F]+)", r"\\x{\1}", R.HAN_READING)


def spells(groups: Column, key: Column) -> Column:
    """Whether one of each group's strings, in order, make up ``key``."""

    def step(lengths: Column, group: Column) -> Column:
        on = lambda at: F.transform(F.filter(group, lambda r: F.substr(key, at + 1, F.length(r)) == r), lambda r: at + F.length(r))
        return F.array_distinct(F.flatten(F.transform(lengths, on)))

    return F.array_contains(F.aggregate(groups, F.array(F.lit(0)), step), F.length(key))


def fits(tokens: DataFrame, readings: DataFrame, zh: str = "zh", pinyin: str = "pinyin") -> DataFrame:
    """``tokens`` with ``fits``: false where the pinyin is no reading; what can't be judged fits.

    ``readings`` (zh, pinyin) has characters and clusters, a row for each reading.  Each
    distinct cluster and pinyin is judged once.  Can't be judged: no pinyin, no Han, or a
    character without any reading.
    """
    key = text.pinyin_key(F.coalesce(F.col(pinyin), F.lit("")))
    known = readings.select(F.col("zh").alias("_part"), text.pinyin_key(F.col("pinyin")).alias("r")).where("r <> ''")
    known = known.groupBy("_part").agg(F.collect_set("r").alias("rs"))
    pairs = tokens.select(F.col(zh).alias("_zh"), key.alias("_key")).where((F.col("_key") != "") & F.col("_zh").rlike(R.HAN_RULE)).distinct()
    whole = pairs.join(known, F.col("_zh") == F.col("_part"), "left").select("_zh", "_key", F.coalesce(F.array_contains("rs", F.col("_key")), F.lit(False)).alias("whole"))
    parts = whole.select("*", F.posexplode(F.filter(F.split("_zh", ""), lambda c: c != "")).alias("k", "_part")).join(known, "_part", "left")
    lattice = parts.groupBy("_zh", "_key", "whole").agg(F.array_sort(F.collect_list(F.struct("k", "rs"))).alias("g"), F.count_if(F.col("rs").isNull()).alias("unknown"))
    suffix = (F.length("_zh") >= 2) & F.endswith("_zh", F.lit("儿"))
    groups = F.transform("g", lambda x, i: F.when(suffix & (i == F.size("g") - 1), F.array_append(x["rs"], "r")).otherwise(x["rs"]))
    judged = lattice.select("_zh", "_key", (F.col("whole") | (F.col("unknown") > 0) | spells(groups, F.col("_key"))).alias("_fits"))
    out = tokens.withColumn("_key", key)
    out = out.join(judged, (out[zh] == judged["_zh"]) & (out["_key"] == judged["_key"]), "left")
    return out.select(*[tokens[c] for c in tokens.columns], F.coalesce("_fits", F.lit(True)).alias("fits"))


def first_readings(tokens: DataFrame, readings: DataFrame, keys: Sequence[str], zh: str = "zh") -> DataFrame:
    """``keys``, zh, pinyin: a cluster's own reading, else those of its characters, else the character itself; of several readings the one of least ``rank``."""
    best = readings.groupBy(F.col("zh").alias("_part")).agg(F.min_by("pinyin", F.struct("rank", "pinyin")).alias("r"))
    distinct = tokens.select(F.col(zh).alias("_zh")).where(F.col(zh).rlike(_HAN)).distinct()
    whole = distinct.join(best, F.col("_zh") == F.col("_part"), "left").select("_zh", F.col("r").alias("whole"))
    parts = whole.where("whole is null").select("_zh", F.posexplode(F.filter(F.split("_zh", ""), lambda c: c != "")).alias("k", "_part")).join(best, "_part", "left")
    spelt = parts.groupBy("_zh").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("r", "_part").alias("r")))), lambda x: x["r"]), "").alias("spelt"))
    found = whole.join(spelt, "_zh", "left").select("_zh", F.coalesce("whole", "spelt").alias("_py"))
    out = tokens.join(found, tokens[zh] == found["_zh"], "left")
    return out.select(*[tokens[k] for k in keys], tokens[zh].alias("zh"), F.coalesce("_py", tokens[zh]).alias("pinyin"))
