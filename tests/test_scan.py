"""Running values and ranks in two levels against plain windows and sorted lists."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from subtide.operators import relational, scan, sequence


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 400), i, rng.choice([None, *range(-5, 50)])) for i in range(3000)]
    data += [("once", 1, 9000, None), ("none", 1, 9001, None), ("none", 2, 9002, None)]
    return spark.createDataFrame(data, "key string, at long, id long, v long")


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("part", [["key"], []])
def test_running_equals_a_window(spark, rows, part, inclusive):
    for ranges in (1, 7, 40):
        got = scan.running(rows, part, ["at", "id"], {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}, inclusive, ranges)
        w = Window.partitionBy(*part).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = rows.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("c"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"))
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert scan.running(rows.limit(0), part, ["at"], {"s": ("sum", F.col("v"))}).count() == 0


def test_no_window_by_the_key_alone(spark, rows):
    plan = scan.running(rows, ["key"], ["at", "id"], {"s": ("sum", F.col("v"))}, ranges=7)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert len(windows) == 2 and all("_range" in x for x in windows)


def test_operators_agree_in_both_ways(spark, rows):
    d = rows.withColumn("start", F.col("at").cast("double")).withColumn("end", F.col("at") + F.col("v"))
    plain = lambda x: sorted(map(repr, x.select(sorted(x.columns)).collect()))
    assert plain(sequence.overlaps(d, ["key"], ["at", "id"])) == plain(sequence.overlaps(d, ["key"], ["at", "id"], few_keys=True))
    assert plain(relational.batches(rows, ["key"], ["at", "id"], 7)) == plain(relational.batches(rows, ["key"], ["at", "id"], 7, few_keys=True))


def test_nearest_ranks(spark, rows):
    data = rows.collect()
    for part in (["key"], []):
        got = relational.nearest_ranks(rows, part, "v", low=0.0, half=0.5, p95=0.95, top=1.0).collect()
        groups = {}
        for r in data:
            if r["v"] is not None:
                groups.setdefault(r["key"] if part else None, []).append(r["v"])
        want = {k: tuple(sorted(v)[round((len(v) - 1) * p)] for p in (0, 0.5, 0.95, 1)) for k, v in groups.items()}
        assert {(r["key"] if part else None): (r["low"], r["half"], r["p95"], r["top"]) for r in got} == want
    ties = spark.createDataFrame([(x,) for x in [1.5] * 5 + [2.5] * 5], "v double")
    assert tuple(relational.nearest_ranks(ties, [], "v", a=0.44, b=0.45, c=0.5).first()) == (1.5, 1.5, 1.5)
