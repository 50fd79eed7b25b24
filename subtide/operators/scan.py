"""Running values over ordered rows for keys with few values, in two levels.

A window by such a key is a task for each of its values, whatever the number of rows.
Here rows are sorted into ranges of key and order, each of bounded size; a range is
scanned for itself, and what the ranges before it add up to is put on top afterwards.
That is one row for each key and range, so the second level is small.

Rows are written once with the number of their range (``shared.written``), so the two
levels see the same ranges.  Rows that are equal in key and order are in one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide import shared

#: Aggregate, and how two of its results are put together (null is nothing).
_KINDS = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(df: DataFrame, part: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]], inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``values`` (name: kind of aggregate, column) over the rows of the key before each row, or up to it.

    ``ranges`` is the number of ranges, that of shuffle partitions by default; adaptive
    execution makes fewer of them where rows are few.  Null keys are a key of their own.
    """
    made = df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    keys = [*part, *order]
    made = (made.repartitionByRange(ranges, *keys) if ranges else made.repartitionByRange(*keys)).withColumn("_range", F.spark_partition_id())
    made = shared.written(made, "ranges")
    sums = made.groupBy(*part, "_range").agg(*[_KINDS[k][0](f"_v_{n}").alias(f"_s_{n}") for n, (k, _) in values.items()])
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    again = lambda k: F.sum if k == "count" else _KINDS[k][0]
    carried = sums.select(*[F.col(p).alias(f"_k_{p}") for p in part], F.col("_range").alias("_at"), *[again(k)(f"_s_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in values.items()])
    own = Window.partitionBy(*part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = made.withColumns({f"_l_{n}": _KINDS[k][0](f"_v_{n}").over(own) for n, (k, _) in values.items()})
    same = F.col("_range") == F.col("_at")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"_k_{p}"))
    out = local.join(carried, same, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *[_KINDS[k][1](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in values.items()])


def numbered(df: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "number", **options) -> DataFrame:
    """Row numbers from 1 within each key."""
    return running(df, part, order, {name: ("count", F.lit(1))}, inclusive=True, **options)


def nearest_ranks(df: DataFrame, part: Sequence[str], value: str, shares: Mapping[str, float], **options) -> DataFrame:
    """``part`` and, for each of ``shares`` (name: p), the value at the half-even rounded rank ``(n - 1) * p``; nulls don't count.

    No group is gathered: rows become counts of distinct values, which a scan over ranges of values adds up.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, part, [value], {"_upto": ("sum", F.col("_n"))}, inclusive=True, **options)
    total = ranked.groupBy(*part, F.lit(0).alias("_one")).agg(F.max("_upto").alias("_all"))
    total = total.select(*[F.col(p).alias(f"_t_{p}") for p in part], F.col("_one").alias("_t__one"), "_all")
    both = ranked.withColumn("_one", F.lit(0)).join(total, _all_equal([*part, "_one"]))
    rank = lambda p: F.rint((F.col("_all") - 1) * p) + 1
    return both.groupBy(*part).agg(*[F.min(F.when(F.col("_upto") >= rank(p), F.col(value))).alias(n) for n, p in shares.items()])


def _all_equal(part: Sequence[str]) -> Column:
    same = F.lit(True)
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"_t_{p}"))
    return same
