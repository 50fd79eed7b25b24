"""Joins, aggregates, ordering and set operators of the subtitle relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide import resources as R
from subtide.operators import matching, scan

#: A side is broadcast by hint only below so many rows and bytes of text (both are looked at first); above, Spark chooses.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of ``size`` bytes together (the check reads one row more)."""
    some = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    r = some.agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if r["n"] <= rows and (r["b"] or 0) <= size else df


def positional_pair(left: DataFrame, right: DataFrame, part: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Rows of both sides by their place in a group, over the common prefix.  ``columns``: right's names and their new ones."""
    place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    a, b = left.withColumn("ordinal", place), right.withColumn("ordinal", place)
    return a.join(b.select(*part, "ordinal", *[F.col(c).alias(n) for c, n in columns.items()]), [*part, "ordinal"])


def count_mismatch(left: DataFrame, right: DataFrame, part: Sequence[str]) -> DataFrame:
    """Groups with another number of rows on either side."""
    a, b = left.groupBy(*part).agg(F.count("*").alias("n_left")), right.groupBy(*part).agg(F.count("*").alias("n_right"))
    both = a.join(b, list(part), "full_outer").na.fill(0, ["n_left", "n_right"])
    return both.where(F.col("n_left") != F.col("n_right"))


def complete_translation(cues: DataFrame, lines: DataFrame, part: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Cues with their lines, only for documents that have a line for every cue."""
    joined = cues.join(lines, [*part, "pos"], "left")
    w = Window.partitionBy(*part)
    return joined.withColumn("_all", F.count("*").over(w)).withColumn("_have", F.count("line").over(w)).where("_all = _have").drop("_all", "_have")


def lookup(tokens: DataFrame, table: DataFrame, key: str, *values: str) -> DataFrame:
    """Left join on the whole token; the table is broadcast if it is small."""
    return tokens.join(small(table.select(key, *values)), key, "left")


def cache_split(items: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Items that the cache answers, and the misses."""
    return items.join(cache, key), items.join(cache.select(key), key, "left_anti")


def requested_only(answers: DataFrame, requested: DataFrame, key: str = "id") -> DataFrame:
    """Answers to what was asked: unknown ids go."""
    return answers.join(requested.select(key), key, "left_semi")


def batches(items: DataFrame, part: Sequence[str], order: Sequence[str], size: int = 25, few_keys: bool = False) -> DataFrame:
    """Batch numbers from 0, ``size`` items each.  ``few_keys``: the key has few values, so their rows are counted in ranges."""
    if few_keys:
        return scan.numbered(items, part, order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size))
    return items.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1) / size))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, values: Sequence[str], override: bool = False, always: Sequence[str] = ()) -> DataFrame:
    """Both tables by key; the existing value wins unless ``override`` (columns in ``always`` are kept from the existing row)."""
    a = existing.select(key, *[F.col(v).alias(f"a_{v}") for v in values])
    b = incoming.select(key, *[F.col(v).alias(f"b_{v}") for v in values])
    pick = lambda v: F.coalesce(f"a_{v}", f"b_{v}") if not override or v in always else F.coalesce(f"b_{v}", f"a_{v}")
    return a.join(b, key, "full_outer").select(key, *[pick(v).alias(v) for v in values])


def glossary(names: DataFrame, limit: int = 120) -> DataFrame:
    """The names with a translation, longest first."""
    return names.where(F.coalesce(F.trim("vi"), F.lit("")) != "").orderBy(F.length("han").desc(), "han").select("han", "vi").limit(limit)


def verified_names(names: DataFrame, texts: DataFrame, han: str = "han", text: str = "text") -> DataFrame:
    """Names that occur in a text."""
    return names.join(matching.counts(names, texts, han, text).select(F.col("name").alias(han)), han, "left_semi")


def split_names(lines: DataFrame, part: Sequence[str], line: str, words: str, longest: int = 4, letters: int = 6) -> DataFrame:
    """Runs of 2 to ``longest`` words (an array; null parts runs) of a line that are written as one word elsewhere in the group: the first place of each.

    Runs of at most ``letters`` letters and words of that length are written out in one pass
    over the lines, and meet in one hash aggregate by group and text, so no group is gathered
    or sorted.  A place is one number for that: line (from 0), position (31 bits), lengths of the words.
    """
    bits = letters.bit_length()
    below = 31 + bits * longest
    if below > 63:
        raise ValueError("runs this long have no number")
    each = lines.select(*part, F.col(line).cast("decimal(19,0)").alias("line"), F.col(words).alias("w"), F.posexplode(words).alias("i", "word"))
    entry = lambda text, place: F.struct(text.alias("text"), place.cast("decimal(38,0)").alias("place"))

    def run_of(k: int) -> Column:
        of = [F.get("w", F.col("i") + j) for j in range(k)]  # null beyond the end
        size = [F.length(x) for x in of]
        spelt = F.shiftleft(F.col("i").cast("long"), bits * longest) + sum((F.shiftleft(n.cast("long"), bits * j) for j, n in enumerate(size[1:], 1)), size[0].cast("long"))
        return F.when(sum(size[1:], size[0]) <= letters, entry(F.concat(*of), F.col("line") * F.lit(1 << below).cast("decimal(19,0)") + spelt.cast("decimal(19,0)")))

    known = F.when(F.length("word") <= letters, entry(F.col("word"), F.lit(None)))
    rows = each.select(*part, F.explode(F.array(known, *[run_of(k) for k in range(2, longest + 1)])).alias("r")).where("r is not null").select(*part, "r.text", "r.place")
    hits = rows.groupBy(*part, "text").agg(F.min("place").alias("f"), F.count("place").alias("n"), F.bool_or(F.col("place").isNull()).alias("known")).where("known and n > 0")
    hits = hits.withColumn("_line", F.expr(f"f div {1 << below}")).withColumn("_spelt", (F.col("f") % F.lit(1 << below)).cast("long"))
    length = [F.shiftright("_spelt", bits * j).bitwiseAND((1 << bits) - 1).cast("int") for j in range(longest)]
    shown = F.concat_ws(" ", *[F.when(n > 0, F.substr("text", sum(length[:j], F.lit(1)), n)) for j, n in enumerate(length)])
    return hits.select(*part, "text", "n", F.col("_line").alias(line), shown.alias("shown"))


def summary(findings: DataFrame) -> DataFrame:
    """Findings of each severity and code, with totals."""
    return findings.rollup("severity", "code").agg(F.count("*").alias("n"))


def report_order(findings: DataFrame) -> DataFrame:
    """``place`` from 1 within a document: by severity, then cue (none last), then code and message."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy(rank, F.col("cue_index").asc_nulls_last(), "code", "message")
    return findings.withColumn("place", F.row_number().over(w))


def code_histogram(findings: DataFrame) -> DataFrame:
    """Findings of each code, the most frequent first (``place``), then by code: a row for each code."""
    return findings.groupBy("code").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "code")))


def dedupe(findings: DataFrame, order: Sequence[str] = ("line",)) -> DataFrame:
    """One finding for each document, code, cue and message."""
    w = Window.partitionBy("doc_id", "code", "cue_index", "message").orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_known(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings but those of known (code, cue) pairs."""
    return findings.join(small(known.select("code", "cue_index").distinct()), ["code", "cue_index"], "left_anti")


def linear_percentile(column: str | Column, q: float) -> Column:
    return F.percentile(column, F.lit(q))


def nearest_ranks(df: DataFrame, part: Sequence[str], value: str, **shares: float) -> DataFrame:
    """``part`` and for each share the value at its half-even rounded rank, without gathering a group."""
    return scan.nearest_ranks(df, part, value, shares)


def cue_stats(cues: DataFrame, part: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """Counts, gaps, overlaps, short and long cues, durations."""
    w = Window.partitionBy(*part).orderBy(*order)
    d = cues.withColumn("duration", F.col("end") - F.col("start")).withColumn("gap", F.lead("start").over(w) - F.col("end")).withColumn("n_han", F.length(F.regexp_replace(text, f"[^{R.HAN_TOKEN[1:-1]}]", "")))
    n = lambda c: F.count_if(c)
    return d.groupBy(*part).agg(
        F.count("*").alias("cues"), F.max("end").alias("total"), F.min("duration").alias("min_duration"), linear_percentile("duration", 0.5).alias("median_duration"), linear_percentile("duration", 0.95).alias("p95_duration"),
        F.max("duration").alias("max_duration"), n(F.col("gap") == 0).alias("zero_gap"), n(F.col("gap") < 0).alias("overlaps"), n(F.col("duration") <= 0).alias("non_positive"),
        n(F.col("duration") < 0.8).alias("under_0_8s"), n(F.col("duration") > 6).alias("over_6s"), n(F.col("n_han") > 18).alias("over_18_han"),
    )


def verdict(measured: Column, target: Column, tolerance: float = 0.3) -> Column:
    """ok within the tolerance, else low or high."""
    return F.when(F.abs(measured - target) <= tolerance * target, "ok").when(measured < target, "low").otherwise("high")


def peaks(samples: DataFrame, part: Sequence[str], window: Column, value: str) -> DataFrame:
    """The largest amount in each window, as 0..255 of the group's largest."""
    per = samples.groupBy(*part, window.alias("bucket")).agg(F.max(F.abs(value)).alias("peak"))
    top = F.max("peak").over(Window.partitionBy(*part))
    return per.withColumn("level", F.when(top > 0, F.rint(F.col("peak") * 255 / top).cast("int")).otherwise(0))


def case_agreement(fixed: DataFrame, reference: DataFrame, keys: Sequence[str], part: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Share of lines whose first letter has the reference's case.

    With ``part`` and ``order``, lines after one that ends in an ellipsis aren't compared: either case is right there.
    """
    if order:
        after = F.coalesce(F.rtrim(F.lag("line").over(Window.partitionBy(*part).orderBy(*order))), F.lit(""))
        fixed = fixed.withColumn("_open", after.endswith(R.ELLIPSIS)).where(~F.col("_open"))
    first = lambda c: F.regexp_extract(c, r"\p{L}", 0)
    both = fixed.select(*keys, first(F.col("line")).alias("a")).join(reference.select(*keys, first(F.col("line")).alias("b")), list(keys))
    same = (F.upper("a") == F.col("a")) == (F.upper("b") == F.col("b"))
    return both.where("a <> '' and b <> ''").agg(F.count("*").alias("compared"), F.avg(same.cast("int")).alias("agreement"))


def keep_newest(jobs: DataFrame, keep: int = 60) -> DataFrame:
    """Active jobs, and the newest ``keep`` others of each owner."""
    w = Window.partitionBy("owner", "active").orderBy(F.col("created").desc(), "job_id")
    return jobs.withColumn("_n", F.row_number().over(w)).where(F.col("active") | (F.col("_n") <= keep)).drop("_n")


def review_queue(cues: DataFrame) -> DataFrame:
    """A row for each token and flag that somebody should look at."""
    t = cues.select("doc_id", "pos", "index", F.posexplode("tokens").alias("tok", "t"))
    return t.select("doc_id", "pos", "index", "tok", "t.zh", "t.pinyin", F.explode(F.array_intersect("t.flags", F.array(*[F.lit(x) for x in ("AI_APPLIED", "CASE_AMBIG", "HETERONYM")]))).alias("flag"))


def uncertain(cues: DataFrame, confidence: float = 0.8, limit: int = 120) -> DataFrame:
    """Tokens with an open reading: flagged or unsure, no names; the shortest and least sure first."""
    t = cues.select("doc_id", "pos", F.posexplode("tokens").alias("tok", "t")).where("t.kind = 'word'")
    t = t.where((F.array_contains("t.flags", "HETERONYM") | (F.col("t.confidence") < confidence)) & ~F.array_contains("t.flags", "NAME"))
    return t.orderBy(F.length("t.zh"), "t.confidence", "doc_id", "pos", "tok").limit(limit)
