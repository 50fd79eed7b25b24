"""Operators over ordered rows: running states, islands, cue packing, timing, look-ahead and look-back.

Every operator takes its partition and its order, so no window spans the whole input.
True recurrences are folds over the rows of one group (``F.aggregate``), JVM-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide import resources as R
from subtide.operators import scan

Names = Sequence[str]


def _before(part: Names, order: Names):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def case_state(df: DataFrame, part: Names, order: Names, event: Column, name: str = "state") -> DataFrame:
    """The state that the last event before a row left, ``upper`` at the start."""
    return df.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(_before(part, order)), F.lit("upper")))


def mark_event(kind: Column, zh: Column, pinyin: Column) -> Column:
    """What a token says about the case of the next word."""
    last = F.substr(zh, F.lit(-1))
    among = lambda marks: last.isin(*marks)
    return (
        F.when(kind == "marker", "upper")
        .when((kind == "word") & (F.coalesce(pinyin, F.lit("")) != ""), "lower")
        .when((kind == "punct") & (zh.endswith(R.ELLIPSIS) | zh.rlike("^…+$")), "ambig")
        .when((kind == "punct") & among(R.CASE_UPPER), "upper")
        .when((kind == "punct") & among(R.CASE_LOWER), "lower")
    )


def repeat_trim(df: DataFrame, part: Names, order: Names, same: Column, keep: int) -> DataFrame:
    """Rows but those beyond the first ``keep`` of a run; ``same`` says that a row repeats the one before (it may use lag)."""
    w = Window.partitionBy(*part).orderBy(*order)
    runs = df.withColumn("_island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = Window.partitionBy(*part, "_island").orderBy(*order)
    return runs.withColumn("repeat_no", F.row_number().over(rank)).where(F.col("repeat_no") <= keep).drop("_island")


def timeline_repair(df: DataFrame, part: Names, order: Names, start: str = "start", end: str = "end") -> DataFrame:
    """Starts not before the latest end so far, ends not before their starts."""
    cursor = F.max(F.greatest(start, end)).over(_before(part, order))
    fixed = df.withColumn("_cursor", cursor).withColumn(start, F.greatest(start, "_cursor"))
    return fixed.withColumn(end, F.greatest(end, start)).drop("_cursor")


def islands(df: DataFrame, part: Names, order: Names, cut: Column, name: str = "island") -> DataFrame:
    """Island number (from 0): a row with ``cut`` begins one."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(F.coalesce(cut, F.lit(False)), 1).otherwise(0)).over(w))


def silence_islands(df: DataFrame, part: Names, order: Names, silence: float, start: str = "start", end: str = "end") -> DataFrame:
    """Islands of rows with no gap of more than ``silence`` between them."""
    w = Window.partitionBy(*part).orderBy(*order)
    return islands(df, part, order, F.col(start) - F.lag(end).over(w) > silence)


def _ends_sentence(word: Column, following: Column, marks: str) -> Column:
    """A mark in the word that isn't a point or comma between digits."""
    plain = "".join(c for c in marks if c not in ".,")
    soft = "".join(c for c in marks if c in ".,")
    inside = F.regexp_replace(word, r"(?<=\d)[.,](?=\d)", "")
    joined = F.when(F.ltrim(F.coalesce(following, F.lit(""))).rlike(r"^\d"), F.regexp_replace(inside, r"(?<=\d)[.,]$", "")).otherwise(inside)
    return joined.rlike("[" + plain.replace("?", r"\?") + soft.replace(".", r"\.") + "]")


def cue_pack(words: DataFrame, part: Names, order: Names, cfg: dict | None = None) -> DataFrame:
    """Words (word, start, end) packed into cues: ``part``, index, start, end, text, reason, n_words.

    Cuts after a sentence end, after a pause mark once enough Han are there, at a
    silence, or where the next word would break a limit; never before a word of
    closing marks alone.  Cuts at sentence ends and silences don't depend on what was
    gathered, so they make islands by window; a fold packs each island.
    """
    cfg = R.CUE | (cfg or {})
    w = Window.partitionBy(*part).orderBy(*order)
    tail = F.col("word").rlike(r"^\s*[" + "".join("\\" + c if c in "]\\^-[" else c for c in R.TRAILING_MARKS) + r"]+\s*$")
    d = words.withColumn("_tail", tail).withColumn("_next", F.lead("word").over(w)).withColumn("_next_tail", F.coalesce(F.lead("_tail").over(w), F.lit(False)))
    d = d.withColumn("_next_start", F.lead("start").over(w)).withColumn("_next_end", F.lead("end").over(w))
    ends, pauses = _ends_sentence(F.col("word"), F.col("_next"), R.ENDERS), _ends_sentence(F.col("word"), F.col("_next"), R.PAUSES)
    d = d.withColumn("_pause", pauses & ~ends)
    silent = F.col("_next_start") - F.col("end") > cfg["silence"]
    # a silence after a pause mark is a silence only if the pause itself doesn't cut: the same place either way
    d = d.withColumn("_hard", F.when(F.col("_next").isNull(), "eof").when(F.col("_next_tail"), None).when(ends, "end").when(silent, "silence"))
    d = islands(d, part, order, F.lag("_hard").over(w).isNotNull(), "_island")
    han, dense = F.length(F.regexp_replace("word", f"[^{R.HAN_TOKEN[1:-1]}]", "")), F.length(F.regexp_replace("word", r"\s", ""))
    item = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], "word", "start", "end", han.alias("han"), dense.alias("dense"), "_pause", "_hard", "_next_tail")
    groups = d.groupBy(*part, "_island").agg(F.array_sort(F.collect_list(item)).alias("list"))
    cue = "struct<start:double,end:double,text:string,reason:string,n_words:int>"
    zero = F.struct(F.array().cast(f"array<{cue}>").alias("done"), F.lit("").alias("text"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0).alias("han"), F.lit(0).alias("dense"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("first"))

    def step(acc: Column, k: Column) -> Column:
        x, nxt = F.element_at("list", k + 1), F.try_element_at(F.col("list"), k + 2)
        text, n = F.concat(acc["text"], x["word"]), acc["n"] + 1
        start, end, first = F.least(acc["start"], x["start"]), F.greatest(acc["end"], x["end"]), F.coalesce(acc["first"], x["start"])
        han, dense = acc["han"] + x["han"], acc["dense"] + x["dense"]
        over = (han + nxt["han"] > cfg["max_chars"]) | (dense + nxt["dense"] > 2 * cfg["max_chars"]) | (nxt["end"] - first > cfg["max_duration"])
        reason = F.when(x["_hard"].isin("eof", "end"), x["_hard"]).when(x["_next_tail"], None).when(x["_pause"] & (han >= cfg["comma_min"]), "pause").when(x["_hard"] == "silence", "silence").when(nxt.isNotNull() & over, "limit")
        made = F.struct(start.alias("start"), end.alias("end"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), reason.alias("reason"), n.cast("int").alias("n_words"))
        none = F.lit(None).cast("double")
        cut = F.struct(F.concat(acc["done"], F.array(made)).alias("done"), F.lit("").alias("text"), none.alias("start"), none.alias("end"), F.lit(0).alias("han"), F.lit(0).alias("dense"), F.lit(0).alias("n"), none.alias("first"))
        go = F.struct(acc["done"].alias("done"), text.alias("text"), start.alias("start"), end.alias("end"), han.alias("han"), dense.alias("dense"), n.alias("n"), first.alias("first"))
        return F.when(reason.isNotNull(), cut).otherwise(go)

    packed = groups.select(*part, "_island", F.posexplode(F.aggregate(F.sequence(F.lit(0), F.size("list") - 1), zero, step, lambda acc: acc["done"])).alias("_k", "cue"))
    packed = packed.where(F.col("cue.text") != "")
    return packed.select(*part, F.row_number().over(Window.partitionBy(*part).orderBy("_island", "_k")).alias("index"), "cue.*")


def enforce_timing(cues: DataFrame, part: Names, order: Names, cfg: dict | None = None) -> DataFrame:
    """Starts after the end before (and a gap), ends stretched to the least duration within the room there is, milliseconds.

    A recurrence over the cues of a document, so a fold: (part, index, start, end) come back.
    """
    cfg = R.CUE | (cfg or {})
    gap, least, tick = cfg["min_gap"], cfg["min_duration"], cfg["tick"]
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    groups = cues.groupBy(*part).agg(F.array_sort(F.collect_list(row)).alias("list"))
    made = "struct<start:double,end:double>"
    ms = lambda x: F.rint(x * 1000) / 1000

    def step(acc: Column, k: Column) -> Column:
        x, nxt = F.element_at("list", k + 1), F.try_element_at(F.col("list"), k + 2)
        before = F.try_element_at(acc, F.lit(-1))["end"]
        start = F.greatest(x["start"], before + gap)
        end = F.greatest(x["end"], start)
        want = F.greatest(end, start + least)
        want = F.when(nxt.isNotNull(), F.least(want, F.greatest(end, nxt["start"] - gap))).otherwise(want)
        a, b = ms(start), ms(F.greatest(want, start + tick))
        return F.concat(acc, F.array(F.struct(a.alias("start"), F.when(b <= a, ms(a + tick)).otherwise(b).alias("end"))))

    folded = F.aggregate(F.sequence(F.lit(0), F.size("list") - 1), F.array().cast(f"array<{made}>"), step)
    return groups.select(*part, F.posexplode(folded).alias("_k", "cue")).select(*part, (F.col("_k") + 1).alias("index"), "cue.start", "cue.end")


def overlaps(df: DataFrame, part: Names, order: Names, start: str = "start", end: str = "end", few_keys: bool = False) -> DataFrame:
    """Rows that start before the latest end so far; ``before`` has it.  ``few_keys``: the key has few values, so their rows are scanned in ranges."""
    if few_keys:
        return scan.running(df, part, order, {"before": ("max", F.col(end))}).where(F.col(start) < F.col("before"))
    return df.withColumn("before", F.max(end).over(_before(part, order))).where(F.col(start) < F.col("before"))


def index_breaks(df: DataFrame, part: Names, order: Names, index: str = "index") -> DataFrame:
    """Rows whose number isn't the one after the last number, which re-anchors; the first must be 1.  Rows without a number break too."""
    last = F.last(index, ignorenulls=True).over(_before(part, order))
    return df.withColumn("expected", F.coalesce(last, F.lit(0)) + 1).where(F.col(index).isNull() | (F.col(index) != F.col("expected")))


def look_ahead(df: DataFrame, part: Names, order: Names, **columns: Column) -> DataFrame:
    """The next row's values, for sandhi."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumns({k: F.lead(c).over(w) for k, c in columns.items()})


def sandhi(tokens: DataFrame, part: Names, order: Names) -> DataFrame:
    """不 in the second tone before a word in the fourth (kind, zh, pinyin); reads its neighbour as it came in."""
    d = look_ahead(tokens, part, order, _kind=F.col("kind"), _py=F.col("pinyin"))
    first = F.translate(F.regexp_extract("_py", "[āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ]", 0), "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ", "123412341234123412341234")
    hit = (F.col("kind") == "word") & (F.col("zh") == "不") & (F.col("_kind") == "word") & (first == "4") & F.col("pinyin").isNotNull()
    return d.withColumn("pinyin", F.when(hit, F.translate("pinyin", "ùuÙU", "úúÚÚ")).otherwise(F.col("pinyin"))).drop("_kind", "_py")


def erhua_back(tokens: DataFrame, part: Names, order: Names) -> DataFrame:
    """A lone 儿 goes to the word before it, unless that can't take it; at most one for a word."""
    w = Window.partitionBy(*part).orderBy(*order)
    blocked = lambda zh: zh.isin(*R.ER_BLOCKED) | F.substr(zh, F.lit(-1)).isin(*R.ER_BLOCKED)
    can = (F.col("kind") == "word") & (F.col("zh") != "儿") & ~blocked(F.col("zh"))
    lone = (F.col("kind") == "word") & (F.col("zh") == "儿")
    d = tokens.withColumn("_can", can).withColumn("_lone", lone)
    d = d.withColumn("_take", F.col("_can") & F.coalesce(F.lead("_lone").over(w), F.lit(False))).withColumn("_gone", F.col("_lone") & F.coalesce(F.lag("_can").over(w), F.lit(False)))
    short = F.regexp_replace("pinyin", "(?<=[aoeiuüāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜn]|ng)[eēéěè]r$", "")
    d = d.withColumn("pinyin", F.when(F.col("_take") & F.col("pinyin").isNotNull(), F.when(short.rlike("[rR]$"), short).otherwise(F.concat(short, F.lit("r")))).otherwise(F.col("pinyin")))
    return d.withColumn("zh", F.when(F.col("_take"), F.concat("zh", F.lit("儿"))).otherwise(F.col("zh"))).where(~F.col("_gone")).drop("_can", "_lone", "_take", "_gone")


def neighbours(df: DataFrame, part: Names, order: Names, text: str = "text", before: int = 5, after: int = 0) -> DataFrame:
    """Texts of the rows around each row, joined by line feeds."""
    w = Window.partitionBy(*part).orderBy(*order)
    out = df.withColumn("context_before", F.array_join(F.collect_list(text).over(w.rowsBetween(-before, -1)), "\n"))
    return out.withColumn("context_after", F.array_join(F.collect_list(text).over(w.rowsBetween(1, after)), "\n")) if after else out


def signature(tokens: DataFrame, part: Names, order: Names) -> DataFrame:
    """Marks with the number of words before them."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("words_before", F.sum((F.col("kind") == "word").cast("int")).over(w)).where(F.col("kind").isin("punct", "marker"))


def quote_side(marks: DataFrame, part: Names, order: Names, mark: str = "mark") -> DataFrame:
    """Which side a straight quote is: they alternate, and a directional quote sets the state anew."""
    anchor = F.when(F.col(mark) == "“", 1).when(F.col(mark) == "”", 0)
    straight = (F.col(mark) == '"').cast("int")
    before = _before(part, order)
    d = marks.withColumn("_anchors", F.count(anchor).over(before)).withColumn("_open", F.coalesce(F.last(anchor, ignorenulls=True).over(before), F.lit(0)))
    since = F.coalesce(F.sum(straight).over(_before([*part, "_anchors"], order)), F.lit(0))
    d = d.withColumn("_state", (F.col("_open") + since) % 2)
    return d.withColumn("side", F.when(F.col(mark) == '"', F.when(F.col("_state") == 0, "“").otherwise("”")).otherwise(F.col(mark))).drop("_anchors", "_open", "_state")
