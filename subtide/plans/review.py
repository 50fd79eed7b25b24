"""Proposals on case and on end marks, the case that follows from them, and edited rows.

Services propose, the engine decides: only enumerated answers are taken, a proposal that
agrees with the cue is confirmed, others are applied or rejected.  Cues have doc_id, pos
and tokens; answers come through ``names.cached_answers``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide import resources as R
from subtide import shared
from subtide.functions import text
from subtide.operators import relational
from subtide.plans import names
from subtide.sources import sinks

#: Answers on case and on end marks, marks that end a line, and how many items a list has unless all are asked for.
CASES = ("upper", "lower")
END_MARKS, NO_MARK = ("。", "？", "！", "，", "……"), "none"
CLOSED_BY = "。？！…；：》”）’、，"
CASE_ITEMS, END_ITEMS = 120, 150


def _in_file():
    return Window.partitionBy("doc_id").orderBy("pos")


def with_case(pinyin: Column, upper: Column) -> Column:
    """The first letter in the case that is asked for; acronyms stay."""
    acronym = pinyin.rlike(r"^[^\p{L}]*\p{Lu}\p{Lu}")
    head = F.regexp_extract(pinyin, r"^[^\p{L}]*", 0)
    lowered = F.concat(head, F.lower(F.substr(pinyin, F.length(head) + 1, F.lit(1))), F.substr(pinyin, F.length(head) + 2))
    return F.when(upper, text.capitalise(pinyin)).otherwise(F.when(acronym, pinyin).otherwise(lowered))


def _first_word(tokens: Column) -> Column:
    """The first word with a text, and its place; null where there is none."""
    words = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("t"))), lambda x: (x["t"]["kind"] == "word") & (F.coalesce(x["t"]["zh"], F.lit("")) != ""))
    return F.try_element_at(words, F.lit(1))


def _last_visible(tokens: Column) -> Column:
    return F.try_element_at(F.filter(tokens, lambda t: F.trim(F.coalesce(t["zh"], F.lit(""))) != ""), F.lit(-1))


def _replaced(tokens: Column, at: Column, when: Column, pinyin: Column) -> Column:
    """Tokens with another pinyin for one of them, flagged as a service's doing."""
    new = lambda t: t.withField("pinyin", pinyin).withField("flags", F.array_union(F.coalesce(t["flags"], F.array().cast("array<string>")), F.array(F.lit("AI_APPLIED"))))
    return F.when(when, F.transform(tokens, lambda t, i: F.when(i == at, new(t)).otherwise(t))).otherwise(tokens)


def _viewed(cues: DataFrame, *keys: str) -> DataFrame:
    """doc_id, pos, line, the lines before and after, the first word and the last token of each cue, without its tokens."""
    d = cues.select("doc_id", "pos", *keys, sinks.render(F.col("tokens")).alias("line"), _first_word(F.col("tokens")).alias("first"), _last_visible(F.col("tokens")).alias("last"))
    return d.withColumn("before", F.coalesce(F.lag("line").over(_in_file()), F.lit(""))).withColumn("next", F.coalesce(F.lead("line").over(_in_file()), F.lit("")))


def _first(items: DataFrame, limit: int | None) -> DataFrame:
    return items if limit is None else items.orderBy("doc_id", "pos").limit(limit)


def case_items(cues: DataFrame, limit: int | None = CASE_ITEMS) -> DataFrame:
    """First words whose case the marks before leave open: doc_id, pos, at, zh, pinyin, payload; the first ``limit`` in the order of cues, or all."""
    return _first(_case_items(_viewed(cues)), limit)


def _case_items(viewed: DataFrame, *keys: str) -> DataFrame:
    d = viewed.where(F.array_contains("first.t.flags", "CASE_AMBIG") & (F.coalesce("first.t.pinyin", F.lit("")) != ""))
    payload = F.to_json(F.struct(F.col("before").alias("prev"), "line", F.col("first.t.zh").alias("word")))
    return d.select("doc_id", "pos", *keys, F.col("first.at").alias("at"), F.col("first.t.zh").alias("zh"), F.col("first.t.pinyin").alias("pinyin"), payload.alias("payload"))


def judge_case(answered: DataFrame) -> DataFrame:
    """Items with an ``answer``: status (unanswered, rejected, confirmed, applied) and ``after``."""
    said = F.lower(F.trim(F.get_json_object("answer", "$.case")))
    valid = F.coalesce(said.isin(*CASES), F.lit(False))
    after = F.when(valid, with_case(F.col("pinyin"), said == "upper"))
    return answered.withColumn("after", after).withColumn("status", F.when(F.col("answer").isNull(), "unanswered").when(~valid, "rejected").when(F.col("after") == F.col("pinyin"), "confirmed").otherwise("applied"))


def _applied(cues: DataFrame, judged: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """Cues with columns of the applied proposals; as many rows as before, whatever comes twice or has no number."""
    j = judged.where("status = 'applied'").select(*[F.col(k).alias(f"_j_{k}") for k in keys], *columns).dropDuplicates([f"_j_{k}" for k in keys])
    same = [cues[k].eqNullSafe(j[f"_j_{k}"]) for k in keys]
    return cues.join(j, same, "left").drop(*[f"_j_{k}" for k in keys])


def apply_case(cues: DataFrame, judged: DataFrame, keys: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """Cues with the applied proposals."""
    return _applied(cues, judged, keys, "at", "after").withColumn("tokens", _replaced(F.col("tokens"), F.col("at"), F.col("after").isNotNull(), F.col("after"))).drop("at", "after")


def end_items(cues: DataFrame, limit: int | None = END_ITEMS) -> DataFrame:
    """Lines that end without a closing mark: doc_id, pos, line, payload; the first ``limit`` in the order of cues, or all."""
    return _first(_end_items(_viewed(cues)), limit)


def _end_items(d: DataFrame, *keys: str) -> DataFrame:
    closed = (F.col("last.kind") == "punct") & F.substr(F.trim("last.zh"), F.lit(-1)).isin(*CLOSED_BY)
    d = d.where(F.col("last").isNotNull() & ~closed & F.col("last.kind").isin("word", "punct"))
    return d.select("doc_id", "pos", *keys, "line", F.to_json(F.struct("line", "next")).alias("payload"))


def judge_ends(answered: DataFrame) -> DataFrame:
    """Items with an ``answer``: status and the ``mark`` to add."""
    said = F.trim(F.coalesce(F.get_json_object("answer", "$.punct"), F.lit("")))
    status = F.when(F.col("answer").isNull(), "unanswered").when(said.isin(NO_MARK, ""), "confirmed").when(said.isin(*END_MARKS), "applied").otherwise("rejected")
    return answered.withColumn("status", status).withColumn("mark", F.when(status == "applied", said))


def apply_ends(cues: DataFrame, judged: DataFrame, keys: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """Cues with the marks that were taken, and ``closed``: whether one was added."""
    d = _applied(cues, judged, keys, "mark")
    token = cues.schema["tokens"].dataType.elementType.simpleString()
    added = F.array(F.struct(F.lit("punct").alias("kind"), F.col("mark").alias("zh"), F.lit(None).cast("string").alias("pinyin"), F.lit(1.0).alias("confidence"), F.lit("ai").alias("source"), F.array(F.lit("AI_APPLIED")).alias("flags")).cast(token))
    return d.withColumn("tokens", F.when(F.col("mark").isNotNull(), F.concat("tokens", added)).otherwise(F.col("tokens"))).withColumn("closed", F.col("mark").isNotNull()).drop("mark")


def recase_after(cues: DataFrame) -> DataFrame:
    """The first word after a line that was ``closed`` in the case that the new mark asks for, but for names and decided words; ``recased`` says where."""
    last = F.substr(F.trim(_last_visible(F.col("tokens"))["zh"]), F.lit(-1))
    d = cues.withColumn("_mark", F.when(F.col("closed"), last)).withColumn("_before", F.lag("_mark").over(_in_file())).withColumn("_first", _first_word(F.col("tokens")))
    upper = F.when(F.col("_before").isin(*R.CASE_UPPER), True).when(F.col("_before").isin(*R.CASE_LOWER), False)
    free = ~F.arrays_overlap(F.coalesce("_first.t.flags", F.array().cast("array<string>")), F.array(F.lit("NAME"), F.lit("AI_APPLIED"))) & (F.coalesce("_first.t.pinyin", F.lit("")) != "")
    after = with_case(F.col("_first.t.pinyin"), upper)
    d = d.withColumn("_after", after).withColumn("recased", F.coalesce(upper.isNotNull() & free & (F.col("_after") != F.col("_first.t.pinyin")), F.lit(False)))
    return d.withColumn("tokens", _replaced(F.col("tokens"), F.col("_first.at"), F.col("recased"), F.col("_after"))).drop("_mark", "_before", "_first", "_after")


def proofread(cues: DataFrame, cache: DataFrame, call: names.Provider = names.null_provider, model: str = "none") -> tuple[DataFrame, DataFrame]:
    """Case, then end marks, then the case after them: (cues, proposals).

    All open cues are asked for.  Case changes pinyin and flags alone, so both kinds of items come from one view of the
    cues as they came; items and answers are written and looked at before they meet the cues, by document, place and content.
    """
    cues = cues.withColumn("_content", F.xxhash64("tokens"))
    viewed = shared.written(_viewed(cues, "_content"), "viewed")
    keys = ["doc_id", "pos", "_content"]

    def judged(items: DataFrame, task: str, judge, *columns: str) -> DataFrame:
        done = judge(names.answered(shared.written(items, "items"), cache, task, model, call)).select(*keys, *columns, "status", "cached")
        return relational.small(shared.written(done, "judged"))

    cased = judged(_case_items(viewed, "_content"), "T3", judge_case, "at", "after")
    cues = apply_case(cues, cased, keys)
    ended = judged(_end_items(viewed, "_content"), "T4", judge_ends, "mark")
    shape = ["doc_id", "pos", "status", "cached"]
    proposals = cased.select(F.lit("T3").alias("task"), *shape).unionByName(ended.select(F.lit("T4").alias("task"), *shape))
    return recase_after(apply_ends(cues, ended, keys).drop("_content")), proposals


def edited_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chinese and Vietnamese files (doc_id, text) straight from edited rows (doc_id, pos, start, end, zh, pinyin, vi).

    Nothing is cut anew: what somebody typed stays.  Rows with neither line go, the others
    are numbered from 1 in both files.  A row without a time is an error, as is a document
    of nothing but empty rows.
    """
    if rows.where("start is null or end is null").limit(1).count():
        raise ValueError("a row has no time")
    d = rows.select("doc_id", "pos", "start", "end", *[text.clean_line(F.coalesce(c, F.lit(""))).alias(c) for c in ("zh", "pinyin", "vi")])
    kept = d.where("zh <> '' or pinyin <> ''")
    if d.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").limit(1).count():
        raise ValueError("a document has no line left")
    kept = kept.withColumn("number", F.row_number().over(_in_file())).withColumn("stamp", F.concat(text.format_stamp(F.col("start")), F.lit(" --> "), text.format_stamp(F.col("end"))))

    def file(*lines: Column) -> DataFrame:
        part = F.concat_ws("\n", F.col("number").cast("string"), "stamp", *lines, F.lit("\n"))
        return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"]), "").alias("text"))

    return file(F.col("zh"), F.col("pinyin")), file(text.vi_line(F.col("vi"), F.col("zh")))
