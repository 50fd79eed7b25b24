"""Names and open readings through a provider, and translation: propose, verify, cache.

A provider is a Python callable over a batch; the defaults answer nothing, the same way
each time, so every pass runs offline.  Providers see only what the cache has not.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide import shared
from subtide.functions import text
from subtide.operators import matching, readings, relational
from subtide.session import ship

#: Misses that are numbered together, on average.
GROUP = 100_000

Provider = Callable[[str, list[dict]], list[dict]]  # (task, items) -> answers with their ids


def null_provider(task: str, items: list[dict]) -> list[dict]:
    return []


def echo_translator(task: str, items: list[dict]) -> list[dict]:
    """Marks each line, so that the path can be followed."""
    return [{"id": x["id"], "text": f"[{x['text']}]"} for x in items]


REGISTRY: dict[str, Provider] = {"null": null_provider, "echo": echo_translator}


def provider(name: str | None) -> Provider:
    """A registered provider; unknown and missing names give the one that answers nothing."""
    return REGISTRY.get(name or "null", null_provider)


def ask(items: DataFrame, task: str, call: Provider, retries: int = 1) -> DataFrame:
    """Answers (id, answer JSON) to items (id, batch, payload): a call for each batch, what is missing once more; unknown ids go."""
    ship(items.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {int(i): {"id": int(i), **json.loads(p)} for i, p in zip(pdf["id"], pdf["payload"], strict=True)}
        got: dict[int, str] = {}
        for _ in range(retries + 1):
            if not left:
                break
            for a in call(task, list(left.values())) or []:
                key = a.get("id") if isinstance(a, Mapping) else None
                if key in left and key not in got:
                    got[key] = json.dumps({k: v for k, v in a.items() if k != "id"}, ensure_ascii=False, sort_keys=True)
            left = {k: v for k, v in left.items() if k not in got}
        return pd.DataFrame({"id": pd.Series(list(got), dtype="int64"), "answer": pd.Series(list(got.values()), dtype=object)})

    return items.groupBy("batch").applyInPandas(lambda pdf: one(pdf), "id long, answer string")


def cached_answers(items: DataFrame, cache: DataFrame, task: str, model: str, call: Provider, size: int = 25) -> DataFrame:
    """Items (id, payload) with answers from the cache or else the provider: id, key, answer, cached."""
    keyed = items.withColumn("key", text.cache_key(F.lit(task).alias("task"), F.lit(model).alias("model"), F.col("payload")))
    known, misses = relational.cache_split(keyed, cache.where((F.col("task") == task) & (F.col("model") == model)).select("key", F.col("value").alias("answer")))
    groups = max(64, -(-misses.count() // GROUP))  # batches are numbered within groups of bounded size
    dealt = misses.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    asked = ask(relational.batches(dealt, ["_g"], ["id"], size).withColumn("batch", F.concat_ws(":", "_g", "batch")), task, call)
    fresh = misses.join(asked, "id").select("id", "key", "answer", F.lit(False).alias("cached"))
    return known.select("id", "key", "answer", F.lit(True).alias("cached")).unionByName(fresh)


def detect_names(texts: DataFrame, proposals: DataFrame, known: Mapping[str, Sequence[str]] | DataFrame | None = None) -> DataFrame:
    """Proposed names (han, split, pinyin, type) that stand in the transcript, re-spell themselves and can be read so, with their counts.

    ``known`` has readings (zh, pinyin), as a table or a map; what it can't judge can be read so.
    """
    part = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    found = proposals.dropDuplicates(["han"]).drop("count").where((F.size(part("split")) == F.size(part("pinyin"))) & (F.array_join(part("split"), "") == F.col("han")))
    if isinstance(known, Mapping):
        known = texts.sparkSession.createDataFrame([(zh, r) for zh, rs in known.items() for r in rs], "zh string, pinyin string") if known else None
    if known is not None:
        pieces = found.select("han", F.explode(F.arrays_zip(F.col("split").alias("zh"), F.col("pinyin").alias("py"))).alias("p")).select("han", "p.zh", "p.py")
        found = found.join(readings.fits(pieces, known, "zh", "py").where("not fits").select("han").distinct(), "han", "left_anti")
    counts = matching.counts(found, texts, "han").select(F.col("name").alias("han"), F.col("n").alias("count"))
    return found.join(counts, "han").orderBy(F.col("count").desc(), "han")


def merge_names(existing: DataFrame, found: DataFrame, ai_overrides: bool = False) -> DataFrame:
    """The name table with new entries; a translation that somebody wrote stays."""
    return relational.upsert(existing, found, "han", ["split", "pinyin", "type", "count", "vi"], ai_overrides, always=("vi",)).orderBy(F.col("count").desc_nulls_last(), "han")


def accept_readings(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Proposals (id, zh, before, options, answer): accepted only if the answer is one of the options."""
    both = items.join(answers, "id", "left").withColumn("after", F.get_json_object("answer", "$.pinyin"))
    ok = F.array_contains("options", F.col("after"))
    return both.withColumn("status", F.when(F.col("after").isNull(), "unanswered").when(ok & (F.col("after") == F.col("before")), "same").when(ok, "accepted").otherwise("rejected"))


def reading_options(zh: str, known: Mapping[str, Sequence[str]], most: int = 8) -> list[str]:
    """The default spelling first, then products of the characters' readings."""
    out = [""]
    for c in zh:
        out = [p + r for p in out for r in known.get(c, [c])][: 4 * most]
    return list(dict.fromkeys(out))[:most]


def answered(items: DataFrame, cache: DataFrame, task: str, model: str, call: Provider, size: int = 25) -> DataFrame:
    """Items (payload and other columns) with ``answer`` and ``cached``: null where nobody answers.

    Items of one payload share an answer.  Distinct payloads are numbered in a written table,
    so each has a number of its own, whatever is computed again.
    """
    asked = shared.written(items.select("payload").distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    got = cached_answers(asked, cache, task, model, call, size).join(asked, "id").select("payload", "answer", "cached")
    return items.join(got, "payload", "left")


def translate(cues: DataFrame, cache: DataFrame, call: Provider = null_provider, model: str = "none", size: int = 25, span: int = 5, target: str = "vi") -> DataFrame:
    """doc_id, pos, line, source (cache, provider or kept) for cues (doc_id, pos, zh), with the lines before as context."""
    from subtide.operators import sequence

    d = sequence.neighbours(cues, ["doc_id"], ["pos"], "zh", span)
    d = d.withColumn("payload", F.to_json(F.struct(F.col("zh").alias("text"), F.col("context_before").alias("before"), F.lit(target).alias("target"))))
    line = F.nullif(F.trim(F.get_json_object("answer", "$.text")), F.lit(""))
    out = answered(d, cache, "translate", model, call, size).withColumn("line", line)
    source = F.when(F.col("line").isNull(), "kept").when(F.col("cached"), "cache").otherwise("provider")
    return out.select("doc_id", "pos", F.coalesce("line", "zh").alias("line"), source.alias("source"))


def translation_counts(lines: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("source") == s)
    return lines.groupBy("doc_id").agg(F.count("*").alias("cues"), (n("cache") + n("provider")).alias("translated"), n("kept").alias("kept_original"), n("cache").alias("from_cache"))


