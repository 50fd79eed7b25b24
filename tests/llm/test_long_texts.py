"""Texts of megabytes, with spaces and without, through the operators on whole texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from subtide.llm import bagminhash, common, gru_lm, language_crf, mixing, packing, quality_qda, quality_rules, substring_dedup


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    return " ".join(rng.choice(words) for _ in range(n))


LONG, OTHER, SOLID = prose(1, 400_000), prose(2, 300_000), "".join(random.Random(3).choices("abcdefgh", k=1_500_000))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    common.ship(spark)
    rows = [(1, LONG, "a"), (2, OTHER, "b"), (3, SOLID, "a"), (4, LONG, "b")] + [(10 + i, prose(100 + i, 60), "a") for i in range(40)]
    path = str(tmp_path_factory.mktemp("long") / "t.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("xx")).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))


def test_scores(docs, labels):
    got = {r.doc_id: r for r in quality_qda.classify(docs, labels).collect()}
    assert len(got) == 44 and all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[4].score
    kept = {r.doc_id: r for r in quality_rules.rules(docs, quality_rules.train(docs, labels)).collect()}
    assert (kept[1].n_words, kept[2].n_words, kept[3].n_words, kept[3].word_chars) == (400_000, 300_000, 1, 1_500_000) and kept[3].base_failed
    lang = {r.doc_id: r.lang_pred for r in language_crf.classify(docs).collect()}
    assert set(lang.values()) == {"xx"} and len(lang) == 44


def test_copies(docs):
    got = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(LONG), len(LONG), 1, empty) for i in (1, 4))
    assert (got[3].n_removed, got[3].kept_sha256) == (0, hashlib.sha256(SOLID.encode()).hexdigest())
    near = {r["doc_id"]: r for r in (x.asDict() for x in bagminhash.near_duplicates(docs).collect())}
    one = [k for k in next(iter(near.values())) if "component" in k or "class" in k or "group" in k][0]
    assert near[1][one] == near[4][one] != near[2][one]


def test_words_and_tokens(docs):
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert (taken[1].size, taken[3].size) == (400_000, 1) and all(r.taken <= 2 * r.size for r in taken.values())
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.max("length").alias("most")).collect()
    assert len(pieces) == 44 and all(r.n == r["all"] and r.most <= 2048 for r in pieces)


def test_language_model(docs):
    some = docs.where("doc_id >= 10").union(docs.where("doc_id = 3")).union(docs.where("doc_id = 2").withColumn("text", F.substring("text", 1, 1_000_000)))
    got = {r.doc_id: r for r in gru_lm.score(some).collect()}
    assert len(got) == 42 and got[3].n_tokens == 2 and got[2].n_tokens > 150_000 and all(r.score < 0 for r in got.values())
