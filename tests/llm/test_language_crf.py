"""The language field against enumeration, held-out documents, code-switched text and odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.llm import common, language_crf

PARTS = {"aa": ["ba", "na", "ka", "lo"], "bb": ["ße", "ön", "ich", "und"], "cc": ["ción", "os", "ie", "que"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))).capitalize() for _ in range(n))


@pytest.fixture(scope="module")
def model_and_docs(spark):
    common.ship(spark)
    rng = random.Random(5)
    rows = [(i, text(rng, lang, rng.randint(5, 200)), lang) for i in range(240) for lang in [rng.choice(list(PARTS))]]
    rows += [(1000 + i, text(rng, "aa", 20), None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("worded", F.lit(1))
    return language_crf.train(docs), docs, rows


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    n, t = 3, 5
    e, moves, start = rng.standard_normal((2, t, n)), rng.standard_normal((n, n)), rng.standard_normal(n)
    p, pairs, z = language_crf.sequences(e, moves, start)
    want, want_pairs, total = np.zeros_like(e), np.zeros((n, n)), 0.0
    for b in range(2):
        paths = list(itertools.product(range(n), repeat=t))
        w = np.exp([start[y[0]] + sum(e[b, k, y[k]] for k in range(t)) + sum(moves[y[k], y[k + 1]] for k in range(t - 1)) for y in paths])
        total += np.log(w.sum())
        for y, x in zip(paths, w / w.sum(), strict=True):
            for k in range(t):
                want[b, k, y[k]] += x
                if k:
                    want_pairs[y[k - 1], y[k]] += x
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and z == pytest.approx(total)


def test_chunks_equal_one_chain():
    rng = np.random.default_rng(1)
    n, sizes = 4, [1, 0, 31, 32, 33, 400, 64, 0, 7]
    first = np.concatenate(([0], np.cumsum(sizes)))
    e = (3 * rng.standard_normal((first[-1], n))).astype(np.float32)
    moves, start = rng.standard_normal((n, n)).astype(np.float32), rng.standard_normal(n).astype(np.float32)
    got = language_crf.marginals(e, first, moves, start)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            assert np.allclose(got[a:b], language_crf.sequences(e[None, a:b].astype(float), moves, start)[0][0], atol=1e-5)


def test_held_out_documents(model_and_docs):
    model, docs, rows = model_and_docs
    got = {r.doc_id: r for r in language_crf.classify(docs, model).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [r for r in rows if r[2] and got[r[0]].held_out]
    assert held and all(got[d].lang_pred == lang and 0.5 < got[d].score <= 1 for d, _, lang in held)
    assert all(got[d].lang_pred == "aa" for d, _, lang in rows if lang is None)


def test_learning_ignores_held_out_labels(spark, model_and_docs):
    model, docs, _ = model_and_docs
    wrong = docs.withColumn("lang", F.when(language_crf.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    other = language_crf.train(wrong)
    assert other.langs == model.langs and np.array_equal(other.grams, model.grams) and np.array_equal(other.odds, model.odds)


def test_code_switched_runs(spark, model_and_docs):
    model, _, _ = model_and_docs
    rng = random.Random(9)
    want = [("aa", 30), ("bb", 12), ("aa", 9), ("cc", 40)]
    d = spark.createDataFrame([(1, "\n".join(text(rng, lang, n) for lang, n in want)), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in language_crf.runs(d, model).collect())
    assert [(r[3], r[2]) for r in got] == want and [r[1] for r in got] == [0, 30, 42, 51] and {r[0] for r in got} == {1}


def test_odd_rows(spark, model_and_docs):
    model, _, _ = model_and_docs
    rng = random.Random(2)
    long = text(rng, "bb", 120_000)
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, "12 -- 3.4!"), (4, "好"), (5, "banana"), (5, "banana"), (6, long), (7, "k" * 300_000), (8, "lo 77 !!")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_crf.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    by = {d: (lang, score) for d, lang, score in got}
    assert len(got) == len(rows) and all(by[d] == ("und", 0.0) for d in (None, 1, 2, 3))
    assert by[4][0] in model.langs and by[5][0] == by[8][0] == "aa" and by[6][0] == "bb" and by[7][0] in model.langs


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert language_crf.classify(spark.createDataFrame([], schema)).collect() == []
    got = language_crf.classify(spark.createDataFrame([(1, "some words", None), (2, None, "aa")], schema)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = language_crf.classify(spark.createDataFrame([(i, "some words", "aa") for i in range(8)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("aa", 1.0)}


def test_lexicon_has_the_most_frequent_words(spark, model_and_docs):
    from collections import Counter

    _, docs, rows = model_and_docs
    count = Counter(w for d, x, lang in rows if lang and zlib.crc32(str(d).encode()) % 4 != 2 for w in x.lower().split())
    for most in (0, 1, 10, 200, 1 << 16):
        least = min((n for n in count.values() if sum(m >= n for m in count.values()) <= most), default=1 << 62)
        assert len(language_crf.train(docs, lexicon=most, sample=5).known) == sum(n >= least for n in count.values()) <= most
    big = spark.createDataFrame([(i, n) for i, n in enumerate([3, 4096, 5000, 5001, 9000, 10**9])], "word long, all long")
    assert [big.where(F.col("all") >= language_crf._least(big, k)).count() for k in range(7)] == [0, 1, 2, 2, 4, 5, 6]
