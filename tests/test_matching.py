"""Names found in texts, against a plain search for each name in each text."""

import random

import numpy as np
import pytest

from subtide.operators import matching, relational


def plain(names, texts):
    out = {}
    for n in {n for n in names if n}:
        hits = [t.count(n) for t in texts if t]
        if sum(hits):
            out[n] = (sum(hits), sum(h > 0 for h in hits))
    return out


def rows(spark, names, texts, **options):
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")
    return n, t


@pytest.mark.parametrize("alphabet, longest", [("ab", 12), ("ab中é", 20), ("abc d", 40)])
def test_counts_equal_plain_search(spark, alphabet, longest):
    rng = random.Random(len(alphabet))
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [word(rng.randint(0, 300)) for _ in range(60)] + [None, "", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3]
    names = [word(rng.randint(1, longest)) for _ in range(150)] + [t[3 : 3 + k] for t in texts[:60] for k in (1, 7, 8, 9, 16, 17, 60)] + [None, "", "aa", "a" * 9, "a" * 20, "a\nb", texts[0], texts[0]]
    n, t = rows(spark, names, texts)
    got = {r["name"]: (r["n"], r["n_texts"]) for r in matching.counts(n, t).collect()}
    assert got == plain(names, texts)
    assert {r["name"]: (r["n"], r["n_texts"]) for r in matching.counts(n, t, limit=500).collect()} == got  # in many blocks
    assert {r["name"] for r in relational.verified_names(n, t, "name").collect()} == set(got)


def test_matches_say_where(spark):
    texts, names = ["中文 banana", "ananas ßß", None], ["ana", "ß", "中", "文 ban"]
    n, t = rows(spark, names, texts)
    got = sorted((r["id"], r["name"], r["at"], r["counted"]) for r in matching.matches(n, t, ["id"]).collect())
    assert got == [(0, "ana", 4, True), (0, "ana", 6, False), (0, "中", 0, True), (0, "文 ban", 1, True), (1, "ana", 0, True), (1, "ana", 2, False), (1, "ß", 7, True), (1, "ß", 8, True)]
    assert matching.counts(n.limit(0), t).count() == 0 and matching.counts(n, t.limit(0)).count() == 0 and matching.matches(n.limit(0), t, ["id"]).count() == 0


def test_two_hundred_thousand_names(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda k: "".join(rng.choice(letters, k))
    names = list({word(k) for k in rng.integers(5, 14, 200_000)})
    texts = [" ".join(names[i] if rng.random() < 0.1 else word(6) for i in rng.integers(0, len(names), 200)) for _ in range(50)]
    n, t = rows(spark, names, texts)
    got = {r["name"]: r["n"] for r in matching.counts(n, t).collect()}
    whole, want = "\n".join(texts), {}
    for k in range(5, 14):
        known = {x for x in names if len(x) == k}
        for i in range(len(whole) - k + 1):
            if whole[i : i + k] in known:
                want[whole[i : i + k]] = 0
    assert got == {x: sum(s.count(x) for s in texts) for x in want}
    plan = matching.counts(n, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_queries_have_no_nested_loop(spark, sf_dir):
    from subtide.plans import catalogue, files  # noqa: F401

    for q in ("name_counts", "transcript_semi", "detected_names"):
        plan = catalogue.QUERIES[q](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, q
