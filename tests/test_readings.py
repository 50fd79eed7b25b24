"""Syllables and readings: the automaton and the lattice against plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from subtide.functions import lang, syllables
from subtide.operators import readings


def test_automaton_equals_the_pattern():
    words = ["a", "ab", "ba", "bab", "bba"]
    moves, accepts = syllables.automaton(words, "ab")
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        state = syllables.START
        for c in w:
            state = moves[state * 2 + "ab".index(c)]
        assert accepts[state] == bool(re.fullmatch("(?:" + "|".join(words) + ")+", w)), w


def test_syllabic_words(spark):
    rng = random.Random(2)
    known = sorted(syllables.spellings())
    words = ["".join(rng.choice(known) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    words += ["".join(rng.choice("abcdeghinorstuüz") for _ in range(rng.randint(1, 8))) for _ in range(500)] + ["", "é", "x", "v"]
    pattern = re.compile("(?:" + "|".join(sorted(known, key=len, reverse=True)) + ")+")
    got = {r["w"]: r["y"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", syllables.is_syllabic(F.col("w")).alias("y")).collect()}
    assert got == {w: bool(pattern.fullmatch(w)) for w in words}


def test_lines_agree_with_the_function_of_one_line(spark):
    lines = ["Nǐ hǎo ma?", "Xin chào các bạn", "lǜsè de", "nǚ'ér", "Wǒ bú shì", "Zhège hǎowánr", "ň", "Không", "", "...", "the thing", "shan he an"]
    got = {r["w"]: r["y"] for r in spark.createDataFrame([(w,) for w in lines], "w string").select("w", syllables.looks_like_pinyin(F.col("w")).alias("y")).collect()}
    assert got == {w: bool(lang._words(w)) and lang.looks_like_pinyin(w) for w in lines}


READ = {"好": ["hǎo", "hào"], "长": ["cháng", "zhǎng"], "大": ["dà", "dài"], "儿": ["ér"], "哪": ["nǎ", "něi"], "西": ["xī"], "安": ["ān"]}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(c, r, i) for c, rs in READ.items() for i, r in enumerate(rs)] + [("大夫", "dàifu", 0), ("大大", None, 0)], "zh string, pinyin string, rank int")


def test_lattice_equals_one_by_one(spark, table):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        zh = "".join(rng.choice(list(READ)) for _ in range(rng.randint(1, 5)))
        py = "".join(rng.choice(READ[c]) for c in zh)
        py = py[:-2] + "r" if zh.endswith("儿") and rng.random() < 0.5 else py
        rows.append((zh, py if rng.random() < 0.6 else py[: rng.randint(0, len(py))] + rng.choice(["a", "g", "n", ""])))
    rows += [("大夫", "dàifu"), ("大夫", "dàfū"), ("好", None), (None, "hǎo"), ("ok", "nǐ"), ("夫", "x"), ("西安", "xi'ān"), ("儿", "r"), ("", "a"), ("好", "hǎo"), ("好", "hǎo")]
    got = readings.fits(spark.createDataFrame(rows, "zh string, pinyin string").withColumn("k", F.lit(1)), table).collect()
    assert len(got) == len(rows) and sorted(map(repr, ((r["zh"], r["pinyin"]) for r in got))) == sorted(map(repr, rows))
    for r in got:
        want = True if not r["zh"] or not r["pinyin"] else (r["zh"], r["pinyin"]) == ("大夫", "dàifu") or lang.fits_reading(r["zh"], r["pinyin"], READ)
        assert r["fits"] == want, r


def test_first_readings(spark, table):
    d = spark.createDataFrame([(1, "大夫"), (2, "长大"), (3, "ok"), (4, "西夫"), (5, None)], "k int, zh string")
    assert {r["k"]: r["pinyin"] for r in readings.first_readings(d, table, ["k"]).collect()} == {1: "dàifu", 2: "chángdà", 3: "ok", 4: "xī夫", 5: None}


def test_names_must_be_readable(spark, table):
    from subtide.plans import names

    texts = spark.createDataFrame([("长大西安好好",), ("西安",), (None,)], "text string")
    rows = [("西安", ["西", "安"], ["Xī", "ān"]), ("长大", ["长大"], ["Zhǎngdà"]), ("好好", ["好", "好"], ["hǎo", "hā"]), ("大西", ["大"], ["dà"]), ("安好", None, None), ("大", ["大"], []), ("夫", ["夫"], ["x"]), ("西安", ["西安"], ["x"])]
    d = spark.createDataFrame(rows[:-1], "han string, split array<string>, pinyin array<string>")
    assert [(r["han"], r["count"]) for r in names.detect_names(texts, d, READ).collect()] == [("西安", 2), ("长大", 1)]
    assert [(r["han"], r["count"]) for r in names.detect_names(texts, d, table).collect()] == [("西安", 2), ("长大", 1)]
    assert [r["han"] for r in names.detect_names(texts, d).collect()] == ["西安", "好好", "长大"]
