"""Streams that stop and start again from their checkpoint, with late rows, against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from subtide.functions import lang
from subtide.functions.lexing import Token
from subtide.operators import sequence
from subtide.streaming import live

START = datetime(2024, 1, 1)


def shuffled(rows, rng, most=30):
    """Rows (key, seconds, ...) in the order in which they come: up to ``most`` seconds late."""
    return [r for _, r in sorted(((r[1] + rng.uniform(0, most), r) for r in rows), key=lambda x: x[0])]


def feed(spark, folder, rows, schema, files):
    """The rows in so many files, which a stream reads one after another."""
    step = -(-len(rows) // files)
    made = [(r[0], START + timedelta(seconds=r[1]), *r[2:]) for r in rows]
    for i in range(files):
        spark.createDataFrame(made[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def run_in_three(spark, tmp_path, rows, schema, make, flush):
    """All that comes out of a query that is stopped twice."""
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    third = -(-len(rows) // 3)
    for i in range(3):
        feed(spark, str(source), rows[i * third : (i + 1) * third], schema, 4) if i == 0 else feed(spark, str(source / f"more{i}"), rows[i * third : (i + 1) * third], schema, 4)
        if i == 2:
            feed(spark, str(source / "end"), flush, schema, 1)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(source))
        q = make(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", check).option("path", out).start()
        q.processAllAvailable()
        q.stop()
    return spark.read.parquet(out)


@pytest.fixture
def segments():
    rng = random.Random(4)
    rows, n = [], 0
    for key in ("a", "b", "c"):
        for t in range(0, 400, 3):
            n += 1
            rows.append((key, float(t) if t % 2 else float(t - t % 6), n, rng.choice(["x", "x", "y", "", None])))
    return shuffled(rows, rng)


def test_repeats_equal_the_batch_result(spark, tmp_path, segments):
    schema = "key string, at timestamp, id long, text string"
    got = run_in_three(spark, tmp_path, segments, schema, lambda s: live.drop_repeats(s, "key", "at", late="45 seconds"), [("end", 5000.0, 0, "z")])
    d = spark.createDataFrame([(r[0], START + timedelta(seconds=r[1]), *r[2:]) for r in segments], schema)
    same = (F.lag("text").over(Window.partitionBy("key").orderBy("at", "id")) == F.col("text")) & (F.col("text") != "")
    want = sequence.repeat_trim(d, ["key"], ["at", "id"], same, 2)
    rows = lambda x: sorted(map(repr, ((r["key"], r["at"], r["id"], r["text"], r["repeat_no"]) for r in x.collect())))
    assert rows(got.where("key <> 'end'")) == rows(want)
    assert len(rows(want)) < len(segments)


def test_late_casing_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    kinds = [("word", "我", "wǒ"), ("word", "你", "nǐ"), ("punct", "。", None), ("punct", "，", None), ("marker", "-", None), ("punct", "……", None)]
    rows = shuffled([(k, float(t), t, *rng.choice(kinds)) for k in ("a", "b") for t in range(120)], rng, 20)
    schema = "key string, at timestamp, id long, kind string, zh string, pinyin string"
    got = run_in_three(spark, tmp_path, rows, schema, lambda s: live.live_casing_in_order(s, "key", "at", late="30 seconds"), [("end", 5000.0, 0, "word", "z", "z")])
    want = []
    for k in ("a", "b"):
        state = "upper"
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want.append((k, r[2], lang.cased(Token(*r[3:]), state, False, False).pinyin))
            state = lang.case_event(*r[3:]) or state
    assert sorted(map(repr, ((r["key"], r["id"], r["pinyin"]) for r in got.where("key <> 'end'").collect()))) == sorted(map(repr, want))


def test_cues_by_silence_close_with_late_words(spark, tmp_path):
    rng = random.Random(6)
    rows, at = [], 0.0
    for i in range(150):
        at += rng.choice([1.0, 2.0, 12.0])
        rows.append(("a", at, f"w{i} "))
    schema = "key string, at timestamp, word string"
    got = run_in_three(spark, tmp_path, shuffled(rows, rng, 8), schema, lambda s: live.silence_cues(s, "key", "at", "5 seconds", "20 seconds"), [("end", 9000.0, "z"), ("end", 9900.0, "z")])
    cues, last = [], None
    for _, t, w in rows:
        if last is None or t - last > 5:
            cues.append("")
        cues[-1] += w
        last = t
    assert sorted(r["text"] for r in got.where("key = 'a'").collect()) == sorted(cues)
