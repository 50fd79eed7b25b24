"""Operators against simulators and DuckDB."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from subtide import resources as R
from subtide.functions import text
from subtide.operators import relational, sequence
from subtide.plans import catalogue, chinese, files, fix, names  # noqa: F401  (both add queries to the catalogue)
from subtide.sources import srt


def packed(ws, cfg):
    """Cue packing, step by step."""
    han, dense = (lambda s: len(re.findall(R.HAN_TOKEN, s))), (lambda s: len("".join(s.split())))

    def kind(t, after):
        k = ""
        for i, c in enumerate(t):
            if c in ".," and i and t[i - 1].isdigit() and (rest := t[i + 1 :] or after.lstrip()) and rest[0].isdigit():
                continue
            if c in R.ENDERS:
                return "end"
            k = "pause" if c in R.PAUSES else k
        return k

    out, b = [], []
    for i, w in enumerate(ws):
        b.append(w)
        n = ws[i + 1] if i + 1 < len(ws) else None
        reason = "eof" if n is None else ""
        if n and not (n[0].strip() and all(c in R.TRAILING_MARKS for c in n[0].strip())):
            k, h = kind(w[0], n[0]), sum(han(x[0]) for x in b)
            over = h + han(n[0]) > cfg["max_chars"] or sum(dense(x[0]) for x in b) + dense(n[0]) > 2 * cfg["max_chars"] or n[2] - b[0][1] > cfg["max_duration"]
            reason = "end" if k == "end" else "pause" if k == "pause" and h >= cfg["comma_min"] else "silence" if n[1] - w[2] > cfg["silence"] else "limit" if over else ""
        if reason:
            out.append((min(x[1] for x in b), max(x[2] for x in b), " ".join("".join(x[0] for x in b).split()), reason, len(b)))
            b = []
    return [x for x in out if x[2]]


def test_cue_packing(spark):
    rng, docs = random.Random(4), {}
    for d in range(60):
        t, ws = 0.0, []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(["你", "好啊", "我们走", "，", "。", "OK", "3.", "5", "真的，", "……", " bye", "1,", "200", "长长的话"])
            s = round(t + rng.choice([0.0, 0.0, 0.1, 0.5 if d % 2 else 0.05]), 2)
            t = round(s + rng.choice([0.0, 0.2, 0.4, 1.2]), 2)
            ws.append((w, s, t))
        docs[d] = ws
    rows = [(d, k, *w) for d, ws in docs.items() for k, w in enumerate(ws)]
    got = sequence.cue_pack(spark.createDataFrame(rows, "d int, k int, word string, start double, end double"), ["d"], ["k"]).toPandas()
    for d, ws in docs.items():
        mine = got[got.d == d].sort_values("index")[["start", "end", "text", "reason", "n_words"]]
        assert [tuple(x) for x in mine.itertuples(index=False)] == packed(ws, R.CUE)
    assert {"end", "pause", "silence", "limit", "eof"} <= set(got.reason)


def test_timing(spark):
    rng = random.Random(5)
    rows = [(d, k, float(k) + rng.choice([-0.4, 0, 0.0004]), float(k) + rng.choice([-0.5, 0.1, 1.3])) for d in range(20) for k in range(15)]
    got = sequence.enforce_timing(spark.createDataFrame(rows, "d int, k int, start double, end double"), ["d"], ["k"], {"min_gap": 0.04}).toPandas()
    for d in range(20):
        cues, before, want = [r[2:] for r in rows if r[0] == d], None, []
        for i, (a, b) in enumerate(cues):
            a = max(a, before + 0.04) if before is not None else a
            b = max(a, b)
            w = max(b, a + 0.25)
            w = min(w, max(b, cues[i + 1][0] - 0.04)) if i + 1 < len(cues) else w
            b = round(max(w, a + 0.01), 3)
            a = round(a, 3)
            before = b if b > a else round(a + 0.01, 3)
            want.append((a, before))
        mine = got[got.d == d].sort_values("index")
        assert all(abs(x - y) < 1e-9 for g, w in zip(zip(mine.start, mine.end), want, strict=True) for x, y in zip(g, w, strict=True))


def test_stamps(spark):
    d = spark.createDataFrame([(1.58,), (0.0005,), (0.0015,), (-3.0,), (float("nan"),), (3723.4567,)], "s double")
    assert [r[0] for r in d.select(text.format_stamp(F.col("s"))).collect()] == ["00:00:01,580", "00:00:00,000", "00:00:00,002", "00:00:00,000", "00:00:00,000", "01:02:03,457"]
    p = spark.createDataFrame([("00:00:01,58 --> 0:00:02.5",), ("x",)], "l string").select(text.parse_stamp(F.col("l"), loose=True).alias("t")).collect()
    assert tuple(p[0]["t"]) == (1.58, 2.5) and p[1]["t"] is None


def test_repeats_and_nulls(spark):
    s = spark.createDataFrame([("a", i, t) for i, t in enumerate(["好的。", "好的，", "好的", "好的！", None, "", "走吧", "走吧"])], "doc_id string, id int, text string")
    assert [r["id"] for r in fix.drop_repeats(s).orderBy("id").collect()] == [0, 1, 4, 5, 6, 7]


def test_segments_with_aliases(spark):
    rows = [("a", json.dumps({"segments": [{"text": "好", "start": 1, "end": 0.5, "words": [{"w": "好", "t0": 1, "t1": 2, "p": 0.5}]}]})), ("b", json.dumps([{"text": "x", "begin": 2}])), ("c", "{broken")]
    got = {r["doc_id"]: r for r in srt.segments(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["end"] == 1.0 and got["a"]["words"][0]["end"] == 2.0 and got["b"]["words"] == []


def test_name_tables(spark):
    rows = [("a", '{"谈胥": "Tán Xū"}'), ("b", '{"names": [{"han": "李四", "split": ["李", "四"], "pinyin": ["Lǐ", "Sì"], "count": 3}]}'), ("c", "{bad")]
    got = {r["doc_id"]: r for r in srt.names(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["a"]["pinyin"] == ["Tán", "Xū"] and got["b"]["split"] == ["李", "四"] and got["c"]["corrupt"] and not got["b"]["corrupt"]


def test_decoding():
    assert srt.decode_bytes("好\r\n".encode("gb18030")) == "好\n" and srt.decode_bytes("好".encode("utf-16")) == "好" and srt.decode_bytes(b"\xef\xbb\xbfa") == "a" and srt.decode_bytes(None) == ""


def test_providers_answer_only_what_was_asked(spark):
    def call(task, items):
        return [{"id": x["id"], "text": "ok"} for x in items if x["id"] % 2] + [{"id": 999, "text": "no"}]

    items = spark.createDataFrame([(i, f'{{"text": "{i}"}}') for i in range(6)], "id long, payload string")
    cache = spark.createDataFrame([], "task string, model string, key string, value string")
    got = {r["id"] for r in names.cached_answers(items, cache, "t", "m", call).collect()}
    assert got == {1, 3, 5}


def test_translation_keeps_what_nobody_translates(spark):
    cues = spark.createDataFrame([("a", 0, "好"), ("a", 1, "走")], "doc_id string, pos int, zh string")
    cache = spark.createDataFrame([], "task string, model string, key string, value string")
    kept = names.translate(cues, cache)
    assert {(r["line"], r["source"]) for r in kept.collect()} == {("好", "kept"), ("走", "kept")}
    done = names.translate(cues, cache, names.echo_translator)
    assert {(r["line"], r["source"]) for r in done.collect()} == {("[好]", "provider"), ("[走]", "provider")}


def test_names_are_verified(spark):
    texts = spark.createDataFrame([("谈胥 来 了 谈胥",)], "text string").select(F.regexp_replace("text", " ", "").alias("text"))
    rows = [("谈胥", ["谈", "胥"], ["Tán", "Xū"]), ("李四", ["李四"], ["Lǐsì"]), ("来了", ["来"], ["lái"])]
    got = names.detect_names(texts, spark.createDataFrame(rows, "han string, split array<string>, pinyin array<string>")).collect()
    assert [(r["han"], r["count"]) for r in got] == [("谈胥", 2)]
    assert names.reading_options("好", {"好": ["hǎo", "hào"]}) == ["hǎo", "hào"]


def test_batch_and_stream_agree(spark, tmp_path):
    from subtide.streaming import live

    rows = [("a", i, k, z, p) for i, (k, z, p) in enumerate([("word", "我", "wǒ"), ("punct", "。", None), ("word", "你", "nǐ"), ("word", "好", "Hǎo")])]
    schema = "doc_id string, at long, kind string, zh string, pinyin string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = live.live_casing(stream).writeStream.format("memory").queryName("cased").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["pinyin"] for r in spark.sql("select * from cased order by at").collect()] == ["Wǒ", None, "Nǐ", "Hǎo"]


NAMES = sorted(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    mine, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(mine) == sorted(want) and len(mine) == len(want)

    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    rows = lambda d: sorted((tuple(plain(v) for v in r) for r in d[sorted(d)].astype(object).itertuples(index=False)), key=repr)
    assert rows(mine) == rows(want)


def test_broadcast_is_checked(spark):
    assert "broadcast" in relational.small(spark.range(5))._jdf.queryExecution().logical().toString().lower()
    wide = spark.range(5).withColumn("x", F.repeat(F.lit("x"), 100))
    assert "broadcast" not in relational.small(wide, size=400)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in relational.small(spark.range(5), rows=3)._jdf.queryExecution().logical().toString().lower()


def test_split_names_in_one_pass(spark):
    from subtide.operators import relational

    rows = [("d", 7, ["ab", "c", "abc", None, "a", "b"]), ("d", 3, ["x", "ab", "c", "a", "bc"]), ("d", 2**40, ["a", "b", "c"]), ("e", 0, ["a", "bc"]), (None, 0, ["u", "v"]), (None, 1, ["uv"]), ("f", 0, None), ("g", 0, ["abcd", "efg", "abcdefg"])]
    got = relational.split_names(spark.createDataFrame(rows, "doc_id string, line long, w array<string>"), ["doc_id"], "line", "w")
    assert {tuple(r) for r in got.collect()} == {("d", "ab", 2, 7, "a b"), ("d", "abc", 4, 3, "ab c"), ("d", "bc", 1, 2**40, "b c"), (None, "uv", 1, 0, "u v")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan


def test_lines_that_show_are_rendered_once(spark):
    from subtide.plans import catalogue
    from subtide.sources import sinks

    c = catalogue.turn_cues(spark, "/root/testdata/sf0.001")
    plan = sinks.shown(c)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("transform" in line for line in filters) and plan.count("regexp_extract_all") == 1
