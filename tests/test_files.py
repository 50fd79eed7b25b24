"""Whole files, proofreading and reruns against SQL and by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from subtide.plans import catalogue, files, names, review, stages
from subtide.sources import sinks

NAMES = ("findings_summary", "rule_vi_block_count", "rule_vi_marker_sync", "tolerant_blocks", "emit_bilingual_ass", "proofread_cues", "editor_save", "decode_uploads", "name_tables")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "part", "benchmark", "labels", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf_dir)
    rows = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in rows.description]
    want = [dict(zip(columns, r, strict=True)) for r in rows.fetchall()]
    ordered = lambda some: sorted(str([r[c] for c in got.columns]) for r in some)
    assert ordered(r.asDict() for r in got.collect()) == ordered(want) and want


def test_every_rule_has_a_query():
    from subtide import resources

    assert {f"rule_{c.lower()}" for c in resources.SEVERITY} <= set(catalogue.ORACLE_SQL)
    assert {c for c in resources.SEVERITY} == set(files.RULES) | set(files.VI_RULES)


def cues(spark, lines):
    token = "array<struct<kind:string,zh:string,pinyin:string,confidence:double,source:string,flags:array<string>>>"
    return spark.createDataFrame([("d", i, [(k, z, p, 1.0, "x", list(f)) for k, z, p, *f in row]) for i, row in enumerate(lines)], f"doc_id string, pos int, tokens {token}")


def test_proofreading(spark):
    c = cues(spark, [[("word", "来", "lái")], [("word", "好", "hǎo", "CASE_AMBIG")], [("word", "美国", "Měiguó", "NAME")], [], [("marker", "-", None)]])
    answer = lambda task, items: [{"id": x["id"], **({"case": "UPPER "} if task == "T3" else {"punct": "。" if x["line"] != "美国" else "x"})} for x in items]
    cache = spark.createDataFrame([], "task string, model string, key string, value string")
    done, proposals = review.proofread(c, cache, answer, "m")
    lines = {r["pos"]: (r["z"], r["p"], r["recased"]) for r in done.select("pos", sinks.render(F.col("tokens")).alias("z"), sinks.render(F.col("tokens"), "pinyin").alias("p"), "recased").collect()}
    assert lines[0] == ("来。", "lái。", False) and lines[1] == ("好。", "Hǎo。", False) and lines[2] == ("美国", "Měiguó", False)
    status = {(r["task"], r["pos"]): r["status"] for r in proposals.collect()}
    assert status == {("T3", 1): "applied", ("T4", 0): "applied", ("T4", 1): "applied", ("T4", 2): "rejected"}
    kept, said = review.proofread(c, cache, names.null_provider)
    assert {r["status"] for r in said.collect()} == {"unanswered"} and kept.where("closed or recased").count() == 0


def test_edits_need_times_and_lines(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id string, pos int, start double, end double, zh string, pinyin string, vi string")
    zh, vi = review.edited_files(rows(("d", 0, 1.0, 2.0, " 你\t好 ", "nǐ hǎo", None), ("d", 1, 2.0, 3.0, "", None, "x"), ("d", 2, 3.0, 4.0, "再见", "", "tạm biệt")))
    assert zh.first()["text"].startswith("1\n00:00:01,000 --> 00:00:02,000\n你 好\nnǐ hǎo\n\n2\n") and vi.first()["text"].endswith("tạm biệt\n\n")
    with pytest.raises(ValueError):
        review.edited_files(rows(("d", 0, None, 2.0, "a", "b", "c")))
    with pytest.raises(ValueError):
        review.edited_files(rows(("d", 0, 1.0, 2.0, " ", "", "c")))


def test_stages_are_used_again(spark, tmp_path):
    calls = []
    step = lambda n: stages.Stage(n, f"s{n}", lambda t: calls.append(n) or t.withColumn(f"c{n}", F.lit(n)), "ai" if n == 2 else None)
    plan, source, folder = [step(1), step(2), step(3)], spark.range(3), str(tmp_path)
    assert [d for *_, d in stages.run(source, plan, folder)[1]] == ["run"] * 3 and calls == [1, 2, 3]
    assert [d for *_, d in stages.run(source, plan, folder)[1]] == ["reused"] * 3 and calls == [1, 2, 3]
    assert [d for *_, d in stages.run(source, plan, folder, force_from=2)[1]] == ["reused", "run", "run"]
    table, log = stages.run(source, plan, folder, skip={"ai"})
    assert [d for *_, d in log] == ["reused", "skipped", "run"] and table.columns == ["id", "c1", "c3"]
    (tmp_path / "S3_s3" / "_SUCCESS").unlink()  # a write that broke off
    assert [d for *_, d in stages.run(source, plan, folder)[1]][0] == "reused" and stages.has_stage(spark, folder, plan[2])
    assert not stages.changed_since(spark, folder, "names", spark.range(2)) and not stages.changed_since(spark, folder, "names", spark.range(2)) and stages.changed_since(spark, folder, "names", spark.range(3))


def test_another_source_or_version_is_no_reuse(spark, tmp_path):
    folder, ran = str(tmp_path / "r"), []

    def plan(version="1"):
        make = lambda n, v: stages.Stage(n, f"s{n}", lambda t: ran.append(n) or t.withColumn(f"c{n}", F.lit(v)), version=v)
        return [make(1, "1"), make(2, version)]

    done = lambda source, version="1": [x[2] for x in stages.run(source, plan(version), folder)[1]]
    assert done(spark.range(5)) == ["run", "run"] and done(spark.range(5).orderBy(F.desc("id"))) == ["reused", "reused"]
    assert done(spark.range(5), "2") == ["reused", "run"] and stages.run(spark.range(5), plan("2"), folder)[0].first()["c2"] == "2"
    assert done(spark.range(6), "2") == ["run", "run"] and done(spark.range(6), "2") == ["reused", "reused"]


def test_proofreading_makes_cues_twice(spark):
    """Once for what is asked, once for what is done with the answers."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    word = F.array(F.struct(F.lit("word").alias("kind"), F.lit("x").alias("zh"), F.lit("x").alias("pinyin"), F.lit(1.0).alias("confidence"), F.lit("").alias("source"), F.array(F.lit("CASE_AMBIG")).alias("flags")))
    c = spark.range(0, 400, 1, 4).select((F.col("id") % 3).alias("doc_id"), counted.asNondeterministic()("id").alias("pos"), word.alias("tokens"))
    cache = spark.createDataFrame([], "task string, model string, key string, value string")
    done, proposals = review.proofread(c, cache, lambda task, items: [{"id": x["id"], "case": "upper", "punct": "。"} for x in items], "m")
    assert len(done.collect()) == 400 and proposals.groupBy("task").count().count() == 2 and made.value == 800


def test_all_that_a_repair_leaves(spark, tmp_path):
    """Names, pairs and missing Vietnamese lines too, over files with and without a Vietnamese one."""
    import random

    from subtide.plans import chinese

    rng, said = random.Random(6), ["ma", "hao", "mahao", "lv", "nve", "lvma", "xk", "xkma", "b", "xkb", "Xk", "wq"]
    rows = [(c, n, "user", " ".join(rng.choice(said[: 6 if c % 3 == 0 else None]) for _ in range(rng.choice((1, 1, 2, 3))))) for c in range(60) for n in range(rng.randint(1, 8))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, code, cue, n FROM ({catalogue.ORACLE_SQL['fix_then_check']})").fetchall()
    got = [tuple(r) for r in chinese.fix_then_check(spark, str(tmp_path)).select("doc_id", "code", "cue", "n").collect()]
    assert sorted(got) == sorted(want) and {r[1] for r in got} == {"NAME_INCONSISTENT", "TIMESTAMP_ORDER", "VI_EMPTY_LINE", "VI_MARKER_SYNC"}
    vi = {r[0] for r in got if r[1].startswith("VI_")}
    assert vi and {r[3] for r in got if r[1] == "TIMESTAMP_ORDER"} == {1, 2}  # once more where there is a Vietnamese file


def test_proofreading_asks_for_all_open_cues(spark):
    """More of them than a list has; cues that come twice or have no place are neither lost nor multiplied."""
    word = lambda w: [("word", w, w, 1.0, "x", ["CASE_AMBIG"])]
    rows = [(f"d{n % 3}", n, word(f"w{n}")) for n in range(400)] + [("e", 0, word("x")), ("e", 0, word("x")), ("e", 1, word("y")), ("e", 1, word("zz")), ("e", None, word("n"))]
    c = spark.createDataFrame(rows, "doc_id string, pos int, tokens array<struct<kind:string,zh:string,pinyin:string,confidence:double,source:string,flags:array<string>>>")
    cache = spark.createDataFrame([], "task string, model string, key string, value string")
    answer = lambda task, items: [{"id": x["id"], "case": "upper", "punct": "！" if x.get("line") == "zz" else "。"} for x in items]
    done, proposals = review.proofread(c, cache, answer, "m")
    assert {(r["task"], r["status"]): r["count"] for r in proposals.groupBy("task", "status").count().collect()} == {("T3", "applied"): 405, ("T4", "applied"): 405}
    got = sorted(tuple(r) for r in done.select(sinks.render(F.col("tokens")).alias("z"), sinks.render(F.col("tokens"), "pinyin").alias("p")).collect())
    assert got == sorted((w + m, w.capitalize() + m) for w, m in [*((f"w{n}", "。") for n in range(400)), ("x", "。"), ("x", "。"), ("y", "。"), ("zz", "！"), ("n", "。")])
    assert review.case_items(c).count() == review.CASE_ITEMS and review.case_items(c, None).count() == review.end_items(c, None).count() == 405
