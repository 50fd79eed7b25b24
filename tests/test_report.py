"""Report datasets, transcript cleaning, alignment, stage documents."""

import json

import pytest

from subtide.operators import relational
from subtide.plans import catalogue, fix, report
from subtide.operators import rules
from subtide.sources import srt


def test_alignment_and_synthesis():
    assert report.align([("你", 0, 1), ("好", 1, 2)], "你，好。") == [("你，", 0, 1), ("好。", 1, 2)]
    assert report.align([("你", 0, 1)], "他。") == [("你", 0, 1)] and report.align([], "x") == []
    assert [w[0] for w in report.synthesise("好，3.5元", 0.0, 2.0)] == ["好，", "3.5", "元"]
    assert report.synthesise("好", 2.0, 1.0) == [("好", 2.0, 2.0)] and report.synthesise("  ", 0.0, 1.0) == []


def test_stem():
    assert report.safe_stem('a<b>:c\x00d. ') == "a b c d" and report.safe_stem("") == "output" and len(report.safe_stem("好" * 300).encode()) <= 200


def test_cleaning(spark):
    rows = [("a", i, t, float(i), float(i + 1), []) for i, t in enumerate(["好好的", "好好的", "好好的", "", "……", " 走 ", "3"])]
    s = spark.createDataFrame(rows, "doc_id string, id int, text string, start double, end double, words array<struct<word:string,start:double,end:double>>")
    kept, dropped = report.clean_segments(s, {"好": "妙"})
    assert [(r["index"], r["text"]) for r in kept.orderBy("index").collect()] == [(1, "妙妙的"), (2, "妙妙的"), (3, "走"), (4, "3")]
    st = report.cleanup_stats(s, kept, dropped).first()
    assert (st["segments_in"], st["segments_out"], st["repeat"], st["empty"], st["punct_only"]) == (7, 4, 1, 1, 1)
    assert report.words_of(s).where("word = '走'").count() == 1


def test_report_datasets(spark):
    docs = catalogue.sample(spark)
    cues = srt.cues(docs, True)
    st = report.document_stats(cues).first()
    assert st["cues"] == 5 and st["empty_cues"] == 1 and st["total_duration"] == 11.0
    assert report.against_target(report.document_stats(cues)).count() == 6
    found = rules.check(docs, catalogue.READINGS)
    both = report.grouped_findings(cues.drop("vi"), found)
    assert both.count() >= 5 and both.where("index = 1").first()["findings"][0]["code"] == "ERHUA_SPLIT"
    assert report.integrity(docs).first()["missing"] == 0 and report.integrity(docs).first()["bad_lines"] == [12]
    assert report.stage_flags(cues, cues).count() == 0
    assert relational.summary(found).where("code is null and severity is null").first()["n"] == found.count()


def test_stage_documents(spark):
    rows = [("a", json.dumps({"cues": [{"index": 3, "start": 1, "tokens": [{"kind": "punctuation", "text": "。", "confidence": "x"}, "好"]}]})), ("b", json.dumps(["走"])), ("c", "{"), ("d", json.dumps({"segments": [{"words": [{"word": "来"}, "了"]}]}))]
    got = {r["doc_id"]: r for r in report.stage_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["tokens"][0]["kind"] == "punct" and got["a"]["tokens"][0]["confidence"] == 1.0
    assert got["b"]["tokens"][0]["zh"] == "走" and got["d"]["tokens"][0]["zh"] == "来了" and got["a"]["end"] == 1.0


def test_corrupt_names_are_not_saved(spark, tmp_path):
    bad = spark.createDataFrame([("a", True)], "han string, corrupt boolean")
    with pytest.raises(ValueError):
        report.save_names(bad, str(tmp_path / "n"))
    assert report.save_names(bad.where("not corrupt"), str(tmp_path / "n")).count() == 0


def test_retokenised_lines(spark):
    own = fix.Language(readings=catalogue.READINGS, lexicon={"你好": 9, "你": 1, "好": 1})
    assert [tuple(r) for r in fix.retokenise(spark.createDataFrame([(1, "你好，我是")], "id long, text string"), own).collect()] == [(1, "你好，我 是", "Nǐhǎo，wǒ shì")]


def test_no_segment_is_a_repeat_where_none_is_cut(spark):
    s = spark.createDataFrame([(None, 1, "a"), ("d", None, "b"), ("d", 1, " \t\n"), ("d", 2, "…!")], "doc_id string, id int, text string")
    kept, dropped = report.clean_segments(s, cfg={"repeat_max": 0})
    assert {r["text"] for r in kept.collect()} == {"a", "b"} and {(r["id"], r["reason"]) for r in dropped.collect()} == {(1, "empty"), (2, "punct_only")}
