"""One bad block for each rule, clean blocks without findings, pairs, repair."""

import pytest
from pyspark.sql import functions as F

from subtide.operators import rules
from subtide.plans import catalogue, fix
from subtide.sources import sinks, srt

BAD = {
    "LEADING_SPACE": (" 我 好", "Wǒ hǎo"), "TRAILING_SPACE": ("我 好 ", "Wǒ hǎo"), "DOUBLE_SPACE": ("我  好", "Wǒ hǎo"), "ASCII_PUNCT": ("我 好,", "Wǒ hǎo，"),
    "SPACE_AROUND_PUNCT": ("我 好 。", "Wǒ hǎo。"), "ELLIPSIS_FORM": ("我 好…", "Wǒ hǎo…"), "DASH_FORM": ("我 好—", "Wǒ hǎo—"), "MARKER_SPACING": ("-我 好", "-Wǒ hǎo"),
    "MARKER_SYNC": ("- 我 好", "Wǒ hǎo"), "PUNCT_SYNC": ("我 好。", "Wǒ hǎo！"), "CUM_MISMATCH": ("我 好", "Wǒ"), "ERHUA_SPLIT": ("哪 儿", "Nǎ ér"), "PAIR_MISMATCH": ("我 好", "Wǒ bù"), "EMPTY_CUE": ("……", "……"),
}


@pytest.mark.parametrize("code", BAD)
def test_bad_lines(code):
    assert code in {c for c, _, _ in rules.check_cue(*BAD[code], catalogue.READINGS)}


@pytest.mark.parametrize("zh, py", [("我 好。 - 你 呢？", "Wǒ hǎo。 - Nǐ ne？"), ("<i>- 好。</i>", "<i>- Hǎo。</i>"), ("“好……”", "“Hǎo……”"), ("Wi-Fi 好", "Wi-Fi hǎo"), ("女儿", "Nǚér")])
def test_clean_lines(zh, py):
    assert rules.check_cue(zh, py) == []


BLOCKS = "1\n00:00:01,000 --> 00:00:02,000\n{}\n\n"


@pytest.mark.parametrize(
    "code, text",
    [
        ("BLOCK_SHAPE", BLOCKS.format("我")),
        ("INDEX_SEQ", BLOCKS.format("我\nWǒ").replace("1\n", "7\n", 1)),
        ("INDEX_SEQ", BLOCKS.format("我\nWǒ").replace("1\n", "x\n", 1)),
        ("TIMESTAMP_FORMAT", BLOCKS.format("我\nWǒ").replace(",000 -->", " -->")),
        ("TIMESTAMP_ORDER", BLOCKS.format("我\nWǒ") + "2\n00:00:01,500 --> 00:00:03,000\n我\nWǒ\n\n"),
        ("NAME_INCONSISTENT", BLOCKS.format("龙拳\nLóngquán") + "2\n00:00:03,000 --> 00:00:04,000\n龙 拳\nLóng quán\n\n"),
    ],
)
def test_bad_files(spark, code, text):
    got = rules.check(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert code in {r["code"] for r in got.collect()}


def test_vietnamese_files_and_pairs(spark):
    zh = BLOCKS.format("- 我 好\n- Wǒ hǎo") + "2\n00:00:03,000 --> 00:00:04,000\n你\nNǐ\n\n"
    vi = BLOCKS.format("Tôi khỏe ") + "2\n00:00:03,500 --> 00:00:04,000\n♪\n\n3\n00:00:05,000 --> 00:00:06,000\nđược\n\n"
    got = {r["code"] for r in rules.check_pairs(spark.createDataFrame([("d", zh, vi)], "doc_id string, zh_text string, vi_text string")).collect()}
    assert got == {"VI_TRAILING_SPACE", "VI_BLOCK_COUNT", "VI_TIMESTAMP_DRIFT", "VI_MARKER_SYNC"}
    alone = {r["code"] for r in rules.check(spark.createDataFrame([("d", vi)], "doc_id string, text string")).collect()}
    assert alone == {"VI_TRAILING_SPACE"}


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([("a", ""), ("b", None), ("c", "\n\n")], "doc_id string, text string")
    assert rules.check(docs).count() == 0 and fix.fix(docs).where("text = ''").count() == 3 and srt.cues(docs).count() == 0


def test_repair_settles(spark):
    """Repaired files have no errors that repair can mend, and repair doesn't change them again."""
    own = fix.Language(readings=catalogue.READINGS)
    one = fix.fix_document(catalogue.SAMPLE, own)
    two = fix.fix_document(one["text"], own)
    assert one["text"] == two["text"] and one["blocks"] == 5
    found = {r["code"] for r in fix.fix_findings(fix.fix(catalogue.sample(spark), own), catalogue.READINGS).where("severity = 'error'").collect()}
    assert found == {"TIMESTAMP_ORDER"}


def test_bilingual_blocks():
    readings = catalogue.READINGS
    lines, vi, aside = srt.sort_content(["我 好", "Wǒ hǎo", "Tôi khỏe"], readings)
    assert (lines, vi, aside) == (["我 好", "Wǒ hǎo"], "Tôi khỏe", [])
    assert srt.sort_content(["我 好", "我好"], readings)[0] == ["我 好"]
    assert srt.sort_content(["我", "好"], readings)[0] == ["我 好"]
    assert srt.sort_content(["我 好", "Tôi khỏe", "Wǒ hǎo"], readings) == (["我 好"], "Tôi khỏe", ["Wǒ hǎo"])
    got = fix.fix_document(BLOCKS.format("我 好\nWǒ hǎo\nTôi khỏe，bạn"), fix.Language(readings=readings))
    assert got["vi_text"].endswith("Tôi khỏe, bạn\n\n") and got["vi_cues"] == 1


def test_block_scan_is_tolerant():
    blocks, orphans = srt.scan_blocks("junk\n\n1\n00:00:01,0 --> 0:00:02.5\nA\n2\n00:00:03,000 --> 00:00:04,000\nB\n\nmore\n")
    assert orphans == ["junk"] and [b["content"] for b in blocks] == [["A"], ["B", "more"]]
    assert srt.parse("1\n00:00:01,58 --> 0:00:02.5\nA\n")[0][0]["start"] == 1.58


def test_renderer_expression_equals_the_function(spark):
    import random

    from tests.test_lexing import random_tokens
    from subtide.functions import lexing

    rng = random.Random(9)
    made = [random_tokens(rng, tags=True) for _ in range(200)]
    rows = [(i, [dict(t._asdict(), flags=list(t.flags)) for t in ts]) for i, ts in enumerate(made)]
    from subtide.schemas import TOKEN

    df = spark.createDataFrame(rows, f"i int, tokens array<{TOKEN}>")
    for r in df.select("i", sinks.render(F.col("tokens")).alias("zh"), sinks.render(F.col("tokens"), "pinyin").alias("py")).collect():
        assert (r["zh"], r["py"]) == (lexing.render(made[r["i"]]), lexing.render(made[r["i"]], "pinyin"))


def test_emitted_files(spark):
    cues = srt.cues(catalogue.sample(spark), True)
    text = sinks.srt(cues).first()["text"]
    assert text.startswith("1\n00:00:01,000 --> 00:00:02,500\n我 不 是") and text.endswith("\n\n") and text.count(" --> ") == 5
    lines = spark.createDataFrame([("sample", 0, "Tôi，không"), ("sample", 1, "")], "doc_id string, pos int, line string")
    vi = sinks.vi_srt(cues, lines).first()["text"]
    assert "Tôi, không" in vi and vi.count(" --> ") == 5
    assert sinks.ass(cues).first()["text"].count("Dialogue:") == 5 == sinks.bilingual_ass(cues, lines).first()["text"].count("Dialogue:")
    assert '"kind":"punctuation"' in sinks.bundle(cues).first()["bundle"]


def test_reviewed_file_when_given(spark):
    """The audited list of known errors of a reviewed file, whose place the environment names."""
    import os
    from pathlib import Path

    path = Path(os.environ.get("REVIEWED_SRT", ""))
    if not path.is_file():
        pytest.skip("no reviewed file is given")
    got = {}
    for r in rules.check(spark.createDataFrame([("c", path.read_text("utf-8"))], "doc_id string, text string")).collect():
        got.setdefault(r["code"], set()).add(r["cue_index"])
    assert got["CUM_MISMATCH"] == {2, 89, 340, 369, 729, 1038, 1280, 1324} and got["MARKER_SYNC"] == {895} and got["PUNCT_SYNC"] == {268}
    assert len(got["MARKER_SPACING"]) == 11 and len(got["ERHUA_SPLIT"]) == 19 and len(got["NAME_INCONSISTENT"]) == 14
