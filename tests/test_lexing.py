"""Lexers, renderer and language functions: properties over random tokens, and cases."""

import random

import pytest

from subtide import resources as R
from subtide.functions import lang, lexing
from subtide.functions.lexing import Token

WORDS = ["我", "你好", "世界", "OK", "Wi-Fi", "don't", "纽约", "100"]
MARKS = ["。", "，", "……", "——", "？", "“", "”", "《", "》", "！"]
TAGS = ["<i>", "</i>", '<font color="red">', "</font>"]


def random_tokens(rng, tags=False):
    out = []
    for _ in range(rng.randint(0, 12)):
        r = rng.random()
        if tags and r < 0.15:
            out.append(Token("markup", rng.choice(TAGS)))
        elif r < 0.6:
            out.append(Token("word", rng.choice(WORDS), rng.choice(["wǒ", "nǐhǎo", None])))
        elif r < 0.9:
            out.append(Token("punct", rng.choice(MARKS)))
        elif not any(t.kind != "markup" for t in out) or (out and out[-1].kind == "punct" and out[-1].zh in "。！？"):
            out.append(Token("marker", "-"))
    return out


@pytest.mark.parametrize("field", ["zh", "pinyin"])
def test_no_stray_spaces(field):
    rng = random.Random(1)
    for _ in range(2000):
        line = lexing.render(random_tokens(rng), field)
        assert line == line.strip() and "  " not in line


def test_same_clusters_on_both_lines():
    rng = random.Random(2)
    for _ in range(2000):
        tokens = [t for t in random_tokens(rng) if not (t.kind == "punct" and t.zh in "“”《》")]
        words = [len([t for t in lexing.tokenise(lexing.render(tokens, f)) if t.kind == "word"]) for f in ("zh", "pinyin")]
        assert words[0] == words[1] == sum(t.kind == "word" for t in tokens)


def test_tokens_come_back():
    rng = random.Random(3)
    for _ in range(2000):
        line = lexing.render(random_tokens(rng))
        assert lexing.render(lexing.tokenise(line)) == line


def test_tags_are_transparent():
    rng = random.Random(4)
    for _ in range(2000):
        tokens = random_tokens(rng, tags=True)
        assert R.TAG_RE.sub("", lexing.render(tokens)) == lexing.render([t for t in tokens if t.kind != "markup"])


@pytest.mark.parametrize(
    "line, want",
    [
        ("我 走，你 留...", "我 走，你 留……"),
        (". . .", "……"),
        ("他 - 来", "他——来"),
        ('"好" "坏"', "“好”“坏”"),
        ("- 你 好 - 我 来", "- 你 好 - 我 来"),
        ("<i>- 好.</i>", "<i>- 好。</i>"),
    ],
)
def test_normalised(line, want):
    assert lexing.render(lexing.tokenise(line, True)) == want


def test_tones_and_er():
    assert lang.set_tone("bù", 2) == "bú" and lang.set_tone("liu", 2) == "liú" and lang.set_tone("nü", 3) == "nǚ"
    assert [lang.tone_of(x) for x in ("", "de", "mā", "má", "mǎ", "mà")] == [0, 5, 1, 2, 3, 4]
    for full, short in (("nǎér", "nǎr"), ("diǎnér", "diǎnr"), ("zhèr", "zhèr"), ("huì", "huìr")):
        assert lang.erhua_pinyin(full) == short == lang.erhua_pinyin(short)
    assert lang.is_erhua("哪儿") and not lang.is_erhua("女儿")


def test_merging_er_takes_one_and_leaves_blocked():
    t = [Token("word", "哪", "nǎ"), Token("word", "儿", "ér"), Token("word", "女", "nǚ"), Token("word", "儿", "ér")]
    assert [(x.zh, x.pinyin) for x in lang.merge_erhua(t)] == [("哪儿", "nǎr"), ("女", "nǚ"), ("儿", "ér")]


def test_sandhi_reads_neighbours_as_they_came():
    t = [Token("word", "不", "bù"), Token("word", "是", "shì"), Token("word", "不", "bù"), Token("punct", "。"), Token("word", "是", "shì")]
    assert [x.pinyin for x in lang.sandhi(t)] == ["bú", "shì", "bù", None, "shì"]


def test_casing():
    cue = [Token("word", "我", "wǒ"), Token("word", "走", "Zǒu"), Token("punct", "。"), Token("word", "你", "nǐ"), Token("punct", "……")]
    out = lang.apply_casing([cue, [Token("word", "好", "hǎo")], [Token("word", "PK", "PK"), Token("word", "李", "lǐ")]], {"李": ""})
    assert [[t.pinyin for t in c if t.pinyin] for c in out] == [["Wǒ", "Zǒu", "Nǐ"], ["Hǎo"], ["PK", "Lǐ"]]
    assert out[1][0].flags == ("CASE_AMBIG",) and out[2][1].flags == ("NAME",)


def test_pinyin_or_vietnamese():
    readings = {"是": ["shì"], "谁": ["shéi", "shuí"]}
    assert lang.looks_like_pinyin("Shì shéi？", "是 谁？", readings)
    assert not lang.looks_like_pinyin("Là ai?", "是 谁？", readings)
    assert not lang.looks_like_pinyin("Anh là ai?", "是 谁？", readings)
    assert not lang.looks_like_pinyin("♪", "是 谁？", readings, needs_proof=True)
    assert len(R.SYLLABLES) == 425


def test_readings():
    readings = {"好": ["hǎo", "hào"], "哪": ["nǎ"], "儿": ["ér"]}
    assert lang.fits_reading("好", "hào", readings) and not lang.fits_reading("好", "bù", readings)
    assert lang.fits_reading("哪儿", "nǎr", readings)
    assert lang.pinyin_of("好地", readings, {}, {}) == "hǎo地" and lang.pinyin_of("地", readings, {}, {"地": "de"}) == "de"


def test_segmentation_prefers_words_and_keeps_names():
    lexicon = {"我们": 50, "今天": 40, "我": 30, "们": 1, "今": 5, "天": 10, "走": 20}
    assert lang.segment("我们今天走", lexicon) == ["我们", "今天", "走"]
    assert lang.segment("我谈胥", lexicon, {"谈胥": ["谈", "胥"]}) == ["我", "谈", "胥"]


def test_similarity():
    assert lang.similarity("好。", "好，") == 1.0 and lang.similarity("", "好") == 0.0 and 0 < lang.similarity("我们走吧", "我们来吧") < 1


def test_column_functions_equal_the_plain_ones(spark):
    from pyspark.sql import functions as F

    from subtide.functions import lang, text
    from subtide.plans import report

    rng = random.Random(7)
    parts = ["a", "ou", "iu", "ui", "lü", "Nǐ", "hǎo", "er", "ér", "ng", "zh", "Xiu", "n", "r", "ǚ", "É"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(300)] + ["", "m", "er", "r"]
    d = spark.createDataFrame([(w, i % 6) for i, w in enumerate(words)], "w string, t int")
    got = d.select("w", "t", text.tone_of(F.col("w")).alias("a"), text.tone_of(F.col("w"), True).alias("z"), text.set_tone(F.col("w"), F.col("t")).alias("s"), text.erhua_pinyin(F.col("w")).alias("e")).collect()
    for r in got:
        assert (r["a"], r["z"], r["s"], r["e"]) == (lang.tone_of(r["w"]), lang.tone_of(r["w"], True), lang.set_tone(r["w"], r["t"]), lang.erhua_pinyin(r["w"])), r
    names = ["a<b>:c\x00d. ", "", None, "好" * 300, "x" * 130, ". .", "é" * 119 + "好好", " a  b\t"]
    stems = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", text.safe_stem(F.col("n")).alias("s"))
    assert {r["i"]: r["s"] for r in stems.collect()} == {i: report.safe_stem(n) for i, n in enumerate(names)}
    flags = spark.createDataFrame([(["NAME"],), (None,), (["B", "A"],)], "f array<string>").select(text.flag_union(F.col("f"), "A", "NAME").alias("u"))
    assert [r["u"] for r in flags.collect()] == [["NAME", "A"], ["A", "NAME"], ["B", "A", "NAME"]]


def test_other_encodings_and_configuration_files(spark, tmp_path):
    import json

    from subtide.sources import srt

    line = "1\r\n00:00:01,000 --> 00:00:02,000\r\n中文。\r\n"
    for name in ("utf-8-sig", "utf-16", "gb18030", "utf-8"):
        assert srt.decode_bytes(line.encode(name)) == line.replace("\r\n", "\n")
    assert srt.decode_bytes("一二".encode("big5") + b"\xfa\x40\x20\xff\xff") and srt.decode_bytes(b"caf\xe9 \x80\xff \x81") and srt.decode_bytes("é".encode("cp1252")) == "é"
    path = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps({"cue": {"max_chars": 9}, "tokenize": {"heteronyms": "好"}, "profiles": {"own": {"cue": {"silence": 9.0}}}}))
    got = srt.config_from(spark, path, {"sandhi": {"yi": True}}, "own")
    want = srt.config()
    assert got["cue"] == want["cue"] | {"max_chars": 9, "silence": 9.0} and got["tokenize"]["heteronyms"] == "好" and got["sandhi"]["yi"] and "profiles" not in got
    (tmp_path / "broken.json").write_text("{")
    assert srt.config_from(spark, str(tmp_path / "broken.json")) == want == srt.config_from(spark, str(tmp_path / "none.json"))
