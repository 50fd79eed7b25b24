"""Repair of subtitle files, and the other passes over whole documents.

A document is a few thousand cues at most and its state (sentence case, quotes, names)
runs from cue to cue, so a document is one row of an Arrow pass: no shuffle at all.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide import resources as R
from subtide import shared
from subtide.functions import lang, lexing
from subtide.functions.lexing import Token
from subtide.operators import rules
from subtide.session import ship
from subtide.sources import srt


@dataclass(frozen=True)
class Language:
    """Dictionaries that the caller supplies: readings of characters and words, counts of words, spellings and splits of names."""

    readings: Mapping[str, Sequence[str]] = field(default_factory=dict)
    lexicon: Mapping[str, float] = field(default_factory=dict)
    names: Mapping[str, str] = field(default_factory=dict)
    splits: Mapping[str, Sequence[str]] = field(default_factory=dict)
    config: Mapping = field(default_factory=srt.config)
    cut: Callable[[str], list[str]] | None = None
    typed_v: bool = True  # a v in a pinyin line is ü

    def segment(self, han: str) -> list[str]:
        return self.cut(han) if self.cut else lang.segment(han, self.lexicon, self.splits)


def has_editor_spaces(tokens: Sequence[Token]) -> bool:
    """Two words next to each other, Han on both facing edges: somebody has put the space there."""
    return any(a.kind == b.kind == "word" and a.zh and b.zh and R.HAN_READING_RE.match(a.zh[-1]) and R.HAN_READING_RE.match(b.zh[0]) for a, b in zip(tokens, tokens[1:], strict=False))


def route(tokens: Sequence[Token]) -> tuple[str, list[Token]]:
    """kept_pinyin, new_pinyin or resegmented; Han on the pinyin line is no pinyin."""
    words = [t for t in tokens if t.kind == "word"]
    if any(t.pinyin and R.HAN_READING_RE.search(t.pinyin) for t in words):
        tokens = [t._replace(pinyin=None) for t in tokens]
        words = [t for t in tokens if t.kind == "word"]
    if all(t.pinyin for t in words):
        return "kept_pinyin", list(tokens)
    return ("new_pinyin" if has_editor_spaces(tokens) else "resegmented"), list(tokens)


def tokenise_cue(tokens: Sequence[Token], how: str, own: Language) -> list[Token]:
    """Clusters, 儿, readings, 儿 again, sandhi (not over an editor's pinyin), open readings."""
    cfg = own.config
    if how == "resegmented":
        tokens = lang.cut_words(tokens, own.segment)
    t = cfg["tokenize"]
    tokens = lang.merge_erhua(tokens)
    tokens = lang.fill_pinyin(tokens, own.readings, t["always"], t["exact"], overwrite=how == "resegmented")
    tokens = lang.merge_erhua(tokens)
    if how != "kept_pinyin":
        s = cfg["sandhi"]
        tokens = lang.sandhi(tokens, s["bu"], s["yi"], s["third_tone"])
    return lang.flag_heteronyms(tokens, own.readings, t["heteronyms"], t["heteronym_confidence"])


def normalise(cues: Sequence[Sequence[Token]], own: Language) -> list[list[Token]]:
    """Latin rejoined, marks, sentence case, names, no empty tokens; both lines must then have one cluster for each word."""
    n = own.config["normalize"]
    out = [lang.normalise_marks(lang.rejoin_latin(c), n["ascii_to_chinese"], n["smart_quotes"], n["ellipsis"], n["dash"]) for c in cues]
    out = lang.apply_casing(out, own.names, own.config["casing"]["ellipsis_default"])
    out = [[t for t in lang.spell_names(c, own.names) if t.zh.strip() or t.kind not in ("word", "punct")] for c in out]
    for c in out:
        want = sum(t.kind == "word" for t in c)
        got = [sum(t.kind == "word" for t in lexing.tokenise(lexing.render(c, f))) for f in ("zh", "pinyin")]
        if got != [want, want]:
            raise ValueError(f"lines out of step: {want} words, {got} clusters in {lexing.render(c)!r} and {lexing.render(c, 'pinyin')!r}")
    return out


def stamp(seconds: float) -> str:
    ms = int(round(seconds * 1000)) if seconds == seconds and seconds > 0 else 0
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def fix_document(body: str, own: Language) -> dict:
    """One document repaired: text, cues' Vietnamese lines by place and the cues without one, parse findings, counts of the three routes."""
    blocks, orphans = srt.parse(unicodedata.normalize("NFC", body or ""), own.readings or None, own.typed_v)
    counts = dict.fromkeys(("kept_pinyin", "new_pinyin", "resegmented"), 0)
    cues = []
    for b in blocks:
        how, tokens = route(srt.tokens_of(b, True))
        counts[how] += 1
        cues.append(tokenise_cue(tokens, how, own))
    cues = normalise(cues, own)
    zh_file, vi_file, no_vi, n = [], [], [], 0
    aside = list(orphans) + [x for b in blocks for x in b["set_aside"]]
    with_vi = any(b["vi"] for b in blocks)
    for b, tokens in zip(blocks, cues, strict=True):
        zh, py = lexing.render(tokens), lexing.render(tokens, "pinyin")
        if not zh and not py:
            aside += [b["vi"]] if b["vi"] else []
            continue
        n += 1
        at = f"{n}\n{stamp(b['start'])} --> {stamp(b['end'])}\n"
        zh_file.append(f"{at}{zh}\n{py}\n\n")
        vi_file.append(f"{at}{vi_line(b['vi'], zh)}\n\n")
        no_vi += [] if b["vi"] else [n]
    return {"text": "".join(zh_file), "vi_text": "".join(vi_file) if with_vi else None, "no_vi": no_vi if with_vi else [], "set_aside": aside, "cues": len(blocks), "blocks": n, "vi_cues": sum(bool(b["vi"]) for b in blocks), **counts}


def vi_line(line: str | None, original: str) -> str:
    """A clean Vietnamese line, the original where there is none, a note sign where there is neither."""

    def clean(s: str) -> str:
        s = "".join(c for c in s.translate({13: " ", 10: " ", 9: " "}) if c >= " ")
        for c in R.VI_TIGHT:
            s = s.replace(" " + c, c)
        return " ".join(s.replace("( ", "(").split(" ")).strip() if "  " not in s else clean(s.replace("  ", " "))

    marked = (line or "").replace(R.ELLIPSIS, "…").replace(R.DASH, " — ")
    for mark, plain in R.VI_MARKS.items():
        marked = marked.replace(mark, plain)
    out = clean(marked) or clean(original.strip()) or "♪"
    if out != "♪" and original.lstrip().startswith("- ") != out.startswith("- "):
        out = "- " + out if not out.startswith("- ") else out[2:].lstrip()
    return out


FIXED = "doc_id string, text string, vi_text string, no_vi array<int>, set_aside array<string>, cues int, blocks int, vi_cues int, kept_pinyin int, new_pinyin int, resegmented int"


def fix(docs: DataFrame, own: Language | None = None) -> DataFrame:
    """Repaired documents of (doc_id, text)."""
    own = own or Language()
    ship(docs.sparkSession)
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "int": pa.int32()}
    columns = {c.split()[0]: kinds[c.split()[1]] for c in FIXED.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [{"doc_id": doc, **fix_document(body, own)} for doc, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in columns.items()], list(columns))

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, FIXED)


def fix_findings(fixed: DataFrame, readings: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Findings of repaired documents: their own, those of the pair, a VI_EMPTY_LINE for each cue that alone has no Vietnamese line, and a BLOCK_SHAPE for each line set aside."""
    fixed = shared.written(fixed, "fixed")  # read by each of these
    own = rules.check(fixed.select("doc_id", "text"), readings)
    pairs = rules.check_pairs(fixed.where("vi_text is not null").select("doc_id", F.col("text").alias("zh_text"), "vi_text"))
    said = lambda code, cue, message, line: (F.lit(code).alias("code"), F.lit(R.SEVERITY[code]).alias("severity"), cue.cast("int").alias("cue_index"), message.alias("message"), line.alias("line"))
    aside = fixed.select("doc_id", F.explode("set_aside").alias("line")).select("doc_id", *said("BLOCK_SHAPE", F.lit(None), F.concat(F.lit("line set aside: "), "line"), F.col("line")))
    without = fixed.select("doc_id", F.explode("no_vi").alias("n")).select("doc_id", *said("VI_EMPTY_LINE", F.col("n"), F.lit("no Vietnamese line before the repair"), F.lit("")))
    return own.unionByName(pairs).unionByName(without).unionByName(aside)


def drop_repeats(segments: DataFrame, threshold: float = 0.9, keep: int = 2, least: int = R.REPEAT_MIN_CHARS) -> DataFrame:
    """Segments (doc_id, id, text, ...) without the tail of a run of near-equal ones; the similarity is an Arrow pass over neighbours."""
    from pyspark.sql import Window

    from subtide.operators import sequence

    ship(segments.sparkSession)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, x = [], None, ""
        for before, now in zip(a, b, strict=True):
            x, y = x if last is not None and before == last else lang.bare(before or ""), lang.bare(now or "")
            out.append(min(len(x), len(y)) >= least and lang.alike(x, y, threshold))
            last, x = now, y
        return pd.Series(out, dtype=bool)

    w = Window.partitionBy("doc_id").orderBy("id")
    marked = segments.withColumn("_prev", F.lag("text").over(w)).withColumn("_same", alike("_prev", "text"))
    return sequence.repeat_trim(marked, ["doc_id"], ["id"], F.col("_same"), keep).drop("_prev", "_same")


def retokenise(lines: DataFrame, own: Language | None = None) -> DataFrame:
    """zh and pinyin lines of edited texts (id, text), cut and read anew."""
    own = own or Language()
    ship(lines.sparkSession)

    def one(line: str) -> tuple[str, str]:
        how, tokens = route(lexing.tokenise(line or "", True))
        cue = normalise([tokenise_cue(tokens, how if how != "kept_pinyin" else "resegmented", own)], own)[0]
        return lexing.render(cue), lexing.render(cue, "pinyin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], ["id", "zh", "pinyin"])

    return lines.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, zh string, pinyin string")
