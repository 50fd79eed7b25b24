"""The 24 format rules as a findings relation.

Structure (numbers, stamps, order, shape) is windows over a document's blocks;
content of a cue is one Arrow pass over (Chinese line, pinyin line); consistency of
names is an n-gram join.  Findings: doc_id, code, severity, cue_index, message, line.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide import resources as R
from subtide import shared
from subtide.functions import lang, text
from subtide.functions.lexing import DOUBLE_SPACE, SPACED_DOTS, Item, head_end, lex, word_texts
from subtide.session import ship
from subtide.sources import srt

from . import relational

Found = list[tuple[str, str, str]]  # code, message, line
_GAP = tuple(R.SPACES)


def spacing(line: str, name: str) -> Found:
    out = [(code, f"{name} line {what} a space", line) for code, what, hit in (("LEADING_SPACE", "begins with", line[:1]), ("TRAILING_SPACE", "ends with", line[-1:])) if hit and hit in _GAP]
    return out + [("DOUBLE_SPACE", f"{name} line has {len(m[0])} spaces at {m.start()}", line) for m in DOUBLE_SPACE.finditer(line)]


def marks(line: str, items: Sequence[Item], name: str) -> Found:
    """ASCII marks, and the forms of ellipses and dashes."""
    out: Found = []
    spaced = [m.span() for m in SPACED_DOTS.finditer(line)]
    for x in items:
        if x.kind != "punct":
            continue
        c, n = x.text[0], len(x.text)
        if c in R.ASCII_PAIRS or (c in R.ASCII_STOPS and not (c == "." and (n > 1 or any(a <= x.start < b for a, b in spaced) or SPACED_DOTS.search(line, max(0, x.start - 3), x.end + 3)))):
            out.append(("ASCII_PUNCT", f"{name} line has {x.text!r} at {x.start}", line))
        if (c == "…" and n != 2) or (c == "." and n > 1):
            out.append(("ELLIPSIS_FORM", f"{name} line has {x.text!r} at {x.start} for {R.ELLIPSIS}", line))
        if (c == "—" and n != 2) or c in R.WRONG_DASHES:
            out.append(("DASH_FORM", f"{name} line has {x.text!r} at {x.start} for {R.DASH}", line))
    return out + [("ELLIPSIS_FORM", f"{name} line has spaced dots at {a}", line) for a, _ in spaced]


def around(line: str, items: Sequence[Item], name: str) -> Found:
    """Spaces next to marks, and those that a turn mark needs; tags are transparent."""
    out: Found = []
    starts, ends = {x.start: x.end for x in items if x.kind == "markup"}, {x.end: x.start for x in items if x.kind == "markup"}
    turns = {x.start for x in items if x.kind == "marker"}

    def skip(at: int, table: Mapping[int, int]) -> int:
        while at in table:
            at = table[at]
        return at

    def spaced(at: int) -> bool:
        return 0 <= at < len(line) and line[at] in _GAP

    for x in items:
        if x.kind == "punct" and x.text[0] not in R.ASCII_STOPS + R.ASCII_PAIRS + R.ASCII_BRACKETS:
            if x.text[0] not in R.OPENING and x.start and spaced(x.start - 1):
                out.append(("SPACE_AROUND_PUNCT", f"{name} line has a space before {x.text!r} at {x.start}", line))
            if x.text[0] not in R.CLOSING and spaced(x.end):
                after = len(line) - len(line[x.end :].lstrip(R.SPACES))
                if not (after == x.end + 1 and skip(after, starts) in turns):
                    out.append(("SPACE_AROUND_PUNCT", f"{name} line has a space after {x.text!r} at {x.start}", line))
        if x.kind == "marker":
            left, right = skip(x.start, ends), skip(x.end, starts)
            if x.start != head_end(line) and line[left - 1] not in R.OPENING and not spaced(left - 1):
                out.append(("MARKER_SPACING", f"{name} line has no space before the turn mark at {x.start}", line))
            if right >= len(line):
                out.append(("MARKER_SPACING", f"{name} line ends with a turn mark", line))
            elif not spaced(right):
                out.append(("MARKER_SPACING", f"{name} line has no space after the turn mark at {x.start}", line))
    return out


def _places(items: Sequence[Item], kind: str) -> list[tuple[int, str]]:
    out, words = [], 0
    for x in items:
        words += x.kind == "word"
        if x.kind == kind:
            out.append((words, x.text))
    return out


def together(zh: str, py: str, z: Sequence[Item], p: Sequence[Item], readings: Mapping[str, Sequence[str]] | None) -> Found:
    """Cluster counts, marks and turns in step, the suffix 儿, readings."""
    out: Found = []
    zw, pw = word_texts(z), word_texts(p)
    aligned = len(zw) == len(pw)
    if not aligned:
        out.append(("CUM_MISMATCH", f"{len(zw)} clusters in Chinese, {len(pw)} in pinyin", zh))
    for kind, code in (("punct", "PUNCT_SYNC"), ("marker", "MARKER_SYNC")):
        a, b = _places(z, kind), _places(p, kind)
        if [t for _, t in a] != [t for _, t in b] or (aligned and a != b):
            out.append((code, f"{kind}s differ: {a} and {b}", zh))
    out += [("ERHUA_SPLIT", f"儿 stands alone at {x.start}", zh) for x in z if x.kind == "word" and x.text == "儿"]
    pairs = list(zip(zw, pw, strict=False)) if aligned else list(zip([w for w in zw if lang.is_erhua(w)], [w for w in pw if lang.is_full_er(w)], strict=False))
    out += [("ERHUA_SPLIT", f"{w} is written {s} in full", py) for w, s in pairs if lang.is_erhua(w) and lang.is_full_er(s)]
    if aligned and readings:
        out += [("PAIR_MISMATCH", f"{w} can't be read {s}", py) for w, s in pairs if not lang.fits_reading(w, s, readings)]
    return out


def check_cue(zh: str, py: str, readings: Mapping[str, Sequence[str]] | None = None) -> Found:
    """All content rules of one cue."""
    z, p = lex(zh), lex(py)
    out: Found = [] if word_texts(z) or word_texts(p) else [("EMPTY_CUE", "no word on either line", zh)]
    for line, items, name in ((zh, z, "Chinese"), (py, p, "pinyin")):
        out += spacing(line, name) + marks(line, items, name) + around(line, items, name)
    return out + together(zh, py, z, p, readings)


def _content(cues: DataFrame, readings: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Findings of (doc_id, cue_index, zh, py)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, code, n, message, line) for d, n, zh, py in zip(*(c.to_pylist() for c in batch.columns), strict=True) for code, message, line in check_cue(zh, py, readings)]
            columns = zip(*found, strict=True) if found else [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "code", "cue_index", "message", "line"])

    return cues.select("doc_id", "cue_index", "zh", "py").mapInArrow(run, "doc_id string, code string, cue_index int, message string, line string")


def _finding(code: str, message: Column, line: Column | None = None, cue: Column | None = None) -> Column:
    """A finding as a struct; the cue is the row's number unless another is given."""
    return F.struct(F.lit(code).alias("code"), (F.col("index") if cue is None else cue).cast("int").alias("cue_index"), message.alias("message"), F.coalesce(line if line is not None else F.lit(""), F.lit("")).alias("line"))


def _emit(df: DataFrame, when: Sequence[tuple[Column, Column]], each: Sequence[Column] = ()) -> DataFrame:
    """Findings of each row: those whose condition holds, and arrays of them.  All rules of a table are one pass over it."""
    found = F.array_compact(F.array(*[F.when(c, f) for c, f in when]))
    return df.select("doc_id", F.explode(F.concat(found, *each) if each else found).alias("f")).select("doc_id", "f.*")


def _in_order(b: DataFrame) -> DataFrame:
    """What the number should be, and the latest end before, for rows (doc_id, ordinal, index, end)."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("expected", F.coalesce(F.last("index", ignorenulls=True).over(w), F.lit(0)) + 1).withColumn("before", F.max("end").over(w))


def _sequence(at: Column) -> list[tuple[Column, Column]]:
    """Rules of numbers and stamps."""
    stamp = F.col("stamp")
    return [
        (F.col("index").isNull(), _finding("INDEX_SEQ", F.format_string("block %d has no number", "ordinal"), stamp, F.lit(None))),
        (F.col("index") != F.col("expected"), _finding("INDEX_SEQ", F.format_string("number %d where %d should be", "index", "expected"), stamp)),
        (F.col("start").isNull() & F.col("has_stamp"), _finding("TIMESTAMP_FORMAT", F.concat(F.lit("not a time stamp: "), "stamp"), stamp, at)),
        (F.col("start") >= F.col("end"), _finding("TIMESTAMP_ORDER", F.lit("start isn't before end"), stamp, at)),
        (F.col("start") < F.col("before"), _finding("TIMESTAMP_ORDER", F.format_string("starts at %s before %s", text.format_stamp(F.col("start")), text.format_stamp(F.col("before"))), stamp, at)),
    ]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    severity = F.create_map(*[x for k, v in R.SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    out = out.dropDuplicates(["doc_id", "code", "cue_index", "message"])
    return out.select("doc_id", "code", severity[F.col("code")].alias("severity"), "cue_index", "message", "line")


def is_vietnamese(sides: DataFrame) -> DataFrame:
    """doc_id, vi: no Han anywhere, letters, and Vietnamese letters or mostly blocks of one content line."""
    joined = F.array_join("lines", " ")
    flags = sides.groupBy("doc_id").agg(
        F.bool_or(joined.rlike(R.HAN_RULE)).alias("han"), F.bool_or(joined.rlike(r"\p{L}")).alias("letters"),
        F.bool_or(joined.rlike(f"[{R.VI_LETTERS}Ạ-ỹ]")).alias("marks"), F.count("*").alias("n"), F.count_if(F.size("lines") == 1).alias("single"),
    )
    return flags.select("doc_id", (~F.col("han") & F.col("letters") & (F.col("marks") | (2 * F.col("single") > F.col("n")))).alias("vi"))


def zh_findings(sides: DataFrame, readings: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The rules of Chinese and pinyin files."""
    b = sides.withColumn("n_lines", F.size("lines") + F.when(F.col("stamp") != "", 2).otherwise(1)).withColumn("has_stamp", F.col("n_lines") >= 2)
    shape = (F.col("n_lines") != 4, _finding("BLOCK_SHAPE", F.format_string("block %d has %d lines, not 4", "ordinal", "n_lines")))
    structure = _emit(_in_order(b), [shape, *_sequence(F.col("index"))])
    cues = b.where("start is not null and size(lines) >= 2").select("doc_id", "ordinal", F.col("index").alias("cue_index"), F.col("lines")[0].alias("zh"), F.col("lines")[1].alias("py"))
    return _union([structure, _content(cues, readings), name_findings(cues.where("cue_index is not null"))])


def name_findings(cues: DataFrame) -> DataFrame:
    """NAME_INCONSISTENT: a string of Han that is one cluster somewhere and several elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, o, n, zh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [None if R.HAN_RULE_RE.sub("", w) else w for w in word_texts(lex(zh))]  # a word that isn't Han ends a run
                if any(words):
                    rows.append((d, o << 32 | n, words))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], ["doc_id", "line", "w"])

    runs = cues.select("doc_id", "ordinal", "cue_index", "zh").mapInArrow(run, "doc_id string, line long, w array<string>")
    hits = relational.split_names(runs, ["doc_id"], "line", "w")
    found = _finding("NAME_INCONSISTENT", F.concat("text", F.lit(" is written "), "shown", F.lit(" here")), F.col("shown"), F.col("line").bitwiseAND(0xFFFFFFFF))
    return hits.select("doc_id", found.alias("f")).select("doc_id", "f.*")


def vi_findings(sides: DataFrame) -> DataFrame:
    """The rules of Vietnamese files."""
    b = _in_order(sides.withColumn("has_stamp", F.lit(True)))
    at = F.coalesce(F.col("index"), F.col("ordinal"))
    gap = "[" + R.SPACES.replace(" ", "\\x20").replace("\t", "\\t") + "]"
    said = F.exists("lines", lambda x: x.rlike(r"\S"))
    having = lambda pattern, code, message: F.transform(F.filter("lines", lambda x: x.rlike(pattern)), lambda x: _finding(code, F.lit(message), x, at))
    doubles = F.transform("lines", lambda x: F.transform(F.regexp_extract_all(x, F.lit(gap + "{2,}"), F.lit(0)), lambda m: _finding("DOUBLE_SPACE", F.format_string("%d spaces in a row", F.length(m)), x, at)))
    rules = [
        (~said, _finding("VI_EMPTY_LINE", F.lit("no Vietnamese line"), None, at)),
        (said & (F.size("lines") > 1), _finding("BLOCK_SHAPE", F.format_string("%d content lines, not 1", F.size("lines")), F.try_element_at("lines", F.lit(1)), at)),
    ]
    ends = [having("^" + gap, "VI_TRAILING_SPACE", "line begins with a space"), having(gap + "$", "VI_TRAILING_SPACE", "line ends with a space")]
    return _union([_emit(b, [*_sequence(at), *rules], [*ends, F.flatten(doubles)])])


def check(docs: DataFrame, readings: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All findings of subtitle texts (doc_id, text), by the rules of their language."""
    ship(docs.sparkSession)
    # each rule reads the blocks anew; the files are made, cut into blocks and given their language once
    sides = shared.written(srt.sides(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")), "sides")
    routed = shared.written(sides.join(is_vietnamese(sides), "doc_id", "left"), "routed")
    zh, vi = routed.where(~F.coalesce("vi", F.lit(False))).drop("vi"), routed.where("vi").drop("vi")
    return zh_findings(zh, readings).unionByName(vi_findings(vi))


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Findings of (doc_id, zh_text, vi_text): the Vietnamese rules, and block counts, stamps and turn marks in step."""
    ship(pairs.sparkSession)
    zh = srt.sides(pairs.select("doc_id", F.col("zh_text").alias("text")))
    vi = srt.sides(pairs.select("doc_id", F.col("vi_text").alias("text")))
    counts = relational.count_mismatch(zh, vi, ["doc_id"])
    b = zh.select("doc_id", "ordinal", F.col("stamp").alias("zh_stamp"), F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).alias("zh"))
    both = vi.join(b, ["doc_id", "ordinal"]).withColumn("vi_line", F.array_join("lines", " "))
    at = F.coalesce(F.col("index"), F.col("ordinal"))

    @F.pandas_udf("boolean")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        shape = lambda s: [(len(m), bool(m) and m[0][0] == 0) for m in (_places(lex(x), "marker") for x in s)]
        return pd.Series([x != y for x, y in zip(shape(a), shape(b), strict=True)])

    pair_rules = [
        (F.col("stamp") != F.col("zh_stamp"), _finding("VI_TIMESTAMP_DRIFT", F.concat("zh_stamp", F.lit(" and "), "stamp"), F.col("stamp"), at)),
        (F.col("turns"), _finding("VI_MARKER_SYNC", F.lit("turn marks differ"), F.col("vi_line"), at)),
    ]
    both = both.withColumn("turns", differ("zh", "vi_line"))
    unequal = counts.withColumn("index", F.lit(None))
    count_rule = [(F.lit(True), _finding("VI_BLOCK_COUNT", F.format_string("%d Chinese blocks, %d Vietnamese", "n_left", "n_right")))]
    return _union([vi_findings(vi).drop("severity"), _emit(unequal, count_rule), _emit(both, pair_rules)])
