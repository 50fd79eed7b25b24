"""Subtitle text as relations: strict blocks for the rules, tolerant blocks and cues for repair, transcripts, name tables."""

from __future__ import annotations

import json
import logging
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide import resources as R
from subtide import schemas as S
from subtide.functions import lang, lexing, text
from subtide.session import ship

_LOOSE = re.compile(R.STAMP_LOOSE)
_STRICT = re.compile(R.STAMP)
_ONLY_MARKS = set(R.MARKS) | set(".,?!:;()<>\"'-—…·~/|[]{}*+=&%#@$^`\\")


def strict_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block (from 1), lines: runs of lines that aren't blank.  One split by expression, no shuffle."""
    body = F.regexp_replace(text.normalise_lines(F.col("text")), r"(?U)^(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+$", "")
    blocks = F.filter(F.split(body, r"(?U)\n(?:[^\S\n]*\n)+"), lambda b: ~b.rlike(r"(?U)^\s*$"))
    return docs.select("doc_id", F.posexplode(blocks).alias("block", "body")).select("doc_id", (F.col("block") + 1).alias("block"), F.split("body", "\n").alias("lines"))


def _seconds(h: str, m: str, s: str, f: str) -> float:
    return int(h) * 3600 + int(m) * 60 + int(s) + int(f.ljust(3, "0")) / 1000.0


def scan_blocks(body: str) -> tuple[list[dict], list[str]]:
    """Blocks by their time stamps, and the lines before the first.

    A group of lines opens a block at each stamp; a group without one continues the
    block before it; a digit line right above a later stamp is that block's number.
    """
    lines = body.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿").split("\n")
    found: list[dict] = []
    orphans: list[str] = []
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        end = at
        while end < len(lines) and lines[end].strip():
            end += 1
        group = lines[at:end]
        stamps = [k for k, x in enumerate(group) if _LOOSE.match(x)]
        heads = [0] + [k - 1 if k - 1 > p and group[k - 1].strip().isdigit() else k for p, k in zip(stamps, stamps[1:], strict=False)]
        for n, k in enumerate(stamps):
            stop = max(k + 1, heads[n + 1]) if n + 1 < len(stamps) else len(group)
            found.append({"line_no": at + 1 + (k if n else 0), "head": group[heads[n] : k], "stamp": group[k], "content": group[k + 1 : stop]})
        if not stamps:
            (found[-1]["content"] if found else orphans).extend(group)
        at = end
    return found, orphans


def sort_content(lines: Sequence[str], readings: Mapping[str, Sequence[str]] | None = None, typed_v: bool = True) -> tuple[list[str], str | None, list[str]]:
    """A block's content lines as ([Chinese, pinyin], Vietnamese, set aside)."""
    join = lambda some: " ".join(x.strip() for x in some if x.strip())
    lines = list(lines)
    han = [bool(R.HAN_SOURCE_RE.search(x)) for x in lines]
    if len(lines) <= 1:
        return lines, None, []
    if not any(han):
        return (lines if len(lines) == 2 else [join(lines)]), None, []
    if all(han):
        doubled = len(lines) == 2 and "".join(lines[0].split()) == "".join(lines[1].split())
        return [lines[0] if doubled else join(lines)], None, []
    chinese = join(x for x, h in zip(lines, han, strict=True) if h)

    def kind(k: int) -> str:
        if han[k]:
            return "han"
        body = R.TAG_RE.sub(" ", lines[k]).strip()
        marks = all(c.isspace() or c in _ONLY_MARKS for c in body)
        return "pinyin" if lang.looks_like_pinyin(lines[k], chinese, readings, k == len(lines) - 1 and len(lines) >= 3 and not marks, typed_v) else "vi"

    kinds = [kind(k) for k in range(len(lines))]
    if kinds == ["han", "pinyin"]:
        return lines, None, []
    first = next(k for k, x in enumerate(kinds) if x != "han")
    pinyin = [k for k, x in enumerate(kinds) if x == "pinyin"]
    stray: list[int] = []
    if first and "han" not in kinds[first:]:
        lead = next((k for k in range(first, len(kinds)) if kinds[k] != "pinyin"), len(kinds))
        pinyin, stray = list(range(first, lead)), [k for k in pinyin if k >= lead]
    kept = [chinese] + ([join(lines[k] for k in pinyin)] if pinyin else [])
    return kept, join(x for x, k in zip(lines, kinds, strict=True) if k == "vi") or None, [lines[k] for k in stray]


def parse(body: str, readings: Mapping[str, Sequence[str]] | None = None, typed_v: bool = True) -> tuple[list[dict], list[str]]:
    """Blocks with their fields, and the orphan lines."""
    found, orphans = scan_blocks(body)
    out = []
    for n, b in enumerate(found, 1):
        label = b["head"][-1].strip() if b["head"] else ""
        ok = label.isdigit()
        index = int(label) if ok else n
        m = _LOOSE.match(b["stamp"]).groups()
        lines, vi, aside = sort_content(b["content"], readings, typed_v)
        out.append({
            "block": n, "index": index, "index_ok": ok, "start": _seconds(*m[:4]), "end": _seconds(*m[4:]), "stamp": b["stamp"], "lines": lines,
            "line_count": len(b["head"]) + 1 + len(b["content"]), "line_no": b["line_no"], "vi": vi, "set_aside": (b["head"][:-1] if ok else b["head"]) + aside,
        })
    return out, orphans


def parse_findings(blocks: Sequence[dict], orphans: Sequence[str]) -> list[tuple[str, int | None, str, str]]:
    """(code, cue, message, line) for what parsing met."""
    out = []
    for b in blocks:
        n = b["index"]
        if b["line_count"] != 4:
            out.append(("BLOCK_SHAPE", n, f"block at line {b['line_no']} has {b['line_count']} lines, not 4", ""))
        if not b["index_ok"]:
            out.append(("INDEX_SEQ", n, f"block at line {b['line_no']} has no number", ""))
        if not _STRICT.match(b["stamp"].strip()):
            out.append(("TIMESTAMP_FORMAT", n, "time stamp isn't HH:MM:SS,mmm --> HH:MM:SS,mmm", b["stamp"]))
        if len(b["lines"]) > 1:
            words = [sum(t.kind == "word" for t in lexing.tokenise(x)) for x in b["lines"][:2]]
            if words[0] != words[1]:
                out.append(("CUM_MISMATCH", n, f"{words[0]} clusters in Chinese, {words[1]} in pinyin", b["lines"][0]))
    aside = [(None, x) for x in orphans] + [(b["index"], x) for b in blocks for x in b["set_aside"]]
    return out + [("BLOCK_SHAPE", n, f"line set aside: {x.strip()}", x) for n, x in aside]


def tokens_of(block: dict, normalise: bool) -> list[lexing.Token]:
    if not block["lines"]:
        return []
    zh = lexing.tokenise(block["lines"][0], normalise)
    return zh if len(block["lines"]) == 1 else lexing.pair(zh, lexing.tokenise(block["lines"][1], normalise))[0]


#: Rows that are written together, at most one document more.
ROWS = 250


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    plain = pa.types.is_string(kind)  # what a file gives instead of a text is written out
    return pa.array([str(x) if plain and x is not None and not isinstance(x, str) else x for x in values] if plain else values, kind)


def _rows(docs: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make`` gives for each document, many documents' rows in a batch."""
    spark = docs.sparkSession
    ship(spark)
    shape = spark.createDataFrame([], schema).limit(0).toArrow().schema  # of no rows by the plan, without a job

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], shape.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(*batch.columns, strict=True):
                rows += make(doc.as_py(), unicodedata.normalize("NFC", body.as_py() or ""))
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, schema)


def blocks(docs: DataFrame, readings: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Tolerant blocks of each document."""
    order = [x.split()[0] for x in S.BLOCK.replace("array<string>", "a").split(", ")][1:]
    return _rows(docs, lambda doc, body: ((doc, *(b[k] for k in order)) for b in parse(body, readings)[0]), S.BLOCK)


def cues(docs: DataFrame, normalise: bool = False, readings: Mapping[str, Sequence[str]] | None = None, typed_v: bool = True) -> DataFrame:
    """Cues with their tokens, in the file's order and numbering; ``typed_v``: a v in a pinyin line is ü."""

    def make(doc, body):
        for pos, b in enumerate(parse(body, readings, typed_v)[0]):
            yield doc, pos, b["index"], b["start"], b["end"], [dict(t._asdict(), flags=list(t.flags)) for t in tokens_of(b, normalise)], b["vi"]

    return _rows(docs, make, S.CUE)


def findings(docs: DataFrame, readings: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """What parsing met, as findings."""

    def make(doc, body):
        return ((doc, code, R.SEVERITY[code], n, message, line) for code, n, message, line in parse_findings(*parse(body, readings)))

    return _rows(docs, make, S.FINDING)


def sides(docs: DataFrame) -> DataFrame:
    """The side-by-side view: doc_id, ordinal, index, start, end, stamp, lines."""
    b = strict_blocks(docs)
    stamp = F.trim(F.element_at("lines", 2))
    at = text.parse_stamp(stamp)
    digits = F.trim(F.element_at("lines", 1)).rlike(r"^\d+$")
    return b.select(
        "doc_id", F.col("block").alias("ordinal"), F.when(digits, F.expr("try_cast(trim(lines[0]) as int)")).alias("index"),
        at["start"].alias("start"), at["end"].alias("end"), F.coalesce(F.try_element_at("lines", F.lit(2)), F.lit("")).alias("stamp"), F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))).alias("lines"),
    )


def decode(content: Column) -> Column:
    """Text of uploaded bytes: byte order marks, then UTF-8, GB18030, Big5, CP1252, and UTF-8 with replacements."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(decode_bytes)

    return run(content)


def decode_bytes(raw: bytes | None) -> str:
    raw = bytes(raw or b"")
    order = ["utf-16"] if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-8-sig", "gb18030", "big5", "cp1252"]
    for name in order:
        try:
            body = raw.decode(name)
            break
        except UnicodeDecodeError:
            continue
    else:
        body = raw.decode("utf-8", "replace")
    return unicodedata.normalize("NFC", body.replace("\r\n", "\n").replace("\r", "\n"))


_WORD_IN = "word string, text string, w string, start double, begin double, t0 double, end double, stop double, t1 double, probability double, prob double, p double"
_SEGMENT_IN = f"id int, text string, start double, begin double, t0 double, end double, stop double, t1 double, no_speech_prob double, avg_logprob double, words array<struct<{', '.join(':'.join(x.split()) for x in _WORD_IN.split(', '))}>>"


def segments(docs: DataFrame) -> DataFrame:
    """Transcript segments from JSON: {segments}, {result}, {asr}, {data} or a bare list, with the usual aliases; an end before its start is the start."""
    seg = f"array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in _split_ddl(_SEGMENT_IN))}>>"
    body = F.when(F.ltrim("text").startswith("["), F.concat(F.lit('{"segments":'), F.col("text"), F.lit("}"))).otherwise(F.col("text"))
    parsed = F.from_json(body, f"segments {seg}, result {seg}, asr {seg}, data {seg}", {"mode": "PERMISSIVE"})
    rows = docs.select("doc_id", F.posexplode(F.coalesce(*[parsed[k] for k in ("segments", "result", "asr", "data")])).alias("n", "s"))
    pick = lambda x, *names: F.coalesce(*[x[n] for n in names])
    begin, end = pick(F.col("s"), "start", "begin", "t0"), pick(F.col("s"), "end", "stop", "t1")

    def word(w: Column) -> Column:
        a, b = F.coalesce(pick(w, "start", "begin", "t0"), F.lit(0.0)), pick(w, "end", "stop", "t1")
        return F.struct(F.coalesce(pick(w, "word", "text", "w"), F.lit("")).alias("word"), a.alias("start"), F.greatest(a, F.coalesce(b, a)).alias("end"), pick(w, "probability", "prob", "p").alias("probability"))

    begin = F.coalesce(begin, F.lit(0.0))
    return rows.select(
        "doc_id", F.coalesce("s.id", F.col("n") + 1).alias("id"), begin.alias("start"), F.greatest(begin, F.coalesce(end, begin)).alias("end"),
        F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce(F.transform("s.words", word), F.array().cast(f"array<{S.WORD}>")).alias("words"), "s.no_speech_prob", "s.avg_logprob",
    )


def _split_ddl(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def names(tables: DataFrame) -> DataFrame:
    """Name tables (doc_id, text: JSON) in any of their layouts, one row a name; ``corrupt`` where the JSON can't be read.

    Layouts: {han: pinyin}, {han: {entry}}, {names: ...} or {entries: ...} around either, and lists of entries.
    """
    schema = "doc_id string, corrupt boolean, han string, split array<string>, pinyin array<string>, type string, reason string, count int, vi string"

    def make(doc, body):
        try:
            data = json.loads(body)
        except ValueError:
            return [(doc, True, None, None, None, None, None, None, None)]
        while isinstance(data, dict) and (k := next((k for k in ("names", "entries") if isinstance(data.get(k), (dict, list))), None)):
            data = data[k]
        rows = [(k, v) for k, v in data.items()] if isinstance(data, dict) else [(e.get("han") or e.get("zh") or e.get("name"), e) for e in data if isinstance(e, dict)] if isinstance(data, list) else []
        return [_name(doc, han, v) for han, v in rows if han]

    return _rows(tables, make, schema)


def _name(doc, han: str, value) -> tuple:
    e = value if isinstance(value, dict) else {"pinyin": value}
    listed = lambda x: [str(y).strip() for y in x if str(y).strip()] if isinstance(x, (list, tuple)) else str(x or "").split()
    split, pinyin = listed(e.get("split") or e.get("tokens")), listed(e.get("pinyin") or e.get("py"))
    if "".join(split) != han:  # a split must spell the name again
        split = [han]
    count = e.get("count")
    return doc, False, han, split, pinyin, e.get("type"), e.get("reason"), int(count) if isinstance(count, int) and abs(count) < 1 << 31 else None, e.get("vi")


def config(overrides: Mapping | None = None, profile: str | None = None) -> dict:
    """Defaults, a profile and overrides, maps merged and lists replaced."""
    return merged(R.DEFAULTS, R.PROFILES.get(profile or "", {}), overrides or {})


def config_from(spark: SparkSession, path: str, overrides: Mapping | None = None, profile: str | None = None) -> dict:
    """The configuration of a JSON or YAML file over the defaults, its own ``profiles`` over the built-in ones; a missing or broken file counts as empty."""
    try:
        body = spark.read.text(path, wholetext=True).first()["value"]
        given = json.loads(body) if path.endswith(".json") else _yaml(body)
    except Exception as e:  # noqa: BLE001  (what isn't there or can't be read is not there)
        logging.getLogger(__name__).warning("%s isn't read: %s", path, e)
        given = {}
    given = dict(given) if isinstance(given, Mapping) else {}
    profiles = given.pop("profiles", None) or {}
    own = profiles.get(profile or "", {}) if isinstance(profiles, Mapping) else {}
    return merged(config(None, profile), given, own, overrides or {})


def merged(*parts: Mapping) -> dict:
    """Later parts over earlier ones: maps merge, lists and values replace."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _yaml(body: str) -> object:
    try:
        import yaml
    except ImportError as e:
        raise ValueError("no YAML reader is installed; use a JSON file") from e
    return yaml.safe_load(body)
