"""Whole subtitle files made from driver tables, through the readers, the rules and the writers, with the same questions in SQL.

A conversation is a file and a turn is a block.  The first words of a turn are its Chinese
line, in lower case its pinyin line; place in the conversation and its number choose what
is wrong with the block, one fault of each kind.  The SQL asks each rule's question of the
two lines, the number and the stamp, not of the kind of fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide import resources as R
from subtide import shared
from subtide.functions import text
from subtide.operators import relational as rel
from subtide.operators import rules, scan
from subtide.plans import names, page, report, review, stages
from subtide.sources import sinks, srt, versions

from .catalogue import LINES, LINT, lines, lint, query, table, turn_cues

#: Readings for the one character that is judged.
READINGS = {"好": ["hǎo", "hào"]}

# --- the files ----------------------------------------------------------------------------

#: What a block of each kind has for its lines, stamp, number and rest: (zh, py) around the words.
_FAULTS = {
    0: ("{z} 美国", "{p} měiguó"), 1: (" {z}", "{p}"), 2: ("{z}", "{p} "), 3: ("{z}  x", "{p} x"), 4: ("{z},", "{p},"), 5: ("{z}…", "{p}…"), 6: ("{z}—", "{p}—"), 7: ("{z} 。", "{p}。"),
    8: ("{z} x", "{p}"), 9: ("{z}。", "{p}"), 10: ("- {z}", "{p}"), 11: ("-{z}", "-{p}"), 12: ("……", "……"), 13: ("{z} 儿", "{p} ér"), 18: ("{z} 好", "{p} mā"), 19: ("{z} 美 国", "{p} měi guó"),
}
_SIDE = lambda side: "CASE kind " + " ".join(f"WHEN {k} THEN '" + v[side].replace("{z}", "' || words || '").replace("{p}", "' || lower(words) || '") + "'" for k, v in _FAULTS.items()) + " ELSE " + ("words", "lower(words)")[side] + " END"
_CLOCK = "printf('00:%02d:%02d,000', s // 60, s % 60)"

#: doc_id, n, kind, index, zh, py, begin, finish (seconds), stamp, extra (a fifth line).
BLOCKS = f"""(SELECT *, CASE WHEN kind = 15 THEN replace(clock, ',000 -->', ',00 -->') ELSE clock END AS stamp, CASE WHEN kind = 14 THEN 'extra' END AS extra,
  n + CASE WHEN kind = 17 THEN 100 ELSE 0 END AS index, {_SIDE(0)} AS zh, {_SIDE(1)} AS py FROM (
  SELECT *, printf('00:%02d:%02d,000', begin // 60, begin % 60) || ' --> ' || printf('00:%02d:%02d,000', finish // 60, finish % 60) AS clock FROM (
  SELECT *, 10 * n AS begin, 10 * n + CASE WHEN kind = 16 THEN 0 ELSE 5 END AS finish FROM (
  SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 AND doc_id % 3 = 0 THEN 19 ELSE 1 + (doc_id * 7 + n * 5) % 18 END AS kind FROM (
  SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS n,
    CASE WHEN regexp_matches(text, '[A-Za-z]') THEN array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 5), ' ') ELSE 'none' END AS words FROM conversations)))))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of ``BLOCKS``, by expressions."""
    found = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 5)
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.expr("cast(row_number() over (partition by conv_id order by turn) as int)").alias("n"), F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise("none").alias("words"))
    kind = F.when(F.col("n") == 1, 0).when((F.col("n") == 2) & (F.col("doc_id") % 3 == 0), 19).otherwise(1 + (F.col("doc_id") * 7 + F.col("n") * 5) % 18).cast("int")
    d = d.withColumn("kind", kind).withColumn("begin", 10 * F.col("n")).withColumn("finish", F.col("begin") + F.when(F.col("kind") == 16, 0).otherwise(5))
    clock = F.concat(text.format_stamp(F.col("begin").cast("double")), F.lit(" --> "), text.format_stamp(F.col("finish").cast("double")))
    d = d.withColumn("stamp", F.when(F.col("kind") == 15, F.replace(clock, F.lit(",000 -->"), F.lit(",00 -->"))).otherwise(clock))
    side = lambda i: F.expr(_SIDE(i))
    return d.withColumn("zh", side(0)).withColumn("py", side(1)).withColumn("extra", F.when(F.col("kind") == 14, "extra")).withColumn("index", F.col("n") + F.when(F.col("kind") == 17, 100).otherwise(0))


def documents_of(blocks: DataFrame, *parts: str) -> DataFrame:
    """Files (doc_id, text) of blocks, their lines in the order of ``parts``."""
    body = F.concat_ws("\n", *parts)
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("body")))), lambda x: x["body"]), "\n\n")
    return blocks.groupBy("doc_id").agg(text_.alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(blocks(spark, sf_dir), "index", "stamp", "zh", "py", "extra")


# --- rules of Chinese and pinyin files ----------------------------------------------------

_READ = "kind <> 15"  # lines of a block without a readable stamp are not judged
_WORDS = "len(list_filter(string_split({0}, ' '), lambda x: regexp_matches(x, '\\p{{L}}')))"
#: Findings of a block, asked of its lines.
RULES = {
    "LEADING_SPACE": f"CASE WHEN {_READ} THEN (zh LIKE ' %')::INT + (py LIKE ' %')::INT ELSE 0 END",
    "TRAILING_SPACE": f"CASE WHEN {_READ} THEN (zh LIKE '% ')::INT + (py LIKE '% ')::INT ELSE 0 END",
    "DOUBLE_SPACE": f"CASE WHEN {_READ} THEN len(regexp_extract_all(zh, ' {{2,}}')) + len(regexp_extract_all(py, ' {{2,}}')) ELSE 0 END",
    "ASCII_PUNCT": f"CASE WHEN {_READ} THEN len(regexp_extract_all(zh || py, '[,.?!:;]')) ELSE 0 END",
    "ELLIPSIS_FORM": f"CASE WHEN {_READ} THEN len(list_filter(regexp_extract_all(zh || ' ' || py, '…+'), lambda x: length(x) <> 2)) ELSE 0 END",
    "DASH_FORM": f"CASE WHEN {_READ} THEN len(list_filter(regexp_extract_all(zh || ' ' || py, '—+'), lambda x: length(x) <> 2)) ELSE 0 END",
    "SPACE_AROUND_PUNCT": f"CASE WHEN {_READ} THEN len(regexp_extract_all(zh || '|' || py, ' [。，…—]')) ELSE 0 END",
    "MARKER_SPACING": f"CASE WHEN {_READ} THEN regexp_matches(zh, '^-[^ ]')::INT + regexp_matches(py, '^-[^ ]')::INT ELSE 0 END",
    "CUM_MISMATCH": f"CASE WHEN {_READ} THEN ({_WORDS.format('zh')} <> {_WORDS.format('py')})::INT ELSE 0 END",
    "PUNCT_SYNC": f"CASE WHEN {_READ} THEN (regexp_replace(zh, '[^。，,…—]', '', 'g') <> regexp_replace(py, '[^。，,…—]', '', 'g'))::INT ELSE 0 END",
    "MARKER_SYNC": f"CASE WHEN {_READ} THEN ((zh LIKE '-%') <> (py LIKE '-%'))::INT ELSE 0 END",
    "EMPTY_CUE": f"CASE WHEN {_READ} THEN (NOT regexp_matches(zh || py, '\\p{{L}}'))::INT ELSE 0 END",
    "ERHUA_SPLIT": f"CASE WHEN {_READ} THEN (zh LIKE '% 儿')::INT ELSE 0 END",
    "PAIR_MISMATCH": f"CASE WHEN {_READ} THEN (zh LIKE '% 好' AND NOT regexp_matches(py, ' (hǎo|hào)$'))::INT ELSE 0 END",
    "BLOCK_SHAPE": "(4 + (extra IS NOT NULL)::INT <> 4)::INT",
    "TIMESTAMP_FORMAT": "(NOT regexp_matches(stamp, '^\\d\\d:\\d\\d:\\d\\d,\\d{3} --> \\d\\d:\\d\\d:\\d\\d,\\d{3}$'))::INT",
    "TIMESTAMP_ORDER": f"CASE WHEN {_READ} THEN (begin >= finish)::INT ELSE 0 END",
    "INDEX_SEQ": "(index <> coalesce(lag(index) OVER (PARTITION BY doc_id ORDER BY n), 0) + 1)::INT",
    "NAME_INCONSISTENT": "(zh LIKE '% 美 国' AND row_number() OVER (PARTITION BY doc_id, zh LIKE '% 美 国' ORDER BY n) = 1 AND bool_or(zh LIKE '% 美国') OVER (PARTITION BY doc_id))::INT",
}


def _rule(code: str) -> None:
    """A query of the findings of one rule, a row for each block that has some."""

    def run(spark, sf_dir):
        found = rules.check(files(spark, sf_dir), READINGS).where(F.col("code") == code)
        return found.groupBy("doc_id", F.col("cue_index").alias("cue")).agg(F.count("*").alias("n"))

    run.__name__ = f"rule_{code.lower()}"
    query(f"SELECT doc_id::VARCHAR AS doc_id, index AS cue, n::BIGINT AS n FROM (SELECT doc_id, index, {RULES[code]} AS n FROM {BLOCKS}) WHERE n > 0")(run)


for _code in RULES:
    _rule(_code)

_ALL = " UNION ALL ".join(f"SELECT '{c}' AS code, '{R.SEVERITY[c]}' AS severity, doc_id, index, {x} AS n FROM b" for c, x in RULES.items())


@query(f"WITH b AS (SELECT * FROM {BLOCKS}) SELECT severity, code, sum(n)::BIGINT AS n FROM ({_ALL}) WHERE n > 0 GROUP BY ROLLUP (severity, code)")
def findings_summary(spark, sf_dir):
    return rel.summary(rules.check(files(spark, sf_dir), READINGS))


@query(f"WITH b AS (SELECT * FROM {BLOCKS}) SELECT doc_id::VARCHAR AS doc_id, code, index AS cue FROM ({_ALL}) WHERE n > 0 AND NOT (code = 'CUM_MISMATCH' AND index < 4) AND NOT (code = 'INDEX_SEQ' AND index > 100)")
def findings_but_known(spark, sf_dir):
    f = rules.check(files(spark, sf_dir), READINGS)
    known = spark.range(1, 200).select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), w.alias("w")) for c, w in (("CUM_MISMATCH", F.col("id") < 4), ("INDEX_SEQ", F.col("id") > 100))])).alias("k"), F.col("id").cast("int").alias("cue_index")).where("k.w").select("k.code", "cue_index")
    return rel.without_known(f, known).select("doc_id", "code", F.col("cue_index").alias("cue")).distinct()


@query(f"""WITH b AS (SELECT * FROM {BLOCKS}), f AS (SELECT doc_id, index, count(*) FILTER (n > 0) AS codes, sum(n) AS n FROM ({_ALL}) GROUP BY doc_id, index)
SELECT doc_id::VARCHAR AS doc_id, index, n::BIGINT AS n FROM f WHERE n > 0""")
def findings_by_cue(spark, sf_dir):
    cues = blocks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "index")
    return report.grouped_findings(cues, rules.check(files(spark, sf_dir), READINGS)).where("findings is not null").select("doc_id", "index", F.size("findings").cast("long").alias("n"))


# --- readers over the same files -----------------------------------------------------------


@query(f"SELECT doc_id::VARCHAR AS doc_id, n AS block, 4 + (extra IS NOT NULL)::INT AS n_lines, index::VARCHAR AS first FROM {BLOCKS}")
def strict_blocks_of_files(spark, sf_dir):
    d = srt.strict_blocks(files(spark, sf_dir))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("block").cast("int").alias("block"), F.size("lines").alias("n_lines"), F.col("lines")[0].alias("first"))


@query(f"SELECT doc_id::VARCHAR AS doc_id, n AS block, index, begin::DOUBLE AS start, finish::DOUBLE AS \"end\", 4 + (extra IS NOT NULL)::INT AS line_count FROM {BLOCKS}")
def tolerant_blocks(spark, sf_dir):
    return srt.blocks(files(spark, sf_dir)).select("doc_id", "block", "index", "start", "end", "line_count")


@query(f"SELECT doc_id, n AS ordinal, index, CASE WHEN {_READ} THEN begin::DOUBLE END AS start, CASE WHEN {_READ} THEN finish::DOUBLE END AS \"end\", zh, py FROM {BLOCKS}")
def sides_of_files(spark, sf_dir):
    d = srt.sides(files(spark, sf_dir))
    return d.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "index", "start", "end", F.col("lines")[0].alias("zh"), F.col("lines")[1].alias("py"))


@query(f"""SELECT doc_id::VARCHAR AS doc_id, index AS cue, 'BLOCK_SHAPE' AS code FROM {BLOCKS} WHERE extra IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, index, 'TIMESTAMP_FORMAT' FROM {BLOCKS} WHERE NOT {_READ}""")
def parse_findings(spark, sf_dir):
    return srt.findings(files(spark, sf_dir)).where("code in ('BLOCK_SHAPE', 'TIMESTAMP_FORMAT', 'INDEX_SEQ')").select("doc_id", F.col("cue_index").alias("cue"), "code").distinct()


@query(f"SELECT doc_id, count(*) AS expected, count(*) FILTER (NOT {_READ}) AS bad_stamps, count(*) AS parsed, 0::BIGINT AS missing FROM {BLOCKS} GROUP BY doc_id")
def integrity(spark, sf_dir):
    d = report.integrity(files(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "expected", "bad_stamps", "parsed", "missing")


# three lines without Han are one line to the tolerant reader
@query(f"SELECT doc_id::VARCHAR AS doc_id, n - 1 AS pos, ({_WORDS.format('zh')} + CASE WHEN extra IS NOT NULL THEN {_WORDS.format('py')} + 1 ELSE 0 END)::INT AS words FROM {BLOCKS}")
def cue_words(spark, sf_dir):
    d = srt.cues(files(spark, sf_dir))
    return d.select("doc_id", "pos", F.size(F.filter("tokens", lambda t: t["kind"] == "word")).alias("words"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def decode_uploads(spark, sf_dir):
    body = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode(body, "UTF-16")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(body, "UTF-8"))).otherwise(F.encode(body, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(srt.decode(raw), 256).alias("sha"))


# --- Vietnamese files and pairs -------------------------------------------------------------

PAIRS = """(SELECT *, kind <> 5 OR n < most AS there, CASE kind WHEN 1 THEN '' WHEN 2 THEN 'chào ' || words || ' ' WHEN 4 THEN '- chào ' || words ELSE 'chào ' || words END AS vi, 10 * n AS begin, 10 * n + (kind = 3)::INT AS drift FROM (
  SELECT *, max(n) OVER (PARTITION BY doc_id) AS most, (doc_id * 3 + CASE WHEN doc_id % 4 = 1 THEN 5 - doc_id * 3 % 6 ELSE n * 5 END) % 6 AS kind FROM (
  SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS n,
    CASE WHEN regexp_matches(text, '[A-Za-z]') THEN array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 5), ' ') ELSE 'none' END AS words FROM conversations)))"""
#: Findings of a pair of blocks; files of kind 5 lack their last Vietnamese block.
VI_RULES = {
    "VI_EMPTY_LINE": ("n", "there AND trim(vi) = ''"), "VI_TRAILING_SPACE": ("n", "there AND vi LIKE '% '"), "VI_TIMESTAMP_DRIFT": ("n", "there AND begin <> drift"),
    "VI_MARKER_SYNC": ("n", "there AND vi LIKE '-%'"), "VI_BLOCK_COUNT": ("NULL", "n = most AND NOT there"),
}


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, zh_text, vi_text as in ``PAIRS``."""
    b = blocks(spark, sf_dir).select("doc_id", "n", "words", (10 * F.col("n")).alias("begin")).withColumn("most", F.expr("max(n) over (partition by doc_id)"))
    b = b.withColumn("kind", ((F.col("doc_id") * 3 + F.when(F.col("doc_id") % 4 == 1, 5 - F.col("doc_id") * 3 % 6).otherwise(F.col("n") * 5)) % 6).cast("int"))
    vi = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.concat(F.lit("chào "), "words", F.lit(" "))).when(F.col("kind") == 4, F.concat(F.lit("- chào "), "words")).otherwise(F.concat(F.lit("chào "), "words"))
    stamp = lambda at: F.concat(text.format_stamp(at.cast("double")), F.lit(" --> "), text.format_stamp((F.col("begin") + 5).cast("double")))
    b = b.withColumn("vi", vi).withColumn("zh", F.concat("words", F.lit(" 好"))).withColumn("py", F.concat("words", F.lit(" hǎo"))).withColumn("stamp", stamp(F.col("begin"))).withColumn("drift", stamp(F.col("begin") + (F.col("kind") == 3).cast("int")))
    zh = documents_of(b, "n", "stamp", "zh", "py").withColumnRenamed("text", "zh_text")
    return zh.join(documents_of(b.where("kind <> 5 or n < most"), "n", "drift", "vi").withColumnRenamed("text", "vi_text"), "doc_id", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "zh_text", F.coalesce("vi_text", F.lit("")).alias("vi_text"))


def _vi_rule(code: str) -> None:
    cue, holds = VI_RULES[code]

    def run(spark, sf_dir):
        return rules.check_pairs(pairs(spark, sf_dir)).where(F.col("code") == code).select("doc_id", F.col("cue_index").alias("cue")).distinct()

    run.__name__ = f"rule_{code.lower()}"
    query(f"SELECT doc_id::VARCHAR AS doc_id, {cue}::INT AS cue FROM {PAIRS} WHERE {holds}")(run)


for _code in VI_RULES:
    _vi_rule(_code)

# --- writers ------------------------------------------------------------------------------

_SHOWN = """(SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, array_to_string(w, ' ') AS zh, a, b FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w, turn * 100000 AS a, turn * 100000 + 100 * length(text) AS b FROM conversations) WHERE len(w) > 0)"""
_STAMP = lambda x: f"printf('%02d:%02d:%02d,%03d', ({x} // 3600000)::INT, ({x} // 60000 % 60)::INT, ({x} // 1000 % 60)::INT, ({x} % 1000)::INT)"
_CENTI = lambda x: f"printf('%d:%02d:%02d.%02d', ({x} // 3600000)::INT, ({x} // 60000 % 60)::INT, ({x} // 1000 % 60)::INT, ({x} % 1000 // 10)::INT)"


@query(f"SELECT doc_id, string_agg(number || chr(10) || {_STAMP('a')} || ' --> ' || {_STAMP('b')} || chr(10) || zh || chr(10) || lower(zh) || chr(10) || chr(10), '' ORDER BY turn) AS text FROM {_SHOWN} GROUP BY doc_id")
def emit_srt(spark, sf_dir):
    return sinks.srt(turn_cues(spark, sf_dir))


@query(f"SELECT doc_id, string_agg(number || chr(10) || {_STAMP('a')} || ' --> ' || {_STAMP('b')} || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Dòng ' || turn ELSE zh END || chr(10) || chr(10), '' ORDER BY turn) AS text FROM {_SHOWN} GROUP BY doc_id")
def emit_vi_srt(spark, sf_dir):
    c = turn_cues(spark, sf_dir)
    said = c.select("doc_id", "pos", F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" Dòng  "), F.col("pos").cast("string"), F.lit("　"))).alias("line"))
    return sinks.vi_srt(c, said)


@query(f"""SELECT doc_id, string_agg('Dialogue: 0,' || {_CENTI('a')} || ',' || {_CENTI('b')} || ',Default,,0,0,0,,' || zh || '\\N{{\\fnArial Unicode MS\\fs34}}' || lower(zh), chr(10) ORDER BY turn) AS events FROM {_SHOWN} GROUP BY doc_id""")
def emit_ass(spark, sf_dir):
    events = F.regexp_extract_all("text", F.lit("Dialogue: [^\n]*"), F.lit(0))
    return sinks.ass(turn_cues(spark, sf_dir)).select("doc_id", F.array_join(events, "\n").alias("events"))


@query(f"""SELECT doc_id, string_agg('Dialogue: 0,' || {_CENTI('a')} || ',' || {_CENTI('b')} || ',Han,,0,0,0,,' || zh || '\\N{{\\fnArial Unicode MS\\fs30\\c&H00C8C8C8}}' || lower(zh) || '\\N{{\\fnArial Unicode MS\\fs34\\c&H0000E5FF}}Dòng ' || turn, chr(10) ORDER BY turn) AS events FROM {_SHOWN} GROUP BY doc_id""")
def emit_bilingual_ass(spark, sf_dir):
    c = turn_cues(spark, sf_dir)
    said = c.select("doc_id", "pos", F.concat(F.lit("Dòng "), F.col("pos").cast("string")).alias("line"))
    events = F.regexp_extract_all("text", F.lit("Dialogue: [^\n]*"), F.lit(0))
    return sinks.bilingual_ass(c, said).select("doc_id", F.array_join(events, "\n").alias("events"))


@query(f"SELECT doc_id, number::INT AS index, zh, lower(zh) AS pinyin, {_STAMP('a')} AS start_time, {_STAMP('b')} AS end_time, len(string_split(zh, ' '))::INT AS tokens FROM {_SHOWN}")
def emit_bundle(spark, sf_dir):
    cue = "array<struct<index:int,start_time:string,end_time:string,tokens:array<struct<kind:string,text:string,pinyin:string>>,zh:string,pinyin:string>>"
    d = sinks.bundle(turn_cues(spark, sf_dir)).select("doc_id", F.inline(F.from_json("bundle", f"cues {cue}")["cues"]))
    return d.select("doc_id", "index", "zh", "pinyin", "start_time", "end_time", F.size("tokens").alias("tokens"))


@query(f"SELECT doc_id::VARCHAR AS doc_id, count(*) AS cues, sum(len(string_split(zh, ' ')))::BIGINT AS words FROM {_SHOWN} GROUP BY doc_id")
def bundles_read_back(spark, sf_dir):
    """Bundles through the reader of stage documents."""
    d = report.stage_documents(sinks.bundle(turn_cues(spark, sf_dir)).select("doc_id", F.col("bundle").alias("text")))
    return d.groupBy("doc_id").agg(F.count("*").alias("cues"), F.sum(F.size(F.filter("tokens", lambda t: t["kind"] == "word"))).alias("words"))


# --- transcripts --------------------------------------------------------------------------

_SEGMENTS = f"(SELECT doc_id, line_no AS id, CASE WHEN line_no % 7 = 5 THEN ' ' WHEN line_no % 7 = 6 THEN '…!' ELSE line || ' ' || line_no END AS text FROM {LINES})"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as transcript segments, all different; some blank, some of marks alone."""
    line = F.when(F.col("line_no") % 7 == 5, " ").when(F.col("line_no") % 7 == 6, "…!").otherwise(F.concat("line", F.lit(" "), F.col("line_no").cast("string")))
    return lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("id"), line.alias("text"))


@query(f"SELECT doc_id, id, trim(text) AS text, (row_number() OVER (PARTITION BY doc_id ORDER BY id))::INT AS index FROM {_SEGMENTS} WHERE id % 7 < 5")
def clean_segments(spark, sf_dir):
    kept, _ = report.clean_segments(segments(spark, sf_dir), cfg={"repeat_max": 0})
    return kept.select("doc_id", "id", "text", "index")


@query(f"""SELECT doc_id, count(*) AS segments_in, count(*) FILTER (id % 7 < 5) AS segments_out, count(*) FILTER (id % 7 = 5) AS empty, count(*) FILTER (id % 7 = 6) AS punct_only FROM {_SEGMENTS} GROUP BY doc_id""")
def cleanup_stats(spark, sf_dir):
    s = segments(spark, sf_dir)
    d = report.cleanup_stats(s, *report.clean_segments(s, cfg={"repeat_max": 0}))
    return d.select("doc_id", "segments_in", "segments_out", "empty", "punct_only")


@query(r"""SELECT conv_id::VARCHAR AS doc_id, count(*) AS words, min(a)::DOUBLE AS start, max(b)::DOUBLE AS "end" FROM (SELECT conv_id, turn * 10 AS a, turn * 10 + 5 AS b, unnest(regexp_extract_all(regexp_replace(text, '[^A-Za-z]', '', 'g'), '.')) FROM conversations) GROUP BY conv_id""")
def words_from_text(spark, sf_dir):
    word = "array<struct<word:string,start:double,end:double,probability:double>>"
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("text"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 5).alias("end"), F.array().cast(word).alias("words"))
    return report.words_of(c).groupBy("doc_id").agg(F.count("*").alias("words"), F.min("start").alias("start"), F.max("end").alias("end"))


# --- names, translation, agreement ---------------------------------------------------------

_NAMES = "(SELECT p_partkey, string_split(p_name, ' ') AS w, p_brand FROM part)"


@query(f"SELECT p_partkey::VARCHAR AS doc_id, array_to_string(w, '') AS han, len(w)::INT AS parts, p_partkey::INT AS count, p_brand AS vi FROM {_NAMES}")
def name_tables(spark, sf_dir):
    """Name tables in three layouts, by the part's number."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"), "p_brand")
    entry = F.struct(F.col("w").alias("split"), F.transform("w", lambda x: F.lower(x)).alias("pinyin"), F.col("p_partkey").cast("int").alias("count"), F.col("p_brand").alias("vi"))
    han = F.array_join("w", "")
    plain = F.to_json(F.create_map(han, entry))
    listed = F.to_json(F.array(entry.withField("han", han)))
    body = F.when(F.col("p_partkey") % 3 == 0, plain).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"names":'), plain, F.lit("}"))).otherwise(F.concat(F.lit('{"entries":'), listed, F.lit("}")))
    d = srt.names(p.select(F.col("p_partkey").cast("string").alias("doc_id"), body.alias("text")))
    return d.select("doc_id", "han", F.size("split").alias("parts"), "count", "vi")


@query("""SELECT conv_id AS doc_id, turn AS pos, CASE WHEN text = '' THEN text ELSE '[' || text || ']' END AS line, 'provider' AS source FROM conversations""")
def translate_echo(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("text").alias("zh"))
    cache = spark.createDataFrame([], "task string, model string, key string, value string")
    return names.translate(c, cache, names.echo_translator, "echo")


@query("""WITH p AS (SELECT DISTINCT string_split(text, ' ')[1] AS han FROM benchmark WHERE length(string_split(text, ' ')[1]) >= 4)
SELECT han, sum((length(text) - length(replace(text, han, ''))) // length(han))::BIGINT AS count FROM p, documents WHERE contains(text, han) GROUP BY han""")
def detected_names(spark, sf_dir):
    one = F.split("text", " ")[0]
    p = table(spark, sf_dir, "benchmark").where(F.length(one) >= 4).select(one.alias("han"), F.array(one).alias("split"), F.array(F.lower(one)).alias("pinyin"), F.lit("x").alias("type"))
    return names.detect_names(table(spark, sf_dir, "documents").select("text"), p).select("han", F.col("count").cast("long").alias("count"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'unanswered' WHEN p_size % 4 = 1 THEN 'same' WHEN p_size % 4 = 2 THEN 'accepted' ELSE 'rejected' END AS status FROM part")
def reading_answers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("zh"), F.lit("a").alias("before"), F.array(F.lit("a"), F.lit("b")).alias("options"))
    said = F.when(F.col("p_size") % 4 == 1, "a").when(F.col("p_size") % 4 == 2, "b").otherwise("c")
    answers = p.where("p_size % 4 <> 0").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(said.alias("pinyin"))).alias("answer"))
    return names.accept_readings(items, answers).select("id", "status")


@query("SELECT doc_id, lang, count, vi FROM (SELECT doc_id, coalesce(l.q, d.lang) AS lang, coalesce(l.n, d.n_chars) AS count, l.v AS vi FROM (SELECT doc_id, quality::VARCHAR AS q, toxic AS n, 'v' || toxic AS v FROM labels) l FULL JOIN documents d USING (doc_id))")
def merged_names(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("han"), none.alias("split"), none.alias("pinyin"), F.col("quality").cast("string").alias("type"), F.col("toxic").cast("long").alias("count"), F.concat(F.lit("v"), F.col("toxic").cast("string")).alias("vi"))
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("han"), none.alias("split"), none.alias("pinyin"), F.col("lang").alias("type"), F.col("n_chars").alias("count"), F.lit(None).cast("string").alias("vi"))
    return names.merge_names(a, b).select(F.col("han").alias("doc_id"), F.col("type").alias("lang"), "count", "vi")


@query(f"""SELECT count(*) AS compared, avg((upper(a) = a)::INT) AS agreement FROM (SELECT regexp_extract(line, '\\p{{L}}') AS a, coalesce(lag(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no), 1) AS before FROM {LINES}) WHERE a <> '' AND before % 4 <> 0""")
def case_agreement(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("line", F.when(F.length("line") % 4 == 0, F.concat("line", F.lit("…… "))).otherwise(F.col("line")))
    return rel.case_agreement(d, d.withColumn("line", F.upper("line")), ["doc_id", "line_no"], ["doc_id"], ["line_no"])


@query("SELECT han, vi FROM (SELECT p_name || ' ' || p_partkey AS han, p_brand AS vi FROM part) WHERE trim(vi) <> '' ORDER BY length(han) DESC, han LIMIT 120")
def glossary_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("han"), F.col("p_brand").alias("vi"))
    return rel.glossary(p)


@query("""SELECT doc_id, pos FROM (SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id))::INT AS pos, length(lang) AS n, quality FROM labels JOIN documents USING (doc_id)) WHERE quality = 0 ORDER BY n, doc_id LIMIT 120""")
def uncertain_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    d = scan.numbered(d, ["lang"], ["doc_id"], "pos").withColumn("pos", F.col("pos").cast("int"))
    flags = F.when(F.col("quality") == 0, F.array(F.lit("HETERONYM"))).otherwise(F.array(F.lit("NAME")))
    token = F.struct(F.lit("word").alias("kind"), F.col("lang").alias("zh"), F.lit("x").alias("pinyin"), F.lit(1.0).alias("confidence"), F.lit("ai").alias("source"), flags.alias("flags"))
    return rel.uncertain(d.select("doc_id", "pos", F.array(token).alias("tokens"))).select("doc_id", "pos")


# --- proofreading, edits and reruns --------------------------------------------------------


def proofreader(task: str, items: list[dict]) -> list[dict]:
    """Answers by the length of a line: sometimes none, sometimes one that isn't allowed."""
    if task == "T3":
        return [{"id": x["id"], "case": ("upper", "lower", "maybe")[len(x["word"]) % 3]} for x in items if len(x["line"]) % 5]
    return [{"id": x["id"], "punct": ("。", "none", "，", "?", "！")[len(x["line"]) % 5]} for x in items if len(x["line"]) % 7]


def open_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues whose first word's case is open in every second cue."""
    flagged = lambda t, i: t.withField("flags", F.when((i == 0) & (F.col("pos") % 2 == 0), F.array(F.lit("CASE_AMBIG"))).otherwise(t["flags"]))
    return turn_cues(spark, sf_dir).select("doc_id", "pos", F.transform("tokens", flagged).alias("tokens"))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "task string, model string, key string, value string")


#: doc_id, pos, line, first word, names or not, and the answers of ``proofreader`` within the limits.
_OPEN = """o AS (SELECT doc_id, pos, line, w, CASE WHEN asked3 AND r3 <= 120 AND length(line) % 5 <> 0 THEN ['upper', 'lower', 'maybe'][length(w) % 3 + 1] END AS said,
  CASE WHEN line <> '' AND r4 <= 150 AND length(line) % 7 <> 0 THEN ['。', 'none', '，', '?', '！'][length(line) % 5 + 1] END AS mark, line <> '' AND r4 <= 150 AS asked4, asked3 AND r3 <= 120 AS asked3
  FROM (SELECT *, row_number() OVER (PARTITION BY asked3 ORDER BY doc_id, pos) AS r3, row_number() OVER (PARTITION BY line <> '' ORDER BY doc_id, pos) AS r4 FROM (
  SELECT conv_id AS doc_id, turn AS pos, array_to_string(t, ' ') AS line, t[1] AS w, turn % 2 = 0 AND len(t) > 0 AS asked3 FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS t FROM conversations))))"""


@query(f"WITH {_OPEN} SELECT doc_id, pos, CASE WHEN said IS NULL THEN 'unanswered' WHEN said = 'maybe' THEN 'rejected' WHEN said = 'lower' THEN 'confirmed' ELSE 'applied' END AS status FROM o WHERE asked3")
def case_proposals(spark, sf_dir):
    items = review.case_items(open_cues(spark, sf_dir))
    return review.judge_case(names.answered(items, _none(spark), "T3", "m", proofreader)).select("doc_id", "pos", "status")


@query(f"WITH {_OPEN} SELECT doc_id, pos, line, CASE WHEN mark IS NULL THEN 'unanswered' WHEN mark = 'none' THEN 'confirmed' WHEN mark = '?' THEN 'rejected' ELSE 'applied' END AS status, CASE WHEN mark NOT IN ('none', '?') THEN mark END AS mark FROM o WHERE asked4")
def end_mark_proposals(spark, sf_dir):
    items = review.end_items(open_cues(spark, sf_dir))
    return review.judge_ends(names.answered(items, _none(spark), "T4", "m", proofreader)).select("doc_id", "pos", "line", "status", "mark")


#: The same for all open cues, without limits.
_ALL_OPEN = """o AS (SELECT *, CASE WHEN asked3 AND length(line) % 5 <> 0 THEN ['upper', 'lower', 'maybe'][length(w) % 3 + 1] END AS said,
  CASE WHEN line <> '' AND length(line) % 7 <> 0 THEN ['。', 'none', '，', '?', '！'][length(line) % 5 + 1] END AS mark FROM (
  SELECT conv_id AS doc_id, turn AS pos, array_to_string(t, ' ') AS line, t[1] AS w, turn % 2 = 0 AND len(t) > 0 AS asked3 FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS t FROM conversations)))"""


@query(f"""WITH {_ALL_OPEN}, p AS (SELECT *, coalesce(said = 'upper', false) AS decided, CASE WHEN mark NOT IN ('none', '?') THEN mark END AS added, lag(CASE WHEN mark NOT IN ('none', '?') THEN mark END) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM o)
SELECT doc_id, pos, line || coalesce(added, '') AS zh, CASE WHEN w IS NULL THEN '' WHEN decided OR (before IN ('。', '！') AND length(w) <= 9) THEN upper(w[1]) || lower(w[2:]) ELSE lower(w) END AS first,
  w IS NOT NULL AND NOT decided AND coalesce(before IN ('。', '！'), false) AND length(w) <= 9 AS recased FROM p""")
def proofread_cues(spark, sf_dir):
    """Words of more than nine letters are names, whose case stays."""
    c = turn_cues(spark, sf_dir).select("doc_id", "pos", "tokens")
    ambig = lambda t, i: t.withField("flags", F.when((i == 0) & (F.col("pos") % 2 == 0), F.array_union(t["flags"], F.array(F.lit("CASE_AMBIG")))).otherwise(t["flags"]))
    c = c.withColumn("tokens", F.transform("tokens", ambig))
    done, _ = review.proofread(c, _none(spark), proofreader, "m")
    first = F.try_element_at(F.filter("tokens", lambda t: t["kind"] == "word"), F.lit(1))["pinyin"]
    return done.select("doc_id", "pos", sinks.render(F.col("tokens")).alias("zh"), F.coalesce(first, F.lit("")).alias("first"), "recased")


@query("""SELECT doc_id, string_agg(number || chr(10) || stamp || chr(10) || zh || chr(10) || lower(zh) || chr(10) || chr(10), '' ORDER BY turn) AS zh_file, string_agg(number || chr(10) || stamp || chr(10) || 'Dòng ' || turn || chr(10) || chr(10), '' ORDER BY turn) AS vi_file
FROM (SELECT *, """ + f"{_STAMP('a')} || ' --> ' || {_STAMP('b')}" + f""" AS stamp FROM {_SHOWN}) GROUP BY doc_id""")
def editor_save(spark, sf_dir):
    c = turn_cues(spark, sf_dir)
    rows = c.select("doc_id", "pos", "start", "end", F.concat(F.lit(" "), sinks.render(F.col("tokens"))).alias("zh"), F.concat(sinks.render(F.col("tokens"), "pinyin"), F.lit("  ")).alias("pinyin"), F.concat(F.lit("Dòng  "), F.col("pos").cast("string")).alias("vi"))
    zh, vi = review.edited_files(rows)
    return zh.withColumnRenamed("text", "zh_file").join(vi.withColumnRenamed("text", "vi_file"), "doc_id")


@query("""SELECT 'first' AS lap, * FROM (VALUES (1, 'read', 'run'), (2, 'count', 'run'), (3, 'rank', 'run')) t(number, key, done) UNION ALL SELECT 'again', * FROM (VALUES (1, 'read', 'reused'), (2, 'count', 'reused'), (3, 'rank', 'reused')) t(number, key, done)
UNION ALL SELECT 'names', * FROM (VALUES (1, 'read', 'reused'), (2, 'count', 'run'), (3, 'rank', 'run')) t(number, key, done) UNION ALL SELECT 'short', * FROM (VALUES (1, 'read', 'reused'), (2, 'count', 'reused'), (3, 'rank', 'skipped')) t(number, key, done)""")
def stage_reruns(spark, sf_dir):
    """What four laps over one folder did: a first run, the same again, one with another name table, one without the last stage."""
    folder, d = shared.folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    plan = [stages.Stage(1, "read", lambda t: t.where("lang is not null")), stages.Stage(2, "count", lambda t: t.groupBy("lang").agg(F.count("*").alias("n"))), stages.Stage(3, "rank", lambda t: t.orderBy("n"), "rank")]
    out = []
    for lap, known, skip in (("first", 0, ()), ("again", 0, ()), ("names", 1, ()), ("short", 1, ("rank",))):
        force = 2 if stages.changed_since(spark, folder, "names", spark.range(known)) else None
        out += [(lap, *x) for x in stages.run(d, plan, folder, force, skip)[1]]
    return spark.createDataFrame(out, "lap string, number int, key string, done string")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang")
def stage_results(spark, sf_dir):
    """The table of the last stage, after a second lap that is forced from the second stage on."""
    folder, d = shared.folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    plan = [stages.Stage(1, "read", lambda t: t.where("lang is not null")), stages.Stage(2, "source", lambda t: t.where("source is not null")), stages.Stage(3, "count", lambda t: t.groupBy("lang").agg(F.count("*").alias("n")))]
    stages.run(d, plan, folder)
    return stages.run(d, plan, folder, force_from=2)[0]


@query("""SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE source END AS text FROM documents WHERE doc_id % 7 <> 0)""")
def versioned_files(spark, sf_dir):
    """Files after four commits: two thirds of them, all with a fifth changed, the same again, and without a seventh."""
    path, d = shared.folder(spark), table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("text"))
    changed = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    for some in (d.where("doc_id % 3 <> 0"), changed, changed, changed.where("doc_id % 7 <> 0")):
        versions.commit(some, path, replace=some is not changed)
    return versions.current(spark, path).select("doc_id", "text", F.col("_version").alias("version"))


def report_sections(spark: SparkSession, sf_dir: str) -> list[page.Section]:
    """The datasets behind a file's report: its numbers, where it is from, what each role took, distribution, translation, findings, what to look at, cleaning, parsing, files, exports."""
    docs, c = shared.written(files(spark, sf_dir), "files"), turn_cues(spark, sf_dir)
    found = rules.check(docs, READINGS)
    turns = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    stats = shared.written(report.document_stats(c), "stats")
    said = shared.written(sinks.shown(c).drop("tokens"), "shown")
    translated = turns.select("doc_id", F.when(F.col("turn") % 3 == 0, "cache").when(F.col("turn") % 3 == 1, "provider").otherwise("kept").alias("source"))
    s = segments(spark, sf_dir)
    kept, dropped = report.clean_segments(s, cfg={"repeat_max": 0})
    looked = c.withColumn("tokens", F.transform(F.filter("tokens", lambda t: F.array_contains(t["flags"], "NAME")), lambda t: t.withField("flags", F.array(F.lit("CASE_AMBIG")))))
    parsed = srt.blocks(docs).where(F.col("line_count") != 4).select("doc_id", "block", "line_count")
    return [
        page.Section("summary", "Summary", stats.select("doc_id", "cues", "words", "name_tokens", "empty_cues")),
        page.Section("source", "Source", turns.groupBy("doc_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("characters"))),
        page.Section("timings", "Time by role", turns.groupBy("doc_id", "role").agg((F.sum(F.length("text")) / 10).alias("seconds"))),
        page.Section("distribution", "Distribution", report.against_target(stats)),
        page.Section("translation", "Translation", names.translation_counts(translated)),
        page.Section("findings", "Findings", found.select("doc_id", "severity", "code", "cue_index", "message", "line"), [F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2), "cue_index", "code", "message"]),
        page.Section("review", "To look at", rel.review_queue(looked).select("doc_id", "pos", "tok", "zh", "flag")),
        page.Section("cleaning", "Cleaning", dropped.select("doc_id", "id", "reason", "text")),
        page.Section("parsing", "Parsing", parsed),
        page.Section("files", "Files", sinks.srt_of(said).select("doc_id", F.lit("srt").alias("kind"), F.length("text").alias("size"))),
        page.Section("exports", "Exports", sinks.ass_of(said).select("doc_id", F.lit("ass").alias("kind"), F.sha2("text", 256).alias("sha256"))),
    ]


_COUNTED = """SELECT conv_id::VARCHAR AS doc_id, count(DISTINCT role) AS timings, sum(len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 9)))::BIGINT AS review, bool_or(regexp_matches(text, '[A-Za-z]')) AS shown FROM conversations GROUP BY conv_id"""


@query(f"""WITH b AS (SELECT * FROM {BLOCKS}), f AS (SELECT doc_id::VARCHAR AS doc_id, sum(n) FILTER (n > 0)::BIGINT AS findings FROM ({_ALL}) GROUP BY doc_id), c AS ({_COUNTED}),
e AS (SELECT doc_id::VARCHAR AS doc_id, count(*) FILTER (extra IS NOT NULL) AS parsing FROM b GROUP BY doc_id), k AS (SELECT doc_id::VARCHAR AS doc_id, count(*) FILTER (id % 7 >= 5) AS cleaning FROM {_SEGMENTS} GROUP BY doc_id)
SELECT doc_id, 1::BIGINT AS summary, timings, 6::BIGINT AS distribution, coalesce(findings, 0) AS findings, review, coalesce(cleaning, 0) AS cleaning, parsing, CASE WHEN shown THEN 1 ELSE 0 END::BIGINT AS files,
 11 - (coalesce(findings, 0) = 0)::INT - (review = 0)::INT - (coalesce(cleaning, 0) = 0)::INT - (parsing = 0)::INT - 2 * (NOT shown)::INT AS cards,
 1 + 1 + timings + 6 + 1 + least(coalesce(findings, 0), 200) + least(review, 200) + least(coalesce(cleaning, 0), 200) + least(parsing, 200) + CASE WHEN shown THEN 2 ELSE 0 END + cards AS lines
FROM c JOIN f USING (doc_id) JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)""")
def report_pages(spark, sf_dir):
    d = page.pages(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), report_sections(spark, sf_dir))
    n = lambda k: F.coalesce(F.col("counts")[k], F.lit(0)).cast("long").alias(k)
    return d.select("doc_id", *map(n, ("summary", "timings", "distribution", "findings", "review", "cleaning", "parsing", "files")), F.size("counts").alias("cards"), F.regexp_count("html", F.lit("<tr>")).cast("long").alias("lines"))


# --- column functions ---------------------------------------------------------------------


@query(f"""SELECT doc_id, code, line_no AS cue_index, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, line_no NULLS LAST, code) AS place FROM
(SELECT doc_id, code, CASE WHEN code < 'E' THEN 'warn' WHEN code < 'P' THEN 'info' ELSE 'error' END AS severity, CASE WHEN n % 5 = 0 THEN NULL ELSE line_no END AS line_no FROM {LINT} WHERE n > 0) QUALIFY line_no IS NOT NULL""")
def findings_in_order(spark, sf_dir):
    f = lint(spark, sf_dir).where("n > 0").select("doc_id", "code", F.when(F.col("code") < "E", "warn").when(F.col("code") < "P", "info").otherwise("error").alias("severity"), F.when(F.col("n") % 5 != 0, F.col("line_no")).alias("cue_index"), F.lit("").alias("message"))
    return rel.report_order(f).where("cue_index is not null").select("doc_id", "code", "cue_index", F.col("place").cast("long").alias("place"))


@query(f"SELECT code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, code) AS place FROM {LINT} WHERE n > 0 GROUP BY code")
def findings_by_code(spark, sf_dir):
    return rel.code_histogram(lint(spark, sf_dir).where("n > 0")).select("code", "n", F.col("place").cast("long").alias("place"))


#: Beginnings of words, in the case that they have: vowels in all places, v for ü.
_SYLLABLES = "(SELECT DISTINCT left(x, 4) AS s FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x FROM documents))"
_AT = "coalesce(nullif(strpos(lower(s), 'a'), 0), nullif(strpos(lower(s), 'o'), 0), nullif(strpos(lower(s), 'e'), 0), nullif(length(regexp_extract(lower(s), '^.*iu')), 0), nullif(length(regexp_extract(lower(s), '^.*ui')), 0), nullif(length(regexp_extract(lower(s), '^.*[aoeiuv]')), 0))"


@query(f"""SELECT s, t::INT AS tone, CASE WHEN p IS NULL OR t = 5 THEN s WHEN v IN ('v', 'V') THEN left(s, p - 1) || v || ['̄', '́', '̌', '̀'][t] || substr(s, p + 1) ELSE left(s, p - 1) || translate(v, 'aeiouAEIOU', ['āēīōūĀĒĪŌŪ', 'áéíóúÁÉÍÓÚ', 'ǎěǐǒǔǍĚǏǑǓ', 'àèìòùÀÈÌÒÙ'][t]) || substr(s, p + 1) END AS toned,
CASE WHEN p IS NULL OR t = 5 OR v IN ('v', 'V') THEN 5 ELSE t END::INT AS read FROM (SELECT *, substr(s, p, 1) AS v FROM (SELECT s, {_AT} AS p, unnest(range(1, 6)) AS t FROM {_SYLLABLES}))""")
def tones_written(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("x")).select(F.left("x", F.lit(4)).alias("s")).distinct()
    d = d.select("s", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tone")).withColumn("toned", text.set_tone(F.col("s"), F.col("tone")))
    return d.select("s", "tone", "toned", text.tone_of(F.col("toned")).alias("read"))


@query("""SELECT x, k, CASE WHEN regexp_matches(lower(y), '([aeiouvn]|ng)[eé]r$') THEN left(y, length(y) - 2) || CASE WHEN lower(left(y, length(y) - 2)) LIKE '%r' THEN '' ELSE 'r' END WHEN lower(y) LIKE '%r' OR y = '' THEN y ELSE y || 'r' END AS short
FROM (SELECT x, k, x || ['', 'er', 'ér', 'Er'][k] AS y FROM (SELECT DISTINCT x, unnest(range(1, 5)) AS k FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x FROM documents)))""")
def erhua_spelling(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("x")).distinct()
    d = d.select("x", F.posexplode(F.array(*[F.lit(e) for e in ("", "er", "ér", "Er")])).alias("k", "e"))
    return d.select("x", (F.col("k") + 1).cast("long").alias("k"), text.erhua_pinyin(F.concat("x", "e")).alias("short"))


@query(f"SELECT doc_id, line_no, translate(line, 'aeiou', '个们来国说') AS line FROM {LINES}")
def simplified_lines(spark, sf_dir):
    written = F.translate("line", "aeiou", "個們來國說")
    return lines(spark, sf_dir).select("doc_id", "line_no", text.simplified(written, dict(zip("個們來國說", "个们来国说", strict=True))).alias("line"))


@query(r"""SELECT doc_id, CASE WHEN c = '' THEN 'output' ELSE regexp_replace(c, '[ .]+$', '') END AS stem FROM (SELECT doc_id, CASE WHEN strlen(c) > 200 THEN left(c, list_max(list_filter(range(0, 121), lambda n: strlen(left(c, n::INT)) <= 200))::INT) ELSE c END AS c FROM (
SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(translate(t, '<>:"/\|?*', '         '), '[\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120) AS c FROM (
SELECT doc_id, ' ..' || replace(translate(left(text, 60 + doc_id % 90), 'aeiou', '好们é/:'), chr(10), chr(9)) || '?' AS t FROM documents)))""")
def safe_stems(spark, sf_dir):
    name = F.concat(F.lit(" .."), F.translate(F.translate(F.left("text", (60 + F.col("doc_id") % 90).cast("int")), "aeiou", "好们é/:"), "\n", "\t"), F.lit("?"))
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_stem(name).alias("stem"))


@query("""SELECT doc_id, list_aggregate(list_distinct(list_concat(CASE WHEN quality = 0 THEN ['NAME'] ELSE [] END, CASE WHEN toxic = 1 THEN ['HETERONYM'] ELSE [] END, ['AI_APPLIED', 'NAME'])), 'count') AS n, quality = 0 AS named FROM labels""")
def flags_united(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("quality") == 0, "NAME"), F.when(F.col("toxic") == 1, "HETERONYM")))
    d = table(spark, sf_dir, "labels").select("doc_id", "quality", text.flag_union(flags, "AI_APPLIED", "NAME").alias("f"))
    return d.select("doc_id", F.size("f").cast("long").alias("n"), (F.element_at("f", 1) == "NAME").alias("named"))



@query(f"SELECT doc_id, line_no, lower(line) AS bare, replace(regexp_replace(lower(line), '[^a-z]', '', 'g'), 'v', 'u') AS key FROM {LINES} WHERE regexp_matches(line, '^[ -~]*$')")
def tones_stripped(spark, sf_dir):
    toned = F.translate("line", "aeiou", "āéǐòǔ")
    return lines(spark, sf_dir).where(F.col("line").rlike("^[ -~]*$")).select("doc_id", "line_no", text.strip_tones(toned).alias("bare"), text.pinyin_key(toned).alias("key"))


@query(f"SELECT doc_id, line_no, len(regexp_extract_all(line, '[aeiou]'))::INT AS han, length(regexp_replace(line, '\\s', '', 'g'))::INT AS dense FROM {LINES}")
def han_counts(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("line", F.translate("line", "aeiou", "一二三四五"))
    return d.select("doc_id", "line_no", text.han_count(F.col("line")).alias("han"), text.dense_length(F.col("line")).alias("dense"))


@query("""SELECT doc_id, k, p = '' OR regexp_matches(p, '^[ \t\n]*$') AS blank, NOT regexp_matches(p, '^[ \t\n]*$') AND regexp_matches(p, '^[\\s.,;:!?()"''<>-]*$') AS marks
FROM (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS p FROM (SELECT doc_id, string_split_regex(text, '[A-Za-z]+') AS x FROM documents WHERE regexp_matches(text, '^[\n -~]*$')))""")
def blanks_and_marks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("^[\n -~]*$")).select("doc_id", F.posexplode(F.split("text", "[A-Za-z]+", -1)).alias("k", "p"))
    return d.select("doc_id", F.col("k").cast("long").alias("k"), text.is_blank(F.col("p")).alias("blank"), text.is_marks_only(F.col("p")).alias("marks"))


@query(f"SELECT doc_id, line_no, regexp_extract(line, '^[^\\p{{L}}]*') || upper(substr(line, length(regexp_extract(line, '^[^\\p{{L}}]*')) + 1, 1)) || substr(line, length(regexp_extract(line, '^[^\\p{{L}}]*')) + 2) AS line FROM {LINES}")
def capitalised(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", text.capitalise(F.col("line")).alias("line"))


@query("""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN '♪' ELSE trim(regexp_replace(regexp_replace(regexp_replace(text, '\\s', ' ', 'g'), ' +([,.?!:;)…])', '\\1', 'g'), ' {2,}', ' ', 'g')) END AS line
FROM conversations WHERE NOT regexp_matches(text, '\\( |^ *- ')""")
def vi_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"\( |^ *- "))
    wide = F.replace(F.replace("text", F.lit(", "), F.lit("，")), F.lit(". "), F.lit("。"))
    return c.select("conv_id", "turn", text.vi_line(wide, F.col("text")).alias("line"))


@query("SELECT page_id, replace(translate(html, '{}', '｛｝'), chr(10), '\\N') AS text FROM pages WHERE NOT contains(html, chr(13))")
def ass_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~F.contains("html", F.lit("\r"))).select("page_id", text.ass_text(F.col("html")).alias("text"))


@query("""SELECT event_id, printf('%d:%02d:%02d.%02d', (cs // 360000)::INT, (cs // 6000 % 60)::INT, (cs // 100 % 60)::INT, (cs % 100)::INT) AS at FROM (SELECT event_id, round_even(value * 100, 0)::BIGINT AS cs FROM events)""")
def ass_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.ass_time(F.col("value")).alias("at"))
