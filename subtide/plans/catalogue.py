"""The operators as queries over driver tables, each with the same question in SQL where SQL can ask it.

A document is ``documents.doc_id`` and its lines are cues; words are ``events`` of a user by
(ts, event_id), start at ts, end ``value`` seconds later; turns are ``conversations``.  The
tables have no Han, so operators on Han run over small literal tables as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide import resources as R
from subtide.functions import text
from subtide.operators import matching
from subtide.operators import relational as rel
from subtide.operators import sequence as seq
from subtide.plans import fix, names, report
from subtide.sources import sinks, srt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, line_no, line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return d.withColumn("line_no", F.col("line_no").cast("long"))


LINES = "(SELECT doc_id, lang, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"


def micros():
    """Microseconds of ``ts``, which has no zone, whatever the session's zone is."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, word, start, end."""
    e = table(spark, sf_dir, "events")
    start = micros() / 1000000.0
    return e.select("user_id", "event_id", F.col("event_type").alias("word"), start.alias("start"), (start + F.col("value")).alias("end"))


WORDS = "(SELECT user_id, event_id, event_type AS word, epoch_us(ts) / 1000000.0 AS start, epoch_us(ts) / 1000000.0 + value AS \"end\" FROM events)"

# --- findings over documents --------------------------------------------------------------

LINT = f"""(SELECT doc_id, lang, line_no, 'ASCII_PUNCT' AS code, len(regexp_extract_all(line, '[,?!:;()<>"]')) + len(list_filter(regexp_extract_all(line, '[.]+'), lambda x: len(x) = 1)) AS n FROM {LINES}
UNION ALL SELECT doc_id, lang, line_no, 'ELLIPSIS_FORM', len(list_filter(regexp_extract_all(line, '[.]+'), lambda x: len(x) > 1)) FROM {LINES}
UNION ALL SELECT doc_id, lang, line_no, 'DASH_FORM', len(regexp_extract_all(line, '[-]{{2,}}')) FROM {LINES}
UNION ALL SELECT doc_id, lang, line_no, 'DOUBLE_SPACE', len(regexp_extract_all(line, ' {{2,}}')) FROM {LINES}
UNION ALL SELECT doc_id, lang, line_no, 'SPACE_AROUND_PUNCT', len(regexp_extract_all(line, ' [,.!?;:]')) FROM {LINES})"""


def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, line_no, code, n for native line rules: one scan, the rules as a small array to explode."""
    found = lambda pattern: F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    dots = found("[.]+")
    each = {
        "ASCII_PUNCT": F.size(found('[,?!:;()<>"]')) + F.size(F.filter(dots, lambda x: F.length(x) == 1)),
        "ELLIPSIS_FORM": F.size(F.filter(dots, lambda x: F.length(x) > 1)), "DASH_FORM": F.size(found("[-]{2,}")),
        "DOUBLE_SPACE": F.size(found(" {2,}")), "SPACE_AROUND_PUNCT": F.size(found(" [,.!?;:]")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("code"), v.cast("long").alias("n")) for k, v in each.items()])
    return lines(spark, sf_dir).select("doc_id", "lang", "line_no", F.explode(rows).alias("r")).select("doc_id", "lang", "line_no", "r.code", "r.n")


@query(f"SELECT doc_id, sum(n) AS n FROM {LINT} WHERE code = 'ASCII_PUNCT' GROUP BY doc_id")
def lint_ascii_punct(spark, sf_dir):
    return lint(spark, sf_dir).where("code = 'ASCII_PUNCT'").groupBy("doc_id").agg(F.sum("n").alias("n"))


@query("""SELECT doc_id, count(*) FILTER (p LIKE ' %') AS leading, count(*) FILTER (p LIKE '% ') AS trailing, count(*) AS pieces
FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?]')) AS p FROM documents) GROUP BY doc_id""")
def lint_lead_space(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[.!?]", -1)).alias("p"))
    return p.groupBy("doc_id").agg(F.count_if(F.col("p").startswith(" ")).alias("leading"), F.count_if(F.col("p").endswith(" ")).alias("trailing"), F.count("*").alias("pieces"))


@query("""SELECT conv_id, turn, len(list_filter(regexp_extract_all(t, '[.]+'), lambda x: len(x) > 1)) AS ellipses, len(regexp_extract_all(t, '[-—]{1,}')) AS dashes
FROM (SELECT conv_id, turn, regexp_replace(text, '[.] ', '... ', 'g') AS t FROM conversations)""")
def lint_ellipsis_dash(spark, sf_dir):
    t = F.regexp_replace("text", "[.] ", "... ")
    runs = F.filter(F.regexp_extract_all(t, F.lit("[.]+"), F.lit(0)), lambda x: F.length(x) > 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(runs).cast("long").alias("ellipses"), F.size(F.regexp_extract_all(t, F.lit("[-—]{1,}"), F.lit(0))).cast("long").alias("dashes"))


@query(rf"SELECT page_id, len(regexp_extract_all(html, '(?i){R.TAG}')) AS tags FROM pages")
def lint_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?i)" + R.TAG), F.lit(0))).cast("long").alias("tags"))


@query(f"SELECT code, '{R.SEVERITY['ASCII_PUNCT']}' AS severity, sum(n) AS n, count(*) FILTER (n > 0) AS lines FROM {LINT} GROUP BY code")
def lint_summary(spark, sf_dir):
    severity = F.create_map(*[F.lit(x) for c in ("ASCII_PUNCT", "ELLIPSIS_FORM", "DASH_FORM", "DOUBLE_SPACE", "SPACE_AROUND_PUNCT") for x in (c, R.SEVERITY[c])])[F.col("code")]
    return lint(spark, sf_dir).groupBy("code").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("lines")).select("code", severity.alias("severity"), "n", "lines")


@query(f"SELECT lang, code, sum(n) AS n FROM {LINT} GROUP BY ROLLUP (lang, code)")
def lint_rollup(spark, sf_dir):
    return lint(spark, sf_dir).rollup("lang", "code").agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, line_no, w FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+')) AS w FROM {LINES})")
def inner_hyphen_words(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", F.explode(text.inner_hyphens(F.col("line"))).alias("w"))


_VI = f"[{R.VI_LETTERS}Ạ-ỹ]"


@query(f"""SELECT doc_id, bool_or(regexp_matches(line, '{_VI}')) AND NOT bool_or(regexp_matches(line, '[㐀-䶿一-鿿]')) AND bool_or(regexp_matches(line, '\\p{{L}}')) AS vi FROM {LINES} GROUP BY doc_id""")
def vi_like_docs(spark, sf_dir):
    c = F.col("line")
    return lines(spark, sf_dir).groupBy("doc_id").agg((F.bool_or(c.rlike(_VI)) & ~F.bool_or(c.rlike(R.HAN_RULE)) & F.bool_or(c.rlike(r"\p{L}"))).alias("vi"))


# --- sequences ----------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM {LINES}),
i AS (SELECT *, sum(CASE WHEN coalesce(prev = line AND line <> '', false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l)
SELECT doc_id, line_no, line, repeat_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) AS repeat_no FROM i) WHERE repeat_no <= 2""")
def repeat_trim_exact(spark, sf_dir):
    same = (F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no")) == F.col("line")) & (F.col("line") != "")
    return seq.repeat_trim(lines(spark, sf_dir), ["doc_id"], ["line_no"], same, 2).select("doc_id", "line_no", "line", F.col("repeat_no").cast("long").alias("repeat_no"))


@query()
def repeat_trim_fuzzy(spark, sf_dir):
    s = lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("id"), F.col("line").alias("text"))
    return fix.drop_repeats(s)


@query(f"""SELECT user_id, event_id, greatest(start, cursor) AS start, greatest("end", greatest(start, cursor)) AS "end"
FROM (SELECT *, coalesce(max(greatest(start, "end")) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS cursor FROM {WORDS})""")
def timeline_repair(spark, sf_dir):
    # the order is that of the words as they came; the repaired start never changes it
    w = words(spark, sf_dir).withColumn("at", F.col("start"))
    return seq.timeline_repair(w, ["user_id"], ["at", "event_id"]).select("user_id", "event_id", "start", "end")


@query(f"""SELECT word, event_id, start, before FROM (SELECT *, max("end") OVER (PARTITION BY word ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {WORDS}) WHERE start < before""")
def overlap_findings(spark, sf_dir):
    return seq.overlaps(words(spark, sf_dir), ["word"], ["start", "event_id"], few_keys=True).select("word", "event_id", "start", "before")


@query("""SELECT user_id, event_id, coalesce(last, 0) + 1 AS expected FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE event_id <> coalesce(last, 0) + 1""")
def index_gap_findings(spark, sf_dir):
    return seq.index_breaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("user_id", "event_id", "expected")


@query(f"""WITH g AS (SELECT *, start - lag("end") OVER (PARTITION BY user_id ORDER BY start, event_id) AS gap FROM {WORDS}),
i AS (SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, event_id) AS island FROM g)
SELECT user_id, island, min(start) AS start, max("end") AS "end", count(*) AS n_words FROM i GROUP BY user_id, island""")
def silence_islands(spark, sf_dir):
    d = seq.silence_islands(words(spark, sf_dir), ["user_id"], ["start", "event_id"], 1800.0)
    return d.groupBy("user_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words"))


@query(f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER o AS i, lead(start) OVER o AS next_start, lead("end") OVER o AS next_end, lead(length(word)) OVER o AS next_dense FROM {WORDS} WINDOW o AS (PARTITION BY user_id ORDER BY start, event_id)),
r AS (SELECT user_id, 0::BIGINT AS i, '' AS text, NULL::DOUBLE AS start, NULL::DOUBLE AS fin, 0::BIGINT AS dense, 0::BIGINT AS n, NULL::DOUBLE AS first, NULL::VARCHAR AS reason FROM w WHERE i = 1 UNION ALL
 SELECT user_id, i, text, start, fin, dense, n, first, CASE WHEN next_start IS NULL THEN 'eof' WHEN next_start - own_end > 7200 THEN 'silence' WHEN dense + next_dense > 60 OR next_end - first > 86400 THEN 'limit' END FROM (
 SELECT w.user_id, w.i, CASE WHEN reason IS NULL THEN text ELSE '' END || word AS text, CASE WHEN reason IS NULL THEN least(r.start, w.start) ELSE w.start END AS start, CASE WHEN reason IS NULL THEN greatest(fin, w."end") ELSE w."end" END AS fin,
  CASE WHEN reason IS NULL THEN dense ELSE 0 END + length(word) AS dense, CASE WHEN reason IS NULL THEN n ELSE 0 END + 1 AS n, CASE WHEN reason IS NULL THEN coalesce(first, w.start) ELSE w.start END AS first, next_start, next_end, next_dense, w."end" AS own_end
 FROM r JOIN w ON w.user_id = r.user_id AND w.i = r.i + 1))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS index, start, fin AS "end", text, reason, n AS n_words FROM r WHERE reason IS NOT NULL""")
def cue_pack(spark, sf_dir):
    return seq.cue_pack(words(spark, sf_dir), ["user_id"], ["start", "event_id"], {"max_duration": 86400.0, "silence": 7200.0, "max_chars": 30})


_MS = lambda x: f"round_even(({x}) * 1000, 0) / 1000"
_TIMED = lambda rows: f"""SELECT user_id, i, a, CASE WHEN b <= a THEN {_MS('a + 0.01')} ELSE b END AS b FROM (SELECT *, {_MS('s')} AS a, {_MS('greatest(want, s + 0.01)')} AS b FROM (
 SELECT *, CASE WHEN nxt IS NULL THEN greatest(e, s + 60) ELSE least(greatest(e, s + 60), greatest(e, nxt)) END AS want FROM (SELECT *, greatest(fin, s) AS e FROM ({rows}))))"""  # noqa: E731


@query(f"""WITH RECURSIVE w AS (SELECT user_id, start, "end" AS fin, row_number() OVER o AS i, lead(start) OVER o AS nxt FROM {WORDS} WINDOW o AS (PARTITION BY user_id ORDER BY start, event_id)),
r AS ({_TIMED('SELECT *, start AS s FROM w WHERE i = 1')} UNION ALL {_TIMED('SELECT w.user_id, w.i, w.fin, w.nxt, greatest(w.start, r.b) AS s FROM r JOIN w ON w.user_id = r.user_id AND w.i = r.i + 1')})
SELECT user_id, i::INT AS index, a AS start, b AS "end" FROM r""")
def enforce_timing(spark, sf_dir):
    return seq.enforce_timing(words(spark, sf_dir), ["user_id"], ["start", "event_id"], {"min_duration": 60.0})


_TOKENS = f"""(SELECT doc_id, line_no, unnest(range(len(t))) AS k, unnest(t) AS tok FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[\\p{{L}}0-9]+|[.!?,;:]') AS t FROM {LINES}))"""
_EVENT = "CASE WHEN tok IN ('.', '!', '?') THEN 'upper' ELSE 'lower' END"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("line", F.lit(r"[\p{L}0-9]+|[.!?,;:]"), F.lit(0))
    return lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(found).alias("k", "tok")).withColumn("k", F.col("k").cast("long"))


@query(f"""SELECT doc_id, state, count(*) AS n, count(*) FILTER (regexp_matches(tok, '^\\p{{Lu}}')) AS upper FROM
(SELECT doc_id, tok, coalesce(lag({_EVENT}) OVER (PARTITION BY doc_id ORDER BY line_no, k), 'upper') AS state FROM {_TOKENS}) WHERE tok NOT IN ('.', '!', '?', ',', ';', ':') GROUP BY doc_id, state""")
def case_state(spark, sf_dir):
    event = F.when(F.col("tok").isin(".", "!", "?"), "upper").otherwise("lower")
    d = seq.case_state(tokens(spark, sf_dir), ["doc_id"], ["line_no", "k"], event).where(~F.col("tok").isin(".", "!", "?", ",", ";", ":"))
    return d.groupBy("doc_id", "state").agg(F.count("*").alias("n"), F.count_if(F.col("tok").rlike(r"^\p{Lu}")).alias("upper"))


@query("""SELECT conv_id, turn, coalesce(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context_before FROM conversations""")
def neighbour_context(spark, sf_dir):
    return seq.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "context_before")


@query(f"""SELECT doc_id, line_no, k, tok, sum(CASE WHEN regexp_matches(tok, '[\\p{{L}}0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS words_before
FROM {_TOKENS} QUALIFY NOT regexp_matches(tok, '[\\p{{L}}0-9]')""")
def punct_signature(spark, sf_dir):
    d = tokens(spark, sf_dir).withColumn("kind", F.when(F.col("tok").rlike(r"[\p{L}0-9]"), "word").otherwise("punct"))
    return seq.signature(d, ["doc_id", "line_no"], ["k"]).select("doc_id", "line_no", "k", "tok", "words_before")


@query("""WITH e AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE AS new FROM events),
s AS (SELECT *, sum(CASE WHEN coalesce(new, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_words FROM s GROUP BY user_id, session""")
def session_cues(spark, sf_dir):
    # a session of the engine ends exactly 30 minutes after its last row, so a gap of 30 minutes begins another: one microsecond makes the bound inclusive
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", F.lit("30 minutes 1 microsecond")).alias("w")).agg(F.count("*").alias("n_words"))
    return e.select("user_id", F.col("w.start").alias("start"), (F.col("w.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n_words")


# --- statistics ---------------------------------------------------------------------------


@query(f"""WITH g AS (SELECT *, "end" - start AS duration, lead(start) OVER (PARTITION BY user_id ORDER BY start, event_id) - "end" AS gap FROM {WORDS})
SELECT user_id, count(*) AS cues, max("end") AS total, min(duration) AS min_duration, max(duration) AS max_duration, count(*) FILTER (gap = 0) AS zero_gap, count(*) FILTER (gap < 0) AS overlaps,
count(*) FILTER (duration <= 0) AS non_positive, count(*) FILTER (duration < 0.8) AS "under_0_8s", count(*) FILTER (duration > 6) AS over_6s FROM g GROUP BY user_id""")
def cue_stats(spark, sf_dir):
    d = rel.cue_stats(words(spark, sf_dir), ["user_id"], ["start", "event_id"], "word")
    return d.select("user_id", "cues", "total", "min_duration", "max_duration", "zero_gap", "overlaps", "non_positive", "under_0_8s", "over_6s")


@query(f"SELECT lang, count(*) AS n, quantile_cont(length(line), 0.5)::DOUBLE AS median, quantile_cont(length(line), 0.95)::DOUBLE AS p95, max(length(line)) AS longest FROM {LINES} GROUP BY lang")
def cue_percentiles(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("n", F.length("line"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), rel.linear_percentile("n", 0.5).alias("median"), rel.linear_percentile("n", 0.95).alias("p95"), F.max("n").cast("long").alias("longest"))


@query(f"""SELECT doc_id, list_sort(list(length(line)))[(round_even((count(*) - 1) * 0.95, 0))::INT + 1] AS p95 FROM {LINES} GROUP BY doc_id""")
def nearest_rank_p95(spark, sf_dir):
    return rel.nearest_ranks(lines(spark, sf_dir).withColumn("n", F.length("line").cast("long")), ["doc_id"], "n", p95=0.95)


@query(f"""SELECT lang, l[(round_even((len(l) - 1) * 0.5, 0))::INT + 1] AS median, l[(round_even((len(l) - 1) * 0.95, 0))::INT + 1] AS p95 FROM (SELECT lang, list_sort(list(length(line))) AS l FROM {LINES} GROUP BY lang)""")
def nearest_ranks_by_lang(spark, sf_dir):
    return rel.nearest_ranks(lines(spark, sf_dir).withColumn("n", F.length("line").cast("long")), ["lang"], "n", median=0.5, p95=0.95)


@query(f"""WITH m AS (SELECT lang, quantile_cont(len(regexp_extract_all(line, '[^ ]+')), 0.5)::DOUBLE AS measured FROM {LINES} GROUP BY lang)
SELECT lang, measured, CASE WHEN abs(measured - 8.0) <= 2.4 THEN 'ok' WHEN measured < 8.0 THEN 'low' ELSE 'high' END AS verdict FROM m""")
def target_verdict(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("n", F.size(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0))))
    m = d.groupBy("lang").agg(rel.linear_percentile("n", 0.5).alias("measured"))
    return m.withColumn("verdict", rel.verdict(F.col("measured"), F.lit(float(R.TARGET["clusters"][1]))))


@query("""WITH p AS (SELECT event_type, epoch_us(ts) // 3600000000 AS bucket, max(abs(value)) AS peak FROM events GROUP BY ALL)
SELECT event_type, bucket, peak, CASE WHEN max(peak) OVER (PARTITION BY event_type) > 0 THEN round_even(peak * 255 / max(peak) OVER (PARTITION BY event_type), 0)::INT ELSE 0 END AS level FROM p""")
def peaks(spark, sf_dir):
    return rel.peaks(table(spark, sf_dir, "events"), ["event_type"], F.floor(micros() / 3600000000), "value")


@query("SELECT event_type, count(*) AS cues, count(*) FILTER (value > 50) AS translated, count(*) FILTER (value <= 50) AS kept_original FROM events GROUP BY event_type")
def translation_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("doc_id"), F.when(F.col("value") > 50, "provider").otherwise("kept").alias("source"))
    return names.translation_counts(e).select(F.col("doc_id").alias("event_type"), "cues", "translated", "kept_original")


# --- joins and sets -----------------------------------------------------------------------

_LOWER = "(SELECT doc_id, lang, line_no, unnest(range(len(t))) AS k, unnest(t) AS w FROM (SELECT doc_id, lang, line_no, regexp_extract_all(lower(line), '[a-z]+') AS t FROM " + LINES + "))"


def lower_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+"), F.lit(0))
    return lines(spark, sf_dir).select("doc_id", "lang", "line_no", F.posexplode(found).alias("k", "w")).withColumn("k", F.col("k").cast("long"))


@query(f"""WITH w AS (SELECT * FROM {_LOWER}), g AS (
SELECT doc_id, line_no, k, w || lead(w, 1) OVER o AS text, w || ' ' || lead(w, 1) OVER o AS shown FROM w WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY k)
UNION ALL SELECT doc_id, line_no, k, w || lead(w, 1) OVER o || lead(w, 2) OVER o, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o FROM w WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY k)
UNION ALL SELECT doc_id, line_no, k, w || lead(w, 1) OVER o || lead(w, 2) OVER o || lead(w, 3) OVER o, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o FROM w WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY k)),
h AS (SELECT g.* FROM g JOIN (SELECT DISTINCT doc_id, w AS text FROM w) USING (doc_id, text) WHERE length(text) <= 6)
SELECT doc_id, text, count(*) AS n, min(line_no) AS line_no FROM h GROUP BY doc_id, text""")
def name_split_ngrams(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+"), F.lit(0))
    return rel.split_names(lines(spark, sf_dir).select("doc_id", "line_no", found.alias("w")), ["doc_id"], "line_no", "w").select("doc_id", "text", "n", "line_no")


@query("""WITH b AS (SELECT DISTINCT string_split(text, ' ')[1] AS name FROM benchmark WHERE length(string_split(text, ' ')[1]) >= 4)
SELECT name, sum((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS n FROM b, documents WHERE contains(text, name) GROUP BY name""")
def name_counts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.split("text", " ")[0].alias("name")).where(F.length("name") >= 4).distinct()
    return matching.counts(b, table(spark, sf_dir, "documents")).select("name", "n")


@query("SELECT item_id FROM benchmark WHERE EXISTS (SELECT 1 FROM documents WHERE contains(documents.text, benchmark.text))")
def transcript_semi(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("han"))
    return rel.verified_names(b, table(spark, sf_dir, "documents")).select("item_id")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal FROM conversations)
SELECT u.conv_id, u.ordinal, u.turn, a.turn AS answer_turn, length(u.text) AS asked, length(a.text) AS answered FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.ordinal = a.ordinal AND u.role = 'user' AND a.role = 'assistant'""")
def positional_pair(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    both = rel.positional_pair(c.where("role = 'user'"), c.where("role = 'assistant'"), ["conv_id"], ["turn"], {"turn": "answer_turn", "text": "answer"})
    return both.select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), "turn", "answer_turn", F.length("text").cast("long").alias("asked"), F.length("answer").cast("long").alias("answered"))


@query("""SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.n, 0) AS n_left, coalesce(a.n, 0) AS n_right FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) u
FULL JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1) a ON u.conv_id = a.conv_id WHERE coalesce(u.n, 0) <> coalesce(a.n, 0)""")
def block_count_mismatch(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return rel.count_mismatch(c.where("role = 'user'"), c.where("role = 'assistant'"), ["conv_id"])


@query("""SELECT d.doc_id, count(*) AS cues, count(l.quality) AS lines FROM (SELECT doc_id, doc_id // 10 AS g FROM documents) d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id HAVING count(*) = count(l.quality)""")
def complete_translation(spark, sf_dir):
    cues = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"))
    got = rel.complete_translation(cues, table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("pos"), F.col("quality").cast("string").alias("line")))
    return got.groupBy("doc_id").agg(F.count("*").alias("cues"), F.count("line").alias("lines"))


@query(f"""WITH p AS (SELECT lower(regexp_extract(p_name, '[A-Za-z]+')) AS w, min(p_partkey) AS entry FROM part GROUP BY 1 UNION ALL SELECT w, 0 FROM (VALUES ('the'), ('und'), ('les'), ('del')) v(w)),
q AS (SELECT w, min(entry) AS entry FROM p GROUP BY w)
SELECT lang, count(*) AS words, count(entry) AS found FROM {_LOWER} LEFT JOIN q USING (w) GROUP BY lang""")
def token_name_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.lower(F.regexp_extract("p_name", "[A-Za-z]+", 0)).alias("w")).agg(F.min("p_partkey").alias("entry"))
    own = spark.createDataFrame([(w, 0) for w in ("the", "und", "les", "del")], "w string, entry long")
    q = p.union(own).groupBy("w").agg(F.min("entry").alias("entry"))
    return rel.lookup(lower_words(spark, sf_dir), q, "w", "entry").groupBy("lang").agg(F.count("*").alias("words"), F.count("entry").alias("found"))


@query("SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def cache_miss_anti(spark, sf_dir):
    return rel.cache_split(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")[1].select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents SEMI JOIN labels USING (doc_id)")
def answers_semi(spark, sf_dir):
    return rel.requested_only(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality::VARCHAR, d.lang) AS kind, coalesce(l.toxic, d.n_chars) AS count FROM labels l FULL JOIN (SELECT * FROM documents WHERE lang <> 'en') d ON l.doc_id = d.doc_id""")
def names_upsert(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("kind"), F.col("toxic").cast("long").alias("count"))
    b = table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", F.col("lang").alias("kind"), F.col("n_chars").alias("count"))
    return rel.upsert(a, b, "doc_id", ["kind", "count"])


@query("SELECT p_name AS han, p_brand AS vi FROM part WHERE trim(p_brand) <> '' ORDER BY length(p_name) DESC, p_name, p_partkey LIMIT 120")
def glossary_topk(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.trim("p_brand") != "")
    return p.orderBy(F.length("p_name").desc(), "p_name", "p_partkey").select(F.col("p_name").alias("han"), F.col("p_brand").alias("vi")).limit(120)


@query(f"SELECT DISTINCT doc_id, code, line_no AS cue_index FROM {LINT} WHERE n > 0")
def dedupe_findings(spark, sf_dir):
    f = lint(spark, sf_dir).where("n > 0").select("doc_id", "code", F.col("line_no").alias("cue_index"), F.lit("").alias("message"), F.col("n").cast("string").alias("line"))
    return rel.dedupe(f.union(f)).select("doc_id", "code", "cue_index")


@query(f"SELECT doc_id, code, line_no AS cue_index, n FROM {LINT} WHERE n > 0 AND NOT (code = 'ASCII_PUNCT' AND line_no = 0) AND NOT (code = 'SPACE_AROUND_PUNCT' AND line_no = 1)")
def known_error_except(spark, sf_dir):
    known = spark.createDataFrame([("ASCII_PUNCT", 0), ("SPACE_AROUND_PUNCT", 1)], "code string, cue_index long")
    f = lint(spark, sf_dir).where("n > 0").select("doc_id", "code", F.col("line_no").alias("cue_index"), "n")
    return rel.without_known(f, known).select("doc_id", "code", "cue_index", "n")


@query("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 25 AS batch FROM documents")
def batch_ids(spark, sf_dir):
    return rel.batches(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], few_keys=True)


@query("SELECT l.doc_id, d.lang, unnest(list_concat(CASE WHEN quality = 0 THEN ['AI_APPLIED'] ELSE [] END, CASE WHEN toxic = 1 THEN ['HETERONYM'] ELSE [] END)) AS flag FROM labels l JOIN documents d USING (doc_id)")
def review_queue(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("quality") == 0, "AI_APPLIED"), F.when(F.col("toxic") == 1, "HETERONYM"), F.lit("NAME")))
    token = F.struct(F.lit("word").alias("kind"), F.col("lang").alias("zh"), F.lit(None).cast("string").alias("pinyin"), F.lit(1.0).alias("confidence"), F.lit("ai").alias("source"), flags.alias("flags"))
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    cues = d.select(F.col("doc_id"), F.lit(0).alias("pos"), F.lit(1).alias("index"), F.array(token).alias("tokens"))
    return rel.review_queue(cues).select("doc_id", F.col("zh").alias("lang"), "flag")


@query("""SELECT o_custkey AS owner, o_orderkey AS job_id FROM (SELECT *, o_orderstatus = 'O' AS active, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE active OR n <= 3""")
def keep_newest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") == "O").alias("active"))
    return rel.keep_newest(o, 3).select("owner", "job_id")


# --- documents of cues ---------------------------------------------------------------------


def turn_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of cues: a turn is a cue, its words are tokens, ten characters a second."""
    words_ = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.struct(
        F.lit("word").alias("kind"), w.alias("zh"), F.lower(w).alias("pinyin"), F.lit(1.0).alias("confidence"), F.lit("asr").alias("source"), F.when(F.length(w) > 9, F.array(F.lit("NAME"))).otherwise(F.array().cast("array<string>")).alias("flags")))
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("turn").cast("int").alias("index"), (F.col("turn") * 100.0).alias("start"), (F.col("turn") * 100.0 + F.length("text") / 10.0).alias("end"), words_.alias("tokens"))


_TURNS = """(SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w, length(text) / 10.0 AS duration, turn * 100.0 + length(text) / 10.0 AS "end" FROM conversations)"""


@query(f"""SELECT conv_id AS doc_id, count(*) AS cues, sum(len(w))::BIGINT AS words, round(max("end"), 3)::DOUBLE AS total_duration, quantile_cont(len(w), 0.5)::DOUBLE AS median_clusters, quantile_cont(len(w), 0.95)::DOUBLE AS p95_clusters,
max(len(w)) AS max_clusters, sum(len(list_filter(w, lambda x: length(x) > 9)))::BIGINT AS name_tokens, count(*) FILTER (len(w) = 0) AS empty_cues FROM {_TURNS} GROUP BY conv_id""")
def document_stats(spark, sf_dir):
    d = report.document_stats(turn_cues(spark, sf_dir))
    return d.select("doc_id", "cues", "words", "total_duration", "median_clusters", "p95_clusters", F.col("max_clusters").cast("long").alias("max_clusters"), "name_tokens", "empty_cues")


@query(f"""SELECT conv_id AS doc_id, quantile_cont(len(w), 0.95)::DOUBLE AS measured, CASE WHEN abs(quantile_cont(len(w), 0.95) - 8) <= 2.4 THEN 'ok' WHEN quantile_cont(len(w), 0.95) < 8 THEN 'low' ELSE 'high' END AS verdict FROM {_TURNS} GROUP BY conv_id""")
def target_comparison(spark, sf_dir):
    d = report.against_target(report.document_stats(turn_cues(spark, sf_dir)))
    return d.where("measure = 'clusters' and statistic = 'p95'").select("doc_id", "measured", "verdict")


@query("""SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS id, turn::DOUBLE AS start, greatest(turn, turn + length(text) - 200)::DOUBLE AS "end", text FROM conversations""")
def transcript_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("start", F.col("turn").cast("double")).withColumn("end", (F.col("turn") + F.length("text") - 200).cast("double"))
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "start", "end"))), lambda x: x.dropFields("turn")).alias("result")))
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(body.alias("text"))
    return srt.segments(docs).select("doc_id", "id", "start", "end", "text")


@query("""SELECT doc_id, pos FROM (SELECT conv_id AS doc_id, turn AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE pos % 2 = 0""")
def flagged_stage_cues(spark, sf_dir):
    c = turn_cues(spark, sf_dir)
    flagged = c.withColumn("tokens", F.transform("tokens", lambda t: t.withField("flags", F.when(F.col("pos") % 2 == 0, F.array(F.lit("HETERONYM"))).otherwise(F.array().cast("array<string>")))))
    return report.stage_flags(c, flagged).select("doc_id", "pos")


# --- scalar functions ---------------------------------------------------------------------


@query("""SELECT event_id, printf('%02d:%02d:%02d,%03d', (ms // 3600000)::INT, (ms // 60000 % 60)::INT, (ms // 1000 % 60)::INT, (ms % 1000)::INT) AS stamp FROM (SELECT event_id, round_even(value * 1000, 0)::BIGINT AS ms FROM events)""")
def timestamps_fmt(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.format_stamp(F.col("value")).alias("stamp"))


@query("""SELECT event_id, (ms // 1000)::DOUBLE AS start, ms / 1000.0 AS "end" FROM (SELECT event_id, round_even(value * 1000, 0)::BIGINT AS ms FROM events)""")
def timestamps_parse(spark, sf_dir):
    v = F.col("value")
    whole = F.floor(F.rint(v * 1000) / 1000).cast("double")
    line = F.concat(text.format_stamp(whole), F.lit(" --> "), text.format_stamp(v))
    p = text.parse_stamp(line)
    return table(spark, sf_dir, "events").select("event_id", p["start"].cast("double").alias("start"), p["end"].alias("end"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\t\r\n]', ' ', 'g'), ' {2,}', ' ', 'g')) AS line FROM documents""")
def clean_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_line(F.col("text")).alias("line"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[.]', ' .', 'g'), '[\r\n\t]', ' ', 'g'), ' +([,.?!:;)…])', '\1', 'g'), ' {2,}', ' ', 'g')) AS line FROM conversations""")
def vi_spacing(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.vi_spacing(F.regexp_replace("text", "[.]", " .")).alias("line"))


@query(f"""SELECT doc_id, line_no, coalesce(string_agg(CASE WHEN regexp_matches(tok, '[\\p{{L}}0-9]') AND regexp_matches(prev, '[\\p{{L}}0-9]') THEN ' ' || tok ELSE tok END, '' ORDER BY k), '') AS zh
FROM (SELECT *, coalesce(lag(tok) OVER (PARTITION BY doc_id, line_no ORDER BY k), '') AS prev FROM {_TOKENS}) GROUP BY doc_id, line_no""")
def render_line(spark, sf_dir):
    found = F.regexp_extract_all("line", F.lit(r"[\p{L}0-9]+|[.!?,;:]"), F.lit(0))
    kinds = F.transform(found, lambda x: F.struct(F.when(F.instr(F.lit(".!?,;:"), x) > 0, "punct").otherwise("word").alias("kind"), x.alias("zh"), F.lit(None).cast("string").alias("pinyin")))
    return lines(spark, sf_dir).where(F.size(found) > 0).select("doc_id", "line_no", sinks.render(kinds).alias("zh"))


@query("SELECT doc_id, substr(sha256('{\"source\":\"' || source || '\",\"n_chars\":' || n_chars || '}'), 1, 32) AS key FROM documents")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cache_key(F.col("source"), F.col("n_chars")).alias("key"))


@query("""SELECT page_id, regexp_extract(lower(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '[.][A-Za-z0-9]+$', ''), '[^A-Za-z0-9]+', '-', 'g')), '[a-z0-9].*') || '-' || substr(sha1(url), 1, 8) AS id FROM pages WHERE url NOT LIKE '%/' AND url NOT LIKE '%#%' AND url NOT LIKE '%?%'""")
def source_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url NOT LIKE '%/' AND url NOT LIKE '%#%' AND url NOT LIKE '%?%'")
    return p.select("page_id", text.video_id(F.col("url")).alias("id"))


# --- a small file for tests ---------------------------------------------------------------

SAMPLE = (
    "1\n00:00:01,000 --> 00:00:02,500\n我 不 是 小孩 儿。\nWǒ bù shì xiǎohái ér。\n\n2\n00:00:02,000 --> 00:00:04,000\n- 你 好 -他 来 了\n- Nǐ hǎo - tā lái le\n\n"
    "4\n00:00:05,00 --> 00:00:06,000\n 真好, 吗...\nZhēn hǎo,  ma...\n\n\n5\n00:00:07,000 --> 00:00:09,000\n“美国”——纽约……\n“Měiguó”——Niǔyuē……\n谢谢\n\n6\n00:00:10,000 --> 00:00:11,000\n……\n……\n"
)
READINGS = {"我": ["wǒ"], "不": ["bù"], "是": ["shì"], "小": ["xiǎo"], "孩": ["hái"], "你": ["nǐ"], "好": ["hǎo", "hào"], "他": ["tā"], "来": ["lái"], "了": ["le", "liǎo"], "真": ["zhēn"], "吗": ["ma"], "美": ["měi"], "国": ["guó"], "纽": ["niǔ"], "约": ["yuē"], "谢": ["xiè"], "儿": ["ér"]}


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sample", SAMPLE)], "doc_id string, text string")
