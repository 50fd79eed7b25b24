"""Line dedup by site-relative frequency.

Rows (pages, documents) are grouped by host.  A line is boilerplate of a host when
more than ``ratio`` of the host's rows contain it, and ``min_pages`` rows at least (on
one or two pages nothing tells the site's lines from the page's own); boilerplate
lines are dropped from the host's rows.  Lines compare after trimming
spaces and tabs; blank lines are never counted or dropped.

Everything is DataFrame expressions.  Each row counts a line once (distinct within
the row, then map-side partial sums).  The rows of a host hold ``n`` lines each on
average, so at most ``n / ratio`` lines of a host can be boilerplate: the lists that
are joined back are short whatever the host's size.  That join is on (host, salt), with
salts dealt to rows in turn, and adaptive execution can split a salt of a host further.

Defined results: a null text has no lines and stays null; a null host is the group
of the empty host; repeated rows count as rows of their own; a host with fewer than
``min_pages`` rows loses nothing.  All columns of the input come back inside the
struct ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

RATIO = 0.2
MIN_PAGES = 3
SALTS = 32

#: Fixed patterns in the syntax that Java and RE2 share.
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
BREAK = r"(?i)<(/?(p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|main|aside|table|tr|td|th|title|head|body|html)|br)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"


def html_lines(html: Column) -> Column:
    """Text of an HTML page, a line for each block element; blank lines are left out."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BREAK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  "))), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.md5(F.trim(F.translate(line, "\t\r", "  ")).cast("binary"))


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  ")) == ""


def site_lines(df: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (the input's columns, or those in ``keep``), ``host``, ``lines``, ``kept`` (its lines that stay), in no order."""
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: ~_blank(x)), _key))
    counts = base.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = base.groupBy("host").agg(F.count("*").alias("total"))
    common = counts.join(totals, "host").where(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("key").alias("drop"))
    common = common.select("host", "drop", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = salted.join(common, ["host", "salt"], "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: _blank(x) | ~F.array_contains("drop", _key(x))))
    return joined.select("row", "host", "lines", kept.alias("kept"))


def dedup_pages(pages: DataFrame) -> DataFrame:
    """Each page's visible text without the boilerplate lines of its host."""
    # the lines are read twice, the pages once
    lines = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract(F.lower("url"), HOST, 1).alias("host"), html_lines(F.col("html")).alias("lines"))
    out = site_lines(C.scratch(lines.withColumn("n", F.monotonically_increasing_id()), "lines"), F.col("host"), F.col("lines"), keep=("page_id", "n"))
    return out.select(
        F.col("row.page_id").cast("long").alias("page_id"),
        "host",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("text"),
    )


def dedup_documents(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines of each ``source`` taken out of ``text``; other columns as they are but ``n_chars``."""
    out = site_lines(docs, F.col("source").cast("string"), F.split(F.col("text"), "\n"), ratio, min_pages)
    text = F.when(F.size("kept") == F.size("lines"), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[columns.get(f.name, F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema])


#: The same in DuckDB's SQL.
ORACLE = f"""
WITH lines AS (
  SELECT page_id, html, row_number() OVER () AS id, regexp_extract(lower(coalesce(url, '')), '{HOST}', 1) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', chr(10), 'g'), '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
      lambda x: trim(translate(x, chr(9) || chr(13), '  '))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS total FROM lines GROUP BY host),
seen AS (SELECT DISTINCT host, id, unnest(lines) AS line FROM lines),
common AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line) JOIN totals USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO} * total),
dropped AS (SELECT host, list(line) AS bad FROM common GROUP BY host),
kept AS (SELECT page_id, html, lines.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM lines LEFT JOIN dropped USING (host))
SELECT page_id, host, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_removed, array_to_string(kept, chr(10)) AS text FROM kept
"""
