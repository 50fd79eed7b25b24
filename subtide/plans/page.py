"""A report page for each document, put together from the datasets behind it.

Every dataset is a table with ``doc_id``; its rows become rows of one relation (document,
section, place, cells as text), so a page is one aggregate over it, and no section is
gathered for all documents.  A section shows its first ``most`` rows by its order (a
top-k by document, cut before the shuffle) and says how many it has; as both are read from
its rows, these are written once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide import shared

MOST = 200
STYLE = "body{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}h2{border-bottom:2px solid #888}"


class Section(NamedTuple):
    """A dataset's key, title, rows (``doc_id`` and what is shown), and the order of its rows."""

    key: str
    title: str
    rows: DataFrame
    order: Sequence[str | Column] = ()


def escaped(text: Column) -> Column:
    """Text that HTML shows as it is; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def _cell(column: str, kind: str) -> Column:
    c = F.col(f"`{column}`")
    return escaped(F.to_json(c) if kind.startswith(("array", "struct", "map")) else c)


def _rows(number: int, s: Section, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, section, place, html) of the rows that are shown, and (doc_id, section, n)."""
    shown = [f for f in s.rows.schema if f.name != "doc_id"]
    void = [f.name for f in s.rows.schema if f.dataType.typeName() == "void"]  # no table has columns without a type
    rows = shared.written(s.rows.withColumns({c: F.col(f"`{c}`").cast("string") for c in void}), "section")
    order = list(s.order) or [f.name for f in shown]
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _cell(f.name, f.dataType.simpleString()), F.lit("</td>")) for f in shown], F.lit("</tr>"))
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("_place") <= most)
    doc, section = F.col("doc_id").cast("string").alias("doc_id"), F.lit(number).alias("section")
    return ranked.select(doc, section, F.col("_place").alias("place"), line.alias("html")), rows.groupBy(doc).agg(F.count("*").alias("n")).withColumn("section", section)


def pages(docs: DataFrame, sections: Sequence[Section], title: str = "Subtitle report", most: int = MOST) -> DataFrame:
    """doc_id, html, counts (section's key to its number of rows) for every document of ``docs``; sections without a row are left out of the page."""
    made = [_rows(i, s, most) for i, s in enumerate(sections)]
    lines, counts = made[0]
    for a, b in made[1:]:
        lines, counts = lines.unionByName(a), counts.unionByName(b)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "html"))), lambda x: x["html"]), "\n")
    parts = lines.groupBy("doc_id", "section").agg(body.alias("body")).join(counts, ["doc_id", "section"])
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("section") + 1)
    heads = ["<tr>" + "".join(f"<th>{f.name}</th>" for f in s.rows.schema if f.name != "doc_id") + "</tr>" for s in sections]
    more = F.when(F.col("n") > most, F.concat(F.lit(f"<p>the first {most} of "), F.col("n"), F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), F.col("n"), F.lit("</p>")))
    card = F.concat(F.lit('<section id="'), of([s.key for s in sections]), F.lit('"><h2>'), of([s.title for s in sections]), F.lit("</h2>"), more, F.lit("<table>"), of(heads), F.col("body"), F.lit("</table></section>"))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", of([s.key for s in sections]).alias("key"), of([s.title for s in sections]).alias("title"), "n", card.alias("card")))).alias("cards"))
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(whole, "doc_id", "left")
    out = out.withColumn("cards", F.coalesce("cards", F.array().cast(whole.schema["cards"].dataType)))
    nav = F.array_join(F.transform("cards", lambda c: F.concat(F.lit('<a href="#'), c["key"], F.lit('">'), c["title"], F.lit("</a>"))), " · ")
    name = F.concat(F.lit(f"{title} "), escaped(F.col("doc_id")))
    html = F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"><title>'), name, F.lit(f"</title><style>{STYLE}</style></head>\n<body>\n<h1>"), name, F.lit("</h1>\n<p>"), nav, F.lit("</p>\n"),
        F.array_join(F.transform("cards", lambda c: c["card"]), "\n"), F.lit("\n</body>\n</html>\n"),
    )
    return out.select("doc_id", html.alias("html"), F.map_from_entries(F.transform("cards", lambda c: F.struct(c["key"], c["n"]))).alias("counts"))
