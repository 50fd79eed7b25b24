"""Report pages: escaping, order, the first rows of long sections, documents without rows."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from subtide.plans import page


class Rows(HTMLParser):
    def __init__(self):
        super().__init__()
        self.sections, self.links, self.open = {}, [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "section":
            self.at = self.sections.setdefault(attrs["id"], [])
        elif tag == "tr":
            self.at.append([])
        elif tag in ("td", "th"):
            self.at[-1].append("")
        elif tag == "a":
            self.links.append(attrs["href"])
        if tag not in ("meta",):
            self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        if self.open and self.open[-1] in ("td", "th"):
            self.at[-1][-1] += data


def test_pages(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("<c>",), ("a",)], "doc_id string")
    odd = spark.createDataFrame([("a", 2, "<b>&'\"</b>", None), ("a", 1, "é 好", [1, 2]), ("other", 1, "x", None)], "doc_id string, k int, text string, list array<int>")
    many = spark.range(300).select(F.lit("a").alias("doc_id"), "id")
    got = {r["doc_id"]: r for r in page.pages(docs, [page.Section("odd", "Odd ones", odd, ["k"]), page.Section("many", "Many", many, [F.desc("id")])], most=5).collect()}
    assert set(got) == {"a", "b", "<c>"} and got["a"]["counts"] == {"odd": 2, "many": 300} and got["b"]["counts"] == {}
    p = Rows()
    p.feed(got["a"]["html"])
    assert p.open == [] and p.links == ["#odd", "#many"]
    assert p.sections["odd"] == [["k", "text", "list"], ["1", "é 好", "[1,2]"], ["2", "<b>&'\"</b>", ""]]
    assert [r[0] for r in p.sections["many"]] == ["id", "299", "298", "297", "296", "295"] and "the first 5 of 300" in got["a"]["html"]
    assert "&lt;c&gt;" in got["<c>"]["html"] and "<section" not in got["<c>"]["html"]
    assert page.pages(docs.limit(0), [page.Section("odd", "Odd ones", odd)]).count() == 0


def test_rows_of_a_section_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    rows = spark.range(30).select(F.lit("a").alias("doc_id"), counted.asNondeterministic()("id").alias("id"), F.lit(None).alias("nothing"))
    got = page.pages(spark.createDataFrame([("a",)], "doc_id string"), [page.Section("s", "S", rows)], most=40).collect()
    assert made.value == 30 and got[0]["counts"] == {"s": 30} and got[0]["html"].count("<tr>") == 31
