"""Subtitle files and bundles from cue tables (doc_id, pos, start, end, tokens), and versioned writes."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.functions import text
from subtide.sources import versions

#: Fixed parts of an ASS file.
ASS_HEAD = "[Script Info]\nTitle: {title}\nScriptType: v4.00+\nWrapStyle: 2\nScaledBorderAndShadow: yes\nYCbCr Matrix: TV.709\nPlayResX: 1920\nPlayResY: 1080\n\n[V4+ Styles]\n"
ASS_FIELDS = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
ASS_STYLE = "Style: {name},{font},{size},{colour},&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,2.5,1,2,60,60,50,1"
ASS_EVENTS = "\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


#: Code points that no text has stand before each token while a line is put together: word, mark, turn, tag that opens.
_WORD, _MARK, _TURN, _OPENS = "\ufdd0\ufdd1\ufdd2\ufdd3"
_TEXT = f"[^{_WORD}{_MARK}{_TURN}{_OPENS}]*"
_NEXT = f"(?:{_OPENS}{_TEXT})*"
#: A token that is apart from the next one: a word from a word or a turn, a mark from a turn, a turn from anything.
_APART = f"({_WORD}{_TEXT}(?={_NEXT}[{_WORD}{_TURN}])|{_MARK}{_TEXT}(?={_NEXT}{_TURN})|{_TURN}{_TEXT}(?={_NEXT}[{_WORD}{_MARK}{_TURN}]))"


def render(tokens: Column, field: str = "zh") -> Column:
    """A line from tokens: words apart by a space, a space on either side of a turn mark, tags on their token.

    Tokens are written one after another with a code for their kind, in one pass; spaces
    are put in where the codes ask for them.  A closing tag has no code, so it belongs to what is before it.
    """

    def coded(t: Column) -> Column:
        own = F.trim(F.coalesce(t["zh"], F.lit("")))
        said = F.coalesce(F.nullif(F.trim(t["pinyin"]), F.lit("")), own) if field == "pinyin" else own
        part = lambda code, text: F.when(text != "", F.concat(F.lit(code), text)).otherwise("")
        return (
            F.when(t["kind"] == "word", part(_WORD, said)).when(t["kind"] == "punct", part(_MARK, own)).when(t["kind"] == "marker", _TURN + "-")
            .when(t["kind"] == "markup", F.when(own.startswith("</"), own).otherwise(part(_OPENS, own))).otherwise(part(_MARK, own))
        )

    def spaced(line: Column) -> Column:
        out = F.regexp_replace(line, _APART, "$1 ")
        for code in (_WORD, _MARK, _TURN, _OPENS):
            out = F.replace(out, F.lit(code), F.lit(""))
        words = F.substr(F.replace(line, F.lit(_WORD), F.lit(" ")), F.lit(2))  # most lines: from the first on words alone, which are all apart
        other = line.contains(_MARK) | line.contains(_TURN) | line.contains(_OPENS)
        return F.when(line.startswith(_WORD) & ~other, words).otherwise(out)

    # a line is put together once, whatever asks for it
    return F.transform(F.array(F.array_join(F.transform(tokens, coded), "")), spaced)[0]


def shown(cues: DataFrame) -> DataFrame:
    """Cues that render to something: zh, pinyin, their new number and their stamps."""
    lines = F.struct(render(F.col("tokens")).alias("zh"), render(F.col("tokens"), "pinyin").alias("pinyin"))
    d = cues.select("*", F.inline(F.array(lines))).where("zh <> '' or pinyin <> ''")  # of a generator's columns, so that the filter isn't pushed down as both renderings
    d = d.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return d.withColumn("stamp", F.concat(text.format_stamp(F.col("start")), F.lit(" --> "), text.format_stamp(F.col("end"))))


def _file(d: DataFrame, part: Column, head: str = "", tail: str = "") -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"]), "")
    return d.groupBy("doc_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def srt(cues: DataFrame) -> DataFrame:
    """One subtitle file for each document, renumbered, cues without text left out."""
    return srt_of(shown(cues))


def srt_of(lines: DataFrame) -> DataFrame:
    """The same from cues as ``shown`` gives them."""
    return _file(lines, F.concat_ws("\n", F.col("number").cast("string"), "stamp", "zh", "pinyin", F.lit("\n")))


def vi_srt(cues: DataFrame, lines: DataFrame) -> DataFrame:
    """The Vietnamese file: the same cues and stamps; lines (doc_id, pos, line) by place."""
    d = shown(cues).join(lines.select("doc_id", "pos", "line"), ["doc_id", "pos"], "left")
    return _file(d, F.concat_ws("\n", F.col("number").cast("string"), "stamp", text.vi_line(F.col("line"), F.col("zh")), F.lit("\n")))


def _styles(styles: list[tuple[str, str, int, str]]) -> str:
    return ASS_FIELDS + "\n" + "\n".join(ASS_STYLE.format(name=n, font=f, size=s, colour=c) for n, f, s, c in styles) + "\n"


def ass(cues: DataFrame, title: str = "subtitles", font: str = "PingFang SC", pinyin_font: str = "Arial Unicode MS", size: int = 42) -> DataFrame:
    """Advanced SubStation files: a cue is one event, its lines joined by a break."""
    return ass_of(shown(cues), title, font, pinyin_font, size)


def ass_of(lines: DataFrame, title: str = "subtitles", font: str = "PingFang SC", pinyin_font: str = "Arial Unicode MS", size: int = 42) -> DataFrame:
    """The same from cues as ``shown`` gives them."""
    small = max(12, round(size * 0.8))
    head = ASS_HEAD.format(title=title) + _styles([("Default", font, size, "&H00FFFFFF"), ("Pinyin", pinyin_font, small, "&H00FFFFFF")]) + ASS_EVENTS
    zh, py = text.ass_text(F.col("zh")), text.ass_text(F.col("pinyin"))
    body = F.when(py != "", F.concat(zh, F.lit(f"\\N{{\\fn{pinyin_font}\\fs{small}}}"), py)).otherwise(zh)
    return _file(lines, F.concat(F.lit("\nDialogue: 0,"), text.ass_time(F.col("start")), F.lit(","), text.ass_time(F.col("end")), F.lit(",Default,,0,0,0,,"), body), head, "\n")


def bilingual_ass(cues: DataFrame, lines: DataFrame, title: str = "subtitles", font: str = "PingFang SC", other_font: str = "Arial Unicode MS", size: int = 42) -> DataFrame:
    """Three lines in one event: Chinese, pinyin, Vietnamese."""
    p, v = max(12, round(size * 0.72)), max(12, round(size * 0.82))
    styles = [("Han", font, size, "&H00FFFFFF"), ("Pinyin", other_font, p, "&H00C8C8C8"), ("Viet", other_font, v, "&H0000E5FF")]
    head = ASS_HEAD.format(title=title) + _styles(styles) + ASS_EVENTS
    d = shown(cues).join(lines.select("doc_id", "pos", "line"), ["doc_id", "pos"], "left")
    tag = lambda s, c: F.lit(f"\\N{{\\fn{other_font}\\fs{s}\\c{c}}}")
    body = F.concat(text.ass_text(F.col("zh")), tag(p, "&H00C8C8C8"), text.ass_text(F.col("pinyin")), tag(v, "&H0000E5FF"), text.ass_text(text.vi_line(F.col("line"), F.col("zh"))))
    return _file(d, F.concat(F.lit("\nDialogue: 0,"), text.ass_time(F.col("start")), F.lit(","), text.ass_time(F.col("end")), F.lit(",Han,,0,0,0,,"), body), head, "\n")


def bundle(cues: DataFrame) -> DataFrame:
    """One JSON bundle for each document."""
    kind = lambda t: F.when(t["kind"] == "punct", "punctuation").otherwise(t["kind"])
    tokens = F.transform("tokens", lambda t: F.struct(kind(t).alias("kind"), t["zh"].alias("text"), F.when(t["kind"] == "word", t["pinyin"]).alias("pinyin")))
    row = F.struct(F.col("pos"), F.col("number").alias("index"), "start", "end", tokens.alias("tokens"), text.format_stamp(F.col("start")).alias("start_time"), text.format_stamp(F.col("end")).alias("end_time"), "zh", "pinyin")
    cues_ = F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("pos"))
    stats = F.struct(F.count("*").alias("cues"), F.sum(F.size(F.filter("tokens", lambda t: t["kind"] == "word"))).alias("words"))
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("subtide").alias("generator"), F.lit("srt").alias("format"), cues_.alias("cues"), stats.alias("stats")))
    return shown(cues).groupBy("doc_id").agg(body.alias("bundle"))


def write_changed(files: DataFrame, path: str, volatile: Collection[str] = ()) -> DataFrame:
    """Commits the files (doc_id, text) whose content isn't the newest one there; older versions stay.  Returns the newest files."""
    versions.commit(files, path, volatile=volatile)
    now = versions.current(files.sparkSession, path)
    return now if now is not None else files.limit(0).withColumn("_version", F.lit(0))
