"""The sequence operators on a live transcript: words and segments as they come.

Inputs are streams with an event time; state is bounded by the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.functions import lang
from subtide.functions.lexing import Token
from subtide.session import ship


def silence_cues(words: DataFrame, key: str, time: str, silence: str, late: str = "1 minute") -> DataFrame:
    """Cues by silence: a session window for each key, its words in order when it closes."""
    cue = words.withWatermark(time, late).groupBy(F.session_window(time, silence).alias("w"), key)
    out = cue.agg(F.array_sort(F.collect_list(F.struct(time, "word"))).alias("list"), F.count("*").alias("n_words"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.array_join(F.transform("list", lambda x: x["word"]), "").alias("text"), "n_words")


#: What a key holds between batches: rows that the watermark hasn't passed, and how the last run stands.
_STATE = "waiting string, last string, run long"


def _in_order(rows: DataFrame, key: str, time: str, order: str, columns: list[str], late: str, schema: str, start: tuple, step: Callable[[tuple, dict], tuple[tuple, tuple | None]]) -> DataFrame:
    """``step(state, row) -> (state, out or nothing)`` over each key's rows in the order of ``time`` and ``order``.

    A row waits until the watermark has passed it, so rows that come late, but within
    ``late``, take their place; a timer at the first waiting row's time lets it go when
    nothing else comes.  State is the rows of ``late`` and ``start``'s values.
    """
    ship(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, *now = state.get if state.exists else ("[]", *start)
        waiting = json.loads(held)
        for pdf in pdfs:
            at = (pdf[time].astype("datetime64[us]").astype("int64")).tolist()
            waiting += [[t, o, v] for t, o, v in zip(at, pdf[order].tolist(), pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist(), strict=True)]
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda x: x[:2])
        out, now = [], tuple(now)
        n = sum(x[0] < (passed + 1) * 1000 for x in waiting)
        for t, o, v in waiting[:n]:
            now, made = step(now, dict(zip(columns, v, strict=True)))
            if made is not None:
                out.append((k[0], pd.Timestamp(t, unit="us"), o, *made))
        waiting = waiting[n:]
        state.update((json.dumps(waiting, ensure_ascii=False), *now))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed + 1))
        yield pd.DataFrame(out, columns=names)

    return rows.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", "EventTimeTimeout")


def drop_repeats(segments: DataFrame, key: str, time: str, order: str = "id", keep: int = 2, late: str = "1 minute") -> DataFrame:
    """key, time, order, text, repeat_no of segments without the tail of a run of equal texts: what the batch operator keeps, in the order of time.

    Empty texts don't repeat.  Times of one key and ``order`` (a long) must tell rows apart.
    """

    def step(now: tuple, row: dict) -> tuple[tuple, tuple | None]:
        last, n = now
        text = row["text"]
        n = n + 1 if text is not None and text != "" and text == last else 1
        return (text, n), (text, n) if n <= keep else None

    return _in_order(segments, key, time, order, ["text"], late, f"{key} string, {time} timestamp, {order} long, text string, repeat_no long", (None, 0), step)


def live_casing(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence case of tokens (key, at, kind, zh, pinyin) as they come; the state of each key is one word."""
    ship(tokens.sparkSession)

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else "upper"
        for pdf in pdfs:
            rows = []
            for t in pdf.sort_values("at").itertuples(index=False):
                token = Token(t.kind, t.zh, t.pinyin if isinstance(t.pinyin, str) else None)
                rows.append((k[0], t.at, t.kind, t.zh, lang.cased(token, pending, False, False).pinyin))
                pending = lang.case_event(t.kind, t.zh, token.pinyin) or pending
            yield pd.DataFrame(rows, columns=[key, "at", "kind", "zh", "pinyin"])
        state.update((pending,))

    return tokens.groupBy(key).applyInPandasWithState(run, f"{key} string, at long, kind string, zh string, pinyin string", "pending string", "append", "NoTimeout")


def live_casing_in_order(tokens: DataFrame, key: str, time: str, order: str = "id", late: str = "1 minute") -> DataFrame:
    """key, time, order, zh, pinyin in sentence case for tokens (kind, zh, pinyin) that may come late: what the batch operator makes of them."""

    def step(now: tuple, row: dict) -> tuple[tuple, tuple | None]:
        pending, _ = now
        token = Token(row["kind"], row["zh"], row["pinyin"])
        return (lang.case_event(row["kind"], row["zh"], row["pinyin"]) or pending, 0), (row["zh"], lang.cased(token, pending, False, False).pinyin)

    return _in_order(tokens, key, time, order, ["kind", "zh", "pinyin"], late, f"{key} string, {time} timestamp, {order} long, zh string, pinyin string", ("upper", 0), step)
