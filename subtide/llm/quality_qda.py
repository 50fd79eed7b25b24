"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a vector of transformed statistics (logs of sizes, log-odds of
shares).  Class means and covariances come from sums over every labelled row that
may be learned from, added up on the executors; each covariance shrinks towards
its diagonal and the pooled one.  A score is the logistic of the difference of the
two log densities (Mahalanobis distances by forward substitution with the cached
Cholesky factors) plus the log prior odds, tempered by the number of statistics.

Defined results: null and empty texts have the statistics of no characters and get
a score like any other; null labels are not learned from and repeated labels of a
document count once (the smallest); without two rows of each class every score is
the share of label 1 (0.5 without labels).  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PREDICT_FROM = 0.3
FOLDS = 5

_CLASS = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>@^~_=+{}[]\\/",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "quote": b"\"'()-",
    "line": b"\n",
    "space": C.SPACES,
}
_TABLE = np.zeros((len(_CLASS), 256), bool)
for _i, _members in enumerate(_CLASS.values()):
    _TABLE[_i, list(_members)] = True
N_STATS = len(_CLASS) + 12


def _log_odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _spread(block: C.TextBlock, key: np.ndarray) -> np.ndarray:
    """Distinct words in each document."""
    if not len(key):
        return np.zeros(len(block.rows))
    pair = C.mix64(key + C.mix64(block.owner.astype(np.uint64)))
    order = np.argsort(pair)
    new = np.ones(len(pair), bool)
    new[1:] = pair[order][1:] != pair[order][:-1]
    return np.bincount(block.owner[order[new]], minlength=len(block.rows)).astype(float)


def statistics(rows: list[bytes]) -> np.ndarray:
    """A row of ``N_STATS`` transformed statistics for each text."""
    block = C.TextBlock(rows)
    size, words = block.size.astype(float), block.n_words.astype(float)
    shares = [_log_odds(block.count(t[block.data]), size) for t in _TABLE]
    high = block.count((block.data & 0xC0) == 0xC0)
    length = (block.w1 - block.w0).astype(float)
    sums = lambda x: np.bincount(block.owner, x, len(rows))
    mean = sums(length) / np.maximum(words, 1)
    var = np.maximum(sums(length**2) / np.maximum(words, 1) - mean**2, 0)
    last = block.data[np.maximum(block.w1 - 1, 0)] if len(block.w1) else np.zeros(0, np.uint8)
    head = block.data[block.w0] if len(block.w0) else np.zeros(0, np.uint8)
    lines, dup = block.dup_lines()
    distinct = _spread(block, block.word)
    repeat = block.repeat_words()
    more = [
        np.log1p(size),
        np.log1p(words),
        np.log1p(mean),
        np.sqrt(var),
        _log_odds(distinct, words),
        _log_odds(repeat, words),
        _log_odds(dup, lines),
        np.log1p(words / np.maximum(lines, 1)),
        _log_odds(high, size),
        _log_odds(sums(_TABLE[2][last].astype(float)), words),
        _log_odds(sums(_TABLE[0][head].astype(float)), words),
        _log_odds(sums((length <= 3).astype(float)), words),
    ]
    return np.stack(shares + more, axis=1)


def moments(x: np.ndarray) -> np.ndarray:
    """Count, sums and products of rows, flat, so that they add up."""
    return np.concatenate(([float(len(x))], x.sum(0), (x.T @ x).ravel()))


def solve(total: dict[int, np.ndarray], shrink: float = 0.1, pooled: float = 0.2, ridge: float = 1e-3) -> dict | None:
    """Means, Cholesky factors and log determinants of both classes, from their moments."""
    if any(total.get(c, np.zeros(1))[0] < 2 for c in (0, 1)):
        return None
    d = N_STATS
    n = {c: total[c][0] for c in (0, 1)}
    mean = {c: total[c][1 : d + 1] / n[c] for c in (0, 1)}
    cov = {c: total[c][d + 1 :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
    both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    model: dict = {"prior": float(np.log(n[1] / n[0])), "mean": mean, "factor": {}, "logdet": {}}
    for c in (0, 1):
        k = pooled * min(1.0, 20 * d / n[c])  # less of the pooled covariance, the more rows a class has
        s = (1 - k) * cov[c] + k * both
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + ridge * np.eye(d)
        low = np.linalg.cholesky(s)
        model["factor"][c] = low
        model["logdet"][c] = float(2 * np.log(np.diag(low)).sum())
    return model


def mahalanobis(x: np.ndarray, mean: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Squared distances: the rows solved against the Cholesky factor by forward substitution, all rows a statistic at a time."""
    y = np.empty((x.shape[1], len(x)))
    for j, part in enumerate((x - mean).T):
        y[j] = (part - low[j, :j] @ y[:j]) / low[j, j]
    return (y * y).sum(0)


def scores(x: np.ndarray, model: dict | None, share: float = 0.5) -> np.ndarray:
    if model is None:
        return np.full(len(x), share)
    log = {c: -0.5 * mahalanobis(x, model["mean"][c], model["factor"][c]) - 0.5 * model["logdet"][c] for c in (0, 1)}
    z = (log[1] - log[0]) * 4 / N_STATS + model["prior"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id):
    """Rows whose crc32 of the id as text leaves remainder 0 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    d = N_STATS

    def measure(batches):
        for batch in batches:
            rows, doc = C.texts(batch.column("text")), batch.column("doc_id")
            for part in C.blocks(rows):
                x = statistics(rows[part])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([doc.slice(part.start, part.stop - part.start), flat], ["doc_id", "stats"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] = total.get(c, 0) + moments(x[y == c])
        for c, v in total.items():
            yield pa.RecordBatch.from_pydict({"y": pa.array(np.full(len(v), c, np.int32)), "k": pa.array(np.arange(len(v), dtype=np.int32)), "v": pa.array(v)})

    stats = C.scratch(C.documents(docs).mapInArrow(measure, "doc_id long, stats array<double>"), "stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    parts = stats.join(known, "doc_id").select("stats", "y").mapInArrow(add, "y int, k int, v double")
    total = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in parts.groupBy("y", "k").agg(F.sum("v").alias("v")).collect():  # 2 (1 + d + d^2) rows, whatever the input
        total[r["y"]][r["k"]] = r["v"]
    n = [total[c][0] for c in (0, 1)]
    model, share = solve(total), float(n[1] / sum(n)) if sum(n) else 0.5

    def apply(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(x, model, share))], ["doc_id", "score"])

    out = stats.mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
