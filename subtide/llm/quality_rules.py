"""Quality rules: base word rules, then a hashed n-gram logistic regression with calibrated probabilities.

The classifier hashes word 1- and 2-grams and character 3- and 4-grams (of code
points) into ``2**BITS`` weights.  A document's features are the relative
frequencies of each family, so its score is a bias plus the mean weight over its
n-grams: one gather and one mean for a whole text.  It learns from a bounded,
class-stratified sample of labelled rows (``max_labelled``); Platt scaling on a
fifth of the sample calibrates the probabilities, with the classes weighted back
to their shares among all labels.

Defined results: a null text has no words; an empty one fails the word rule; null
and repeated labels count once for each document (the smallest); without labels of
both classes nothing is rejected by the method.  Columns of the input beside
doc_id and text are not read, and repeated rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
FAMILIES = 4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
KEEP_FROM = 0.2

_SHIFT = np.uint64(64 - BITS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes begins, and its bytes as one number."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    code = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        code[long] |= data[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return at, code


def ngrams(block: C.TextBlock):
    """Of each family: the hashed feature of every n-gram, and each document's bounds among them."""
    n = len(block.rows)
    yield (block.word >> _SHIFT).astype(np.int32), block.first
    at, h = block.windows(2)
    yield (h >> _SHIFT).astype(np.int32), np.concatenate((np.searchsorted(block.owner[at], np.arange(n)), [len(at)]))
    at, char = characters(block.data)
    char = char * np.uint32(0x9E3779B1)
    start, stop = np.searchsorted(at, block.start), np.searchsorted(at, block.stop)
    for width in (3, 4):
        if len(char) < width:
            yield np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
            continue
        last = len(char) - width + 1
        code = char[:last].copy()
        for k in range(1, width):
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B) + char[k : k + last]
        code = (code ^ (code >> np.uint32(13))) * np.uint32(0xC2B2AE35) + np.uint32(width)
        # n-grams over a document's end are left out through its bounds
        yield (code >> np.uint32(32 - BITS)).astype(np.int32), np.stack((start, np.maximum(stop - width + 1, start)))


def _bounds(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (edges[0], edges[1]) if edges.ndim == 2 else (edges[:-1], edges[1:])


def raw_scores(block: C.TextBlock, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log odds before calibration."""
    z = np.full(len(block.rows), bias)
    for f, (feature, edges) in enumerate(ngrams(block)):
        a, b = _bounds(edges)
        c = np.concatenate(([0.0], np.cumsum(weights[f][feature], dtype=np.float64)))
        z += (c[b] - c[a]) / np.maximum(b - a, 1)
    return z


def sparse_rows(block: C.TextBlock, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature ids (family in the high bits) and relative frequencies of some documents."""
    out: list[list] = [[] for _ in which]
    for f, (feature, edges) in enumerate(ngrams(block)):
        a, b = _bounds(edges)
        for k, i in enumerate(which):
            ids, counts = np.unique(feature[a[i] : b[i]], return_counts=True)
            out[k].append((ids + (f << BITS), (counts / max(b[i] - a[i], 1)).astype(np.float32)))
    return [(np.concatenate([x[0] for x in row]).astype(np.int32), np.concatenate([x[1] for x in row])) for row in out]


def platt(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of least weighted log loss: Newton steps, halved until they lower the loss."""

    def loss(a: float, b: float) -> float:
        x = a * z + b
        return float((weight * (np.logaddexp(0, x) - target * x)).sum() + 0.5e-4 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(d * z).sum() + 1e-4 * (a - 1), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step, now = np.linalg.solve(hess, grad), loss(a, b)
        while loss(a - step[0], b - step[1]) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, updates: int = 24_000, seed: int = 7) -> dict:
    """Adagrad on the logistic loss, classes weighted evenly, as many epochs as make ``updates``; then Platt scaling on every fifth row."""
    w, g = np.zeros(FAMILIES << BITS, np.float32), np.full(FAMILIES << BITS, 1e-6, np.float32)
    bias, held = 0.0, np.arange(len(y)) % 5 == 0
    share = {c: max(float(np.mean(y[~held] == c)), 1e-3) for c in (0, 1)}
    rng = np.random.default_rng(seed)
    for _ in range(int(np.clip(updates // max(len(y), 1), 10, 400))):
        for i in rng.permutation(np.flatnonzero(~held)):
            ids, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(bias + float(w[ids] @ x), -30, 30)))
            d = np.float32((p - y[i]) * 0.5 / share[int(y[i])])
            grad = d * x
            g[ids] += grad * grad
            w[ids] -= np.float32(0.3) * grad / np.sqrt(g[ids])
            bias -= 0.02 * float(d)
    z = np.array([bias + float(w[i] @ x) for i, x in rows])
    fitted = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    zz, yy = z[fitted], y[fitted].astype(float)
    n1, n0 = max(yy.sum(), 1), max((1 - yy).sum(), 1)
    target = np.where(yy == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(yy == 1, prior / n1, (1 - prior) / n0)
    a, b = platt(zz, target, weight)
    return {"w": w.reshape(FAMILIES, -1), "bias": bias, "a": float(max(a, 1e-3)), "b": float(b)}


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 2400, learn: Column | None = None) -> dict | None:
    """Fit on at most ``max_labelled`` labelled rows, half of each class where there are enough.

    The sample is the labelled rows with the smallest hashes of their id.  Its ids
    (bounded) go to the executors; feature rows of these documents alone come back.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    wanted: dict[int, int] = {}
    for y in (0, 1):
        wanted |= {r["doc_id"]: y for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled // 2).collect()}
    ids = spark.sparkContext.broadcast(wanted)

    def gather(batches):
        for batch in batches:
            at = [i for i, d in enumerate(batch.column("doc_id").to_pylist()) if d in ids.value]
            if not at:
                continue
            rows, doc = C.texts(batch.column("text").take(pa.array(at))), [batch.column("doc_id")[i].as_py() for i in at]
            for part in C.blocks(rows):
                block = C.TextBlock(rows[part])
                got = sparse_rows(block, np.arange(len(block.rows)))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[part], pa.int64()), "ids": pa.array([x.tobytes() for x, _ in got], pa.binary()), "x": pa.array([x.tobytes() for _, x in got], pa.binary())})

    seen, features, y = set(), [], []
    for r in sorted(C.documents(docs).mapInArrow(gather, "doc_id long, ids binary, x binary").collect(), key=lambda r: (r["doc_id"], r["ids"])):
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            features.append((np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32)))
            y.append(wanted[r["doc_id"]])
    ids.unpersist()
    if len(set(y)) < 2:
        return None
    order = np.random.default_rng(3).permutation(len(y))
    return fit([features[i] for i in order], np.array(y)[order], counts[1] / (counts[0] + counts[1]))


def judge(rows: list[bytes], model: dict | None) -> dict[str, np.ndarray]:
    """Base columns, ``score`` (1.0 where there is no model) and the verdict for some texts."""
    block = C.TextBlock(rows)
    words, repeat = block.n_words, block.repeat_words()
    failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
    if model is None:
        score = np.ones(len(rows))
    else:
        score = 1 / (1 + np.exp(-np.clip(model["a"] * raw_scores(block, model["w"], model["bias"]) + model["b"], -40, 40)))
    return {
        "n_words": words,
        "word_chars": block.count(~block.space & ((block.data & 0xC0) != 0x80)),
        "n_symbols": block.count(_SYMBOL[block.data]),
        "n_dup_lines": block.dup_lines()[1],
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": ~failed & (score >= KEEP_FROM),
        "score": score,
    }


def _share(spark, model):
    return spark.sparkContext.broadcast(model)


def rules(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per document with the base columns and the verdict."""
    shared = _share(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            rows, doc = C.texts(batch.column("text")), batch.column("doc_id")
            for part in C.blocks(rows):
                got = judge(rows[part], shared.value)
                yield pa.RecordBatch.from_pydict({"doc_id": doc.slice(part.start, part.stop - part.start)} | {k: pa.array(v) for k, v in got.items()})

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return C.documents(docs).mapInArrow(run, schema)


def keep(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are."""
    shared = _share(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            rows = C.texts(batch.column("text"))
            mask = [judge(rows[part], shared.value)["kept"] for part in C.blocks(rows)]
            yield batch.filter(pa.array(np.concatenate(mask) if mask else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
