"""Languages of words and documents by a linear-chain conditional random field.

Every word of a text gets a language; neighbours are tied by learned transitions, and
forward-backward gives each word its probabilities, so text that switches languages is
cut into runs (``runs``).  A document's language is the one with the largest share of
its letters' probability (``classify``).

Features of a word, in lower case: hashed n-grams of 2 to 4 bytes of the word with a
space on each side, prefix and suffix of four bytes, and the lexicon's log odds of each
language, whose weights are learned too.  The lexicon counts every word of every
document that may be learned from; its entries are the most frequent
words, ``LEXICON`` of them at most (equally frequent ones are all in it or all out).

The field is fitted on a bounded sample of labelled rows: for each language the ``DOCS``
documents of smallest hash, ``SPANS`` spans of ``SPAN`` words from all over each.  Half of
the training sequences are two spans of different languages joined at a random word, so
that transitions are learned from switches as well.

Scale: counts are combined in each partition before their shuffle; the model (2^BITS
times the languages, and the lexicon) doesn't grow with the rows.  Scoring is one pass
without a shuffle.  Within a task, words are cut into chunks whose transfer matrices are
multiplied side by side, then chunks are chained, so that a long text costs no more a
word than a short one.

Defined results: a null text or one without a letter is ``und`` with score 0, as is
every text if there is nothing to learn from; languages that tie go to the first by code
point; a null lang isn't learned from; a null doc_id counts as the empty id; repeated
rows are scored as rows of their own.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD = 4, 2
DOCS, SPANS, SPAN = 300, 8, 48
WIDE = 64  # bytes of the longest word of the sample
LEXICON = 1 << 16
BITS = 17
EPOCHS, BATCH, RATE, DECAY = 3, 128, 0.25, 1e-6
CHUNK = 32
SCORED = 1 << 20  # bytes of text that are scored at a time
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


_FNV, NONE = np.uint32(0x01000193), np.uint32(1 << BITS)


def _row(key: np.ndarray) -> np.ndarray:
    key = key * np.uint32(0x85EBCA6B)
    return (key ^ (key >> np.uint32(15))) >> np.uint32(32 - BITS)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


class Words:
    """Distinct words of a block of texts, and the hashes of their n-grams and affixes."""

    def __init__(self, block: C.TextBlock) -> None:
        self.hash, at, self.number = np.unique(block.word, return_index=True, return_inverse=True)
        size = block.w1[at] - block.w0[at]
        start = np.concatenate(([0], np.cumsum(size + 2)))  # each with a space before and after it
        data = np.full(start[-1], 32, np.uint8)
        source = np.repeat(block.w0[at] - start[:-1] - 1, size)
        inner = np.arange(len(source)) + np.repeat(2 * np.arange(len(at)) + 1, size)
        data[inner] = block.data[source + inner]
        d = data.astype(np.uint32)
        # a gram that leaves its word is the last row of a table, which stays zero
        room = np.repeat(start[1:], size + 2) - np.arange(len(data))
        self.grams, key = [], d
        for n in range(2, 5):
            key = key * _FNV
            key[: len(d) - n + 1] += d[n - 1 :] + np.uint32(n)
            self.grams.append(np.where(room >= n, _row(key), NONE))
        self.affixes, long = [], size >= 4
        for salt, first in ((5, start[:-1] + 1), (6, start[1:] - 5)):
            key = np.full(len(at), salt, np.uint32)
            for k in range(4):
                key = key * _FNV + d[np.minimum(np.maximum(first + k, 0), max(len(d) - 1, 0))]
            self.affixes.append(np.where(long, _row(key * _FNV), NONE))
        self.first = start
        self.scale = (1 / np.sqrt((size + 1) + size + np.maximum(size - 1, 0) + 2.0 * long)).astype(np.float32)
        letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
        self.letters = letters[start[1:]] - letters[start[:-1]]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each word the scaled sum of its grams' and affixes' rows of ``table``."""
        if not len(self.hash):
            return np.zeros((0, table.shape[1]), np.float32)
        a, b, c = (table[g] for g in self.grams)
        a += b
        a += c
        return (np.add.reduceat(a, self.first[:-1], axis=0) + table[self.affixes[0]] + table[self.affixes[1]]) * self.scale[:, None]

    def spread(self, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table that the words use, and what ``each`` word's scaled row adds up to there."""
        down = each * self.scale[:, None]
        size = np.diff(self.first)
        row, down = np.concatenate((*self.grams, *self.affixes)), np.concatenate([np.repeat(down, size, axis=0)] * 3 + [down] * 2)
        found, number = np.unique(row, return_inverse=True)
        out = np.stack([np.bincount(number, down[:, j], len(found)) for j in range(each.shape[1])], 1).astype(np.float32)
        return found[found != NONE], out[found != NONE]


class Model:
    def __init__(self, langs: list[str], known: np.ndarray, odds: np.ndarray) -> None:
        n = len(langs)
        self.langs, self.known, self.odds = langs, known, odds
        self.grams = np.zeros(((1 << BITS) + 1, n), np.float32)
        self.lexicon = np.zeros((n, n), np.float32)
        self.moves, self.start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)

    def entries(self, words: Words) -> np.ndarray:
        """Log odds of the words in the lexicon, zeros for others."""
        out = np.zeros((len(words.hash), len(self.langs)), np.float32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
            hit = self.known[at] == words.hash
            out[hit] = self.odds[at[hit]]
        return out

    def emissions(self, words: Words) -> np.ndarray:
        return np.where(words.letters[:, None] > 0, words.sums(self.grams) + self.entries(words) @ self.lexicon, np.float32(0))


def sequences(e: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (B, T, L), expected transitions (L, L) and log partition of equally long sequences of emissions."""
    b, t, n = e.shape
    top = e.max(2, keepdims=True)
    x, m = np.exp(e - top), np.exp(moves)
    ahead, back = np.empty_like(x), np.empty_like(x)
    norm = np.empty((b, t), x.dtype)
    a = np.exp(start)[None, :] * x[:, 0]
    for k in range(t):
        if k:
            a = (a @ m) * x[:, k]
        norm[:, k] = a.sum(1)
        a = a / norm[:, k, None]
        ahead[:, k] = a
    r = np.ones((b, n), x.dtype)
    for k in range(t - 1, -1, -1):
        back[:, k] = r
        r = ((r * x[:, k]) @ m.T) / norm[:, k, None]
    pairs = np.einsum("bti,btj->ij", ahead[:, :-1], back[:, 1:] * x[:, 1:] / norm[:, 1:, None]) * m
    return ahead * back, pairs, float(np.log(norm).sum() + top.sum())


def marginals(e: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probabilities of each word's languages, for documents whose words begin at ``first`` (with the total at its end)."""
    n = e.shape[1]
    if n < 2 or not len(e):
        return np.ones_like(e)
    count = np.diff(first)
    chunks = -(-count // CHUNK)
    doc = np.repeat(np.arange(len(count)), chunks)
    base = np.concatenate(([0], np.cumsum(chunks)))
    within = np.arange(len(doc)) - base[doc]
    begin = first[:-1][doc] + CHUNK * within
    length = np.minimum(CHUNK, first[1:][doc] - begin)
    m, opening = np.exp(moves).astype(np.float32), np.exp(start - start.max()).astype(np.float32)
    scaled = lambda v: v / v.sum(0, keepdims=True)
    lead = within == 0
    steps = np.arange(CHUNK)[:, None]
    live = steps < length[None, :]
    at = begin[None, :] + np.minimum(steps, length[None, :] - 1)
    # (step, language, chunk): states are columns, so each step is one product of matrices
    x = np.exp(e - e.max(1, keepdims=True)).astype(np.float32)[at].transpose(0, 2, 1).copy()
    # transfer matrix of each chunk; a text's first word has no transition before it
    through = np.repeat(np.eye(n, dtype=np.float32)[:, :, None], len(doc), 2)
    for t in range(CHUNK):
        moved = np.matmul(m.T, through)
        if t == 0:
            moved = np.where(lead, through, moved)
        moved *= x[t]
        if t % 4 == 3:
            moved /= moved.max((0, 1))
        through = moved if live[t].all() else np.where(live[t], moved, through)
    through = (through / through.max((0, 1))).transpose(2, 0, 1).copy()
    # chunks of a text one after another, those of all texts side by side
    order = np.argsort(-chunks, kind="stable")
    left, right = np.empty((len(doc), n), np.float32), np.empty((len(doc), n), np.float32)
    a = np.repeat((opening / opening.sum())[None, :], len(count), 0)
    most = int(chunks.max(initial=0))
    alive = np.searchsorted(-chunks[order], -np.arange(most), side="left")  # texts with more than k chunks
    for k in range(most):
        some = order[: alive[k]]
        c = base[some] + k
        left[c] = a[some]
        v = (a[some][:, None, :] @ through[c])[:, 0]
        a[some] = v / v.sum(1, keepdims=True)
    z = np.ones((len(count), n), np.float32)
    for k in range(most - 1, -1, -1):
        some = order[: alive[k]]
        c = base[some] + k
        right[c] = z[some]
        v = (through[c] @ z[some][:, :, None])[:, :, 0]
        z[some] = v / v.sum(1, keepdims=True)
    ahead = np.empty_like(x)
    a = left.T
    for t in range(CHUNK):
        moved = m.T @ a
        if t == 0:
            moved = np.where(lead, a, moved)
        a = ahead[t] = scaled(moved * x[t])
    z = right.T
    for t in range(CHUNK - 1, -1, -1):
        ahead[t] *= z
        moved = scaled(m @ (z * x[t]))
        z = moved if live[t].all() else np.where(live[t], moved, z)
    out = np.empty_like(e, np.float32)
    out[at[live]] = ahead.transpose(0, 2, 1)[live]
    return out / out.sum(1, keepdims=True)


def _blocks(rows: list[bytes], n: int):
    yield from C.blocks(rows, max(1 << 16, SCORED * 16 // max(n * n, 16)))


def _lower(column: pa.Array) -> list[bytes]:
    return C.texts(pc.utf8_lower(column))


def _taught(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return base.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def _counted(taught: DataFrame) -> DataFrame:
    """lang, word (a hash), n: every word of the documents that may be learned from."""

    def count(batches):
        for batch in batches:
            rows = _lower(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy()
            for s in C.blocks(rows):
                block = C.TextBlock(rows[s])
                whose = code[s][block.owner]
                for k in np.unique(whose):
                    word, n = np.unique(block.word[whose == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[int(k)].as_py()] * len(word)), pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return taught.select("text", "lang").mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _sample(taught: DataFrame, rows: dict[str, int], docs: int, seed: int) -> DataFrame:
    """lang, span: words of the spans of at most ``docs`` documents of each language."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 31))
    # as many as wanted twice over by a threshold, then the smallest of those
    upto = F.create_map(*[F.lit(v) for lang, n in rows.items() for v in (lang, int(min(1.0, 2 * docs / n + 0.001) * (1 << 31)))])
    near = taught.withColumn("draw", draw).where(F.col("draw") < F.element_at(upto, F.col("lang")))

    def cut(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), _lower(batch.column("text")), strict=True):
                words = [w for w in text.split() if len(w) <= WIDE]
                n = -(-len(words) // SPAN)
                for k in sorted({i * n // SPANS for i in range(SPANS)} if n else ()):
                    out.append((lang, b" ".join(words[k * SPAN : (k + 1) * SPAN])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["lang", "span"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= docs).select("lang", "text").mapInArrow(cut, "lang string, span binary")


def _fit(model: Model, spans: list[tuple[int, list[bytes]]], seed: int) -> None:
    """Conditional likelihood by adaptive gradient steps over sequences of ``SPAN`` words."""
    rng = np.random.default_rng(seed)
    n = len(model.langs)
    spans = [(k, w) for k, w in spans if len(w) > 1]
    if n < 2 or not spans:
        return
    texts, code = [], []
    for _ in range(EPOCHS):
        for i, j in enumerate(rng.permutation(len(spans))):
            (k, w), (k2, w2) = spans[i], spans[j]
            if rng.random() < 0.5 and k2 != k:
                at = rng.integers(1, min(len(w), len(w2)))
                w, c = w[:at] + w2[at:], [k] * at + [k2] * (len(w2) - at)
            else:
                c = [k] * len(w)
            texts.append(w)
            code.append(c)
    order = sorted(rng.permutation(len(texts)), key=lambda i: len(texts[i]))  # batches of equal lengths
    batches, some = [], []
    for i in order:
        if some and (len(some) == BATCH or len(texts[i]) != len(texts[some[0]])):
            batches.append(some)
            some = []
        some.append(i)
    batches.append(some)
    parts = [model.grams, model.lexicon, model.moves, model.start]
    gain = [np.full_like(p, 1e-3) for p in parts]

    def step(k: int, rows, g: np.ndarray) -> None:
        g = g - DECAY * parts[k][rows]
        gain[k][rows] += g * g
        parts[k][rows] += RATE * g / np.sqrt(gain[k][rows])

    for b in rng.permutation(len(batches)):
        block = C.TextBlock([b" ".join(texts[i]) for i in batches[b]])
        words, shape = Words(block), (len(batches[b]), len(texts[batches[b][0]]))
        want = np.array([code[i] for i in batches[b]])
        e = model.emissions(words)[words.number].reshape(*shape, n)
        p, pairs, _ = sequences(e, model.moves, model.start)
        g = (np.eye(n, dtype=np.float32)[want] - p).reshape(-1, n)
        each = np.stack([np.bincount(words.number, g[:, j], len(words.hash)) for j in range(n)], 1).astype(np.float32)
        each[words.letters == 0] = 0
        step(1, slice(None), model.entries(words).T @ each / len(batches[b]))
        seen = np.zeros((n, n), np.float32)
        np.add.at(seen, (want[:, :-1].ravel(), want[:, 1:].ravel()), 1)
        step(2, slice(None), (seen - pairs) / len(batches[b]))
        step(3, slice(None), (np.bincount(want[:, 0], minlength=n) - p[:, 0].sum(0)) / len(batches[b]))
        found, down = words.spread(each)
        step(0, found, down / len(batches[b]))


def _least(words: DataFrame, most: int) -> int:
    """The least count with which at most ``most`` words are that frequent (to a hundredth, where counts are large)."""
    step = F.when(F.col("all") < 4096, F.col("all")).otherwise(F.floor(F.exp(F.ceil(F.ln("all") * 64) / 64)))
    total, above = 0, 1 << 62
    for r in sorted(words.groupBy(step.cast("long").alias("at")).agg(F.count("*").alias("n"), F.min("all").alias("least")).collect(), key=lambda r: -r["at"]):  # a few thousand rows
        if (total := total + r["n"]) > most:
            return above
        above = int(r["least"])
    return 0


def train(docs: DataFrame, lexicon: int = LEXICON, sample: int = DOCS, seed: int = 7) -> Model:
    """The field and its lexicon from text and lang of the documents that aren't held out."""
    taught = _taught(docs)
    rows = {r["lang"]: r["n"] for r in taught.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(rows)
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    counts = C.scratch(_counted(taught), "counts")
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    number = {x: i for i, x in enumerate(langs)}
    by_word = C.scratch(counts.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")), "words")
    most = by_word.where(F.col("all") >= _least(by_word, lexicon)).select("word", "by").collect()  # at most as many as the lexicon has entries
    known = np.array([r["word"] for r in most], np.int64).view(np.uint64)
    odds = np.zeros((len(most), len(langs)), np.float64)
    for i, r in enumerate(most):
        for x in r["by"]:
            odds[i, number[x["lang"]]] = x["n"]
    rate = np.log((odds + 0.5) / (np.array([total.get(x, 0) for x in langs])[None, :] + 1))
    order = np.argsort(known)
    model = Model(langs, known[order], np.clip(rate - rate.mean(1, keepdims=True), -6, 6).astype(np.float32)[order])
    spans = [(number[r["lang"]], bytes(r["span"]).split()) for r in _sample(taught, rows, sample, seed).collect()]
    _fit(model, sorted(spans), seed)
    return model


def _labelled(model: Model, rows: list[bytes]):
    """Blocks of the texts with each word's probabilities."""
    for s in _blocks(rows, len(model.langs)):
        block = C.TextBlock(rows[s])
        words = Words(block)
        yield s, block, words, marginals(model.emissions(words)[words.number], block.first, model.moves, model.start)


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see the parameters
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("worded", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def score(batches):
        model = sent.value
        for batch in batches:
            best, share = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            worded = np.array(batch.column("worded").to_pylist(), bool) & bool(model.langs)
            rows = [x if w else b"" for x, w in zip(_lower(batch.column("text")), worded, strict=True)]
            for s, block, words, p in _labelled(model, rows) if model.langs else ():
                weight = words.letters[words.number].astype(np.float64)[:, None] * p
                total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(weight, 0)))
                total = np.maximum(total[block.first[1:]] - total[block.first[:-1]], 0)
                best[s] = total.argmax(1)
                share[s] = total.max(1) / np.maximum(total.sum(1), 1e-300)
            lang = [model.langs[k] if w else UNKNOWN for k, w in zip(best, worded, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(np.where(worded, np.minimum(share, 1.0), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return base.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def runs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, n_words, lang, score: maximal runs of words of one language (words without letters go with the run around them)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, start long, n_words long, lang string, score double"

    def label(batches):
        model = sent.value
        for batch in batches:
            ids, rows, out = batch.column("doc_id").to_pylist(), _lower(batch.column("text")), []
            for s, block, _, p in _labelled(model, rows) if model.langs else ():
                best = p.argmax(1)
                turn = np.ones(len(best), bool)
                turn[1:] = (best[1:] != best[:-1]) | (block.owner[1:] != block.owner[:-1])
                at = np.flatnonzero(turn)
                for a, b in zip(at, np.append(at, len(best))[1:], strict=True):
                    d = block.owner[a]
                    out.append((ids[s][d], int(a - block.first[d]), int(b - a), model.langs[best[a]], float(p[a:b, best[a]].mean())))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(label, schema)
