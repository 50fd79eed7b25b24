"""Lexical retrieval packing: sequences of related documents, from a sharded BM25 index.

1. Tokenise.  Ids are kept as a CRC-32 for each ``UNIT`` tokens; the CRC of any cut at
   units follows from them.
2. A document of ``WINDOW`` tokens or more fills whole sequences of its own; its rest
   is placed like any other document.
3. Each document asks an index of ``LEADERS`` documents, numbered so that like ones are
   close, and documents are sorted by
   (best leader, second one, own term of most weight): a lexical order in which related
   documents are close wherever they lie in the input.  The order is cut into shards of about ``SHARD`` documents.
4. A shard holds an inverted index of whole texts (words as 32-bit hashes, BM25 with
   the frequencies and mean length of all documents).  The longest unused document
   seeds a window; its neighbours by score fill it, the last of them cut at a unit;
   what a cut leaves is unused again.

Scale: one shuffle, of term hashes and CRCs instead of texts; a shard is small whatever
the input's size, and rows are dealt evenly.  Placing takes the same work for each
document at every size.  Document frequencies are a vector of ``2 ** DF_BITS`` buckets,
added up on executors in pieces; rare words of a bucket share their sum.  The leaders
and ``BOUNDS`` numbers a shard go through the driver.

Defined results: a null or empty text is the end token alone; repeated rows are
documents of their own; no rows give no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2048
UNIT = 16
END = 1
SHARD = 2048
LEADERS, BOUNDS = 256, 16  # leaders; documents for each shard that place its bounds
ASKED = 64  # documents that ask an index together
GRAIN = 1 << 30
ROW_FROM = 16  # terms of more than 1 / ROW_FROM of an index's documents
DF_BITS, DF_PIECE = 18, 4096
K1, B = 1.2, 0.75
TOKENIZER = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json as ranks; a quarter of the time
TOKENS = "doc_id long, row long, tokens long, crcs binary, terms binary, counts binary, words long"
WHITE_BYTES = b" \t\n\x0b\x0c\r"


def load_encoder(path: str):
    """list of str -> their ids (lists or arrays), and the bytes of each id, from a ranks file (.tiktoken) or a tokenizer file (.json) of one vocabulary."""
    import public_tokenizers
    import tiktoken

    path = path if "/" in path else public_tokenizers.path(path)
    with open(path.removesuffix(".json").removesuffix(".tiktoken") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    names = {i: x for x, i in ranks.items()}
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True  # their strings in a text are ordinary text
        return lambda some: [own.encode(x, add_special_tokens=False).ids for x in some], names
    # only this call gives an array without a list of numbers; the special token is never allowed, so that its string is ordinary text too
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|never|>": (1 << 16) - 1})
    return lambda some: [own.encode_to_numpy(x, disallowed_special=()) for x in some], names


class Tokens:
    """Ids of texts, and the terms that their tokens make up.

    A term is a run of letters, digits and what no text separates: tokens that begin with
    white space or a mark begin one, and so do tokens after a mark.  It is hashed from its
    tokens without their leading space; a word that stands after no space can be cut into
    other tokens and then is another term.
    """

    def __init__(self, path: str = TOKENIZER) -> None:
        self.encode, names = load_encoder(path)
        self.opens, self.closes, self.word = np.ones(1 << 16, bool), np.ones(1 << 16, bool), np.zeros(1 << 16, bool)
        number = {x: i for i, x in names.items()}
        bare = np.arange(1 << 16)
        for i, x in names.items():
            y = x.lstrip(WHITE_BYTES)
            mark = [bool(y) and c < 128 and not chr(c).isalnum() for c in (y[:1] + y[-1:])]
            self.word[i] = bool(y) and not mark[0]
            self.opens[i], self.closes[i] = y != x or not y or mark[0], not y or mark[-1]
            bare[i] = number.get(y, i)
        self.code = C.mix64(bare.astype(np.uint64) + np.uint64(1))

    def batch(self, rows: list[str]) -> list[np.ndarray]:
        out = []
        for x in self.encode(rows):
            ids = np.empty(len(x) + 1, np.uint16)
            ids[:-1], ids[-1] = x, END
            out.append(ids)
        return out

    def terms(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, hash and count of each distinct term, by text and hash."""
        flat = np.concatenate(ids)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        stop = np.cumsum(size)
        first = np.concatenate(([True], self.closes[flat[:-1]])) | self.opens[flat]
        first[stop[:-1]] = True
        begin = np.flatnonzero(first)
        at = np.arange(len(flat)) - np.repeat(begin, np.diff(np.append(begin, len(flat))))
        h = np.add.reduceat(self.code[flat] * (2 * at.astype(np.uint64) + np.uint64(1)), begin)
        keep = self.word[flat[begin]]
        keep &= ~np.isin(begin, stop - 1)  # not the end token
        owner = np.repeat(np.arange(len(ids)), size)[begin[keep]]
        key, count = np.unique(owner.astype(np.uint64) << np.uint64(32) | C.mix64(h[keep]) >> np.uint64(32), return_counts=True)
        return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), count


def _ranges(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``at``, one after another."""
    stop = np.cumsum(size)
    return flat[np.repeat(at - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One encoder for each Python worker: its cache serves all tasks that the worker runs."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def unit_crcs(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The CRC-32 of every unit of each text; whole units of all texts take their steps together."""
    full = np.concatenate([x[: len(x) - len(x) % UNIT] for x in ids]).astype(np.uint32).reshape(-1, UNIT).T.copy()
    crc = np.full(full.shape[1], 0xFFFFFFFF, np.uint32)
    for x in full:
        crc = _moved(crc ^ x, 1)
    crc ^= np.uint32(0xFFFFFFFF)
    out, at = [], 0
    for x in ids:
        n = len(x) // UNIT
        rest = [zlib.crc32(x[n * UNIT :].astype("<u4").tobytes())] if len(x) % UNIT else []
        out.append(np.append(crc[at : at + n], np.array(rest, np.uint32)))
        at += n
    return out


def _advance(n_bytes: int) -> np.ndarray:
    """Tables of the linear map that appending ``n_bytes`` applies to a CRC-32."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        x = (np.arange(256, dtype=np.uint32)) << np.uint32(8 * k)
        for _ in range(n_bytes):
            x = (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
        out[k] = x
    return out


_MAPS: dict[int, np.ndarray] = {}


def _moved(crc: np.ndarray, tokens: int) -> np.ndarray:
    if tokens not in _MAPS:
        _MAPS[tokens] = _advance(4 * tokens)
    t = _MAPS[tokens]
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


def join_crcs(crcs: list[np.ndarray], length: np.ndarray) -> np.ndarray:
    """The CRC of each run of units; only the last unit of a run can be short."""
    n = np.fromiter(map(len, crcs), np.int64, len(crcs))
    at = np.cumsum(n) - n
    flat = np.concatenate(crcs) if crcs else np.zeros(0, np.uint32)
    out, last = flat[at].copy(), length - (n - 1) * UNIT
    for k in range(1, int(n.max(initial=1))):
        full = np.flatnonzero((n > k + 1) | ((n == k + 1) & (last == UNIT)))
        out[full] = _moved(out[full], UNIT) ^ flat[at[full] + k]
        for i in np.flatnonzero((n == k + 1) & (last < UNIT)):
            out[i : i + 1] = _moved(out[i : i + 1], int(last[i])) ^ flat[at[i] + k]
    return out


def tokenise(path: str = TOKENIZER):
    def run(batches):
        tokens = tokens_of(path)
        for batch in batches:
            rows = batch.column("text").to_pylist()
            for a in range(0, len(rows), 256):
                ids = tokens.batch([x or "" for x in rows[a : a + 256]])
                owner, term, count = tokens.terms(ids)
                edge = np.searchsorted(owner, np.arange(len(ids) + 1))
                term, count, words = term.astype("<u4"), np.minimum(count, 65535).astype("<u2"), np.bincount(owner, count, len(ids)).astype(np.int64)
                pieces = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, len(ids)), batch.column("row").slice(a, len(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in unit_crcs(ids)], pa.binary()), pieces(term), pieces(count), pa.array(words)],
                    ["doc_id", "row", "tokens", "crcs", "terms", "counts", "words"],
                )

    return run


def bucket(terms: np.ndarray) -> np.ndarray:
    """The bucket of document frequencies of each term."""
    return terms >> np.uint32(32 - DF_BITS)


def frequencies(batches):
    """Documents of each bucket of terms in a task, in pieces."""
    df = np.zeros(1 << DF_BITS, np.uint32)
    for batch in batches:
        for x in batch.column("terms").to_pylist():
            df[bucket(np.frombuffer(x, "<u4"))] += 1  # once for each document
    for k, piece in enumerate(df.reshape(-1, DF_PIECE)):
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "piece": pa.array([piece.astype("<u4").tobytes()], pa.binary())})


def add_up(key, table: pa.Table) -> pa.Table:
    total = np.zeros(DF_PIECE, np.int64)
    for x in table.column("piece"):
        total += np.frombuffer(x.as_py(), "<u4")
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([total.tobytes()], pa.binary())})


class Index:
    """BM25 over some documents: an inverted index of the terms that they have."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n = len(terms)
        doc = np.repeat(np.arange(self.n), [len(x) for x in terms])
        term = np.concatenate(terms) if terms else np.zeros(0, np.uint32)
        tf = np.concatenate(counts).astype(float) if counts else np.zeros(0)
        size = np.bincount(doc, tf, self.n)
        weight = idf[bucket(term)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1e-9)))
        weight = np.round(weight * GRAIN) / GRAIN  # sums of multiples of 1 / GRAIN are exact, and so the same in any order
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, ordered = doc[order], weight[order], term[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.vocabulary, self.edge = ordered[first], np.append(first, len(term))
        size = np.diff(self.edge)
        # terms of many documents as rows, which add up faster than postings
        common = np.flatnonzero(size * ROW_FROM > self.n)
        self.row = np.full(len(size), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        at = _ranges(np.arange(len(term)), self.edge[common], size[common])
        self.rows[np.repeat(np.arange(len(common)), size[common]), self.doc[at]] = self.weight[at]

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in the index, and their numbers there."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        here = np.flatnonzero(self.vocabulary[at] == terms)
        return here, at[here]

    def numbers(self, terms: list[np.ndarray]) -> list[np.ndarray]:
        """The numbers of those of each document's terms that are in the index."""
        here, number = self.known(np.concatenate(terms))
        return np.split(number, np.searchsorted(here, np.cumsum([len(x) for x in terms])[:-1]))

    def asked(self, number: np.ndarray) -> np.ndarray:
        """The score of every document for some of the index's terms."""
        return self.asked_all([number])[0]

    def asked_all(self, numbers: list[np.ndarray]) -> np.ndarray:
        """The scores of every document for each list of the index's terms."""
        owner, number = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers]), np.concatenate(numbers)
        row = self.row[number]
        common, rare = row >= 0, number[row < 0]
        size = self.edge[rare + 1] - self.edge[rare]
        at = _ranges(np.arange(len(self.doc)), self.edge[rare], size)
        out = np.bincount(np.repeat(owner[~common] * self.n, size) + self.doc[at], self.weight[at], len(numbers) * self.n).reshape(len(numbers), self.n)
        ask = np.zeros((len(numbers), len(self.rows)))
        ask[owner[common], row[common]] = 1
        return out + ask @ self.rows


def fill(tokens: np.ndarray, terms: list[np.ndarray], index: Index) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) that use each document's rest once."""
    start, left = tokens - tokens % WINDOW, tokens % WINDOW
    windows = [[(i, a, WINDOW)] for i in range(len(tokens)) for a in range(0, start[i], WINDOW)]
    start, left = start.copy(), left.copy()
    order, scores = np.argsort(-left, kind="stable"), {}
    for place, seed in enumerate(order):
        if left[seed] and seed not in scores:
            ahead = order[place:]
            ahead = ahead[left[ahead] > 0][:ASKED]  # the next seeds, but for those that windows take until then
            scores = dict(zip(ahead.tolist(), index.asked_all(index.numbers([terms[i] for i in ahead])), strict=True))
        while left[seed]:
            window, room, ranked = [(int(seed), int(start[seed]), int(left[seed]))], WINDOW - int(left[seed]), None
            left[seed] = 0
            if room >= UNIT:
                ranked = scores[seed]
                open_ = np.flatnonzero(left)
                for j in open_[np.argsort(-ranked[open_], kind="stable")] if len(open_) else ():
                    take = int(left[j]) if left[j] <= room else room - room % UNIT
                    window.append((int(j), int(start[j]), take))
                    start[j], left[j], room = start[j] + take, left[j] - take, room - take
                    if room < UNIT:
                        break
            windows.append(window)
    return windows


def toured(leaders: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The leaders in an order in which each is followed by the most alike of those left, so that numbers near each other mean texts near each other."""
    index = Index([t for t, _ in leaders], [c for _, c in leaders], idf, mean)
    alike = index.asked_all(index.numbers([t for t, _ in leaders]))
    alike = alike + alike.T
    out, left = [0], np.ones(len(leaders), bool)
    left[0] = False
    while left.any():
        out.append(int(np.where(left, alike[out[-1]], -1).argmax()))
        left[out[-1]] = False
    return [leaders[i] for i in out]


def place(shared, mean: float):
    """For each document its place in the lexical order, or the shard that the place is in: best leader, second one (10 bits each), term of most weight (24 bits), hash of the row (14 bits)."""

    def run(batches):
        leaders, idf, edge = shared.value
        index = Index([t for t, _ in leaders], [c for _, c in leaders], idf, mean)
        for batch in batches:
            at = []
            row, terms, counts = (batch.column(c).to_pylist() for c in ("row", "terms", "counts"))
            for a in range(0, len(row), ASKED):
                t, tf = ([np.frombuffer(x, kind) for x in some[a : a + ASKED]] for some, kind in ((terms, "<u4"), (counts, "<u2")))
                stop = np.cumsum([len(x) for x in t])
                found = index.asked_all(index.numbers(t))
                t, tf = np.concatenate(t), np.concatenate(tf)
                weight = idf[bucket(t)] * (tf / (tf + K1))
                own = [int(t[i + weight[i:j].argmax()]) >> 8 if j > i else 0 for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
                first = found.argmax(1)
                found[np.arange(len(found)), first] = -1
                for r, x, y, z in zip(row[a : a + ASKED], first.tolist(), found.argmax(1).tolist(), own, strict=True):
                    at.append(x << 48 | y << 38 | z << 14 | zlib.crc32(b"%d" % r) >> 18)
            at = np.array(at, np.int64)
            yield batch.append_column("shard", pa.array(at if edge is None else np.searchsorted(edge, at, "left")))

    return run


def _drawn(column: str, share: float, salt: int):
    """A share of the rows by hash: the same in each run."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def shard_of(base: DataFrame, n: int, shards: int, idf: np.ndarray, mean: float) -> DataFrame:
    """``base`` with ``shard``: neighbours in the lexical order are in one."""
    if shards == 1:
        return base.withColumn("shard", F.lit(0).cast("long"))
    spark = base.sparkSession
    drawn = base.where(F.col("words") > 0).where(_drawn("row", 2 * LEADERS / n, 0))
    leaders = [(np.frombuffer(r["terms"], "<u4"), np.frombuffer(r["counts"], "<u2")) for r in drawn.orderBy(F.xxhash64("row"), "row").limit(LEADERS).select("terms", "counts").collect()]
    leaders = toured(leaders or [(np.zeros(0, np.uint32), np.zeros(0, np.uint16))], idf, mean)
    dealt = lambda some, edge: some.mapInArrow(place(spark.sparkContext.broadcast((leaders, idf, edge)), mean), f"{TOKENS}, shard long")
    seen = dealt(base.where(_drawn("row", BOUNDS * shards / n, 1)), None).select("shard").toArrow().column("shard").to_numpy()
    seen = np.sort(seen)
    return dealt(base, np.unique(seen[np.arange(1, shards) * len(seen) // shards]) if len(seen) else seen)


def pack(docs: DataFrame, path: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"
    base = C.documents(docs).withColumn("row", F.monotonically_increasing_id())
    base = C.scratch(base.mapInArrow(tokenise(path), TOKENS), "tokens")
    n, mean = base.agg(F.count("*"), F.avg("words")).first()
    if not n:
        return spark.createDataFrame([], schema)
    pieces = base.select("terms").mapInArrow(frequencies, "k int, piece binary")
    pieces = sorted(C.by_group(pieces, ["k"], add_up, "k int, piece binary").collect(), key=lambda r: r["k"])  # 2 ** DF_BITS numbers
    df = np.concatenate([np.frombuffer(r["piece"], np.int64) for r in pieces])
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast(idf)

    def one(key, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        tokens = table.column("tokens").to_numpy()
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        crcs, terms = read("crcs", "<u4"), read("terms", "<u4")
        windows = fill(tokens, terms, Index(terms, read("counts", "<u2"), shared.value, mean))
        flat = [(i, a, k, w, p) for w, window in enumerate(windows) for (i, a, k), p in zip(window, np.cumsum([0] + [x[2] for x in window]), strict=False)]
        i, a, k, w, p = (np.array(x, np.int64) for x in zip(*flat, strict=True))
        crc = join_crcs([crcs[d][s // UNIT : -(-(s + m) // UNIT)] for d, s, m in zip(i, a, k, strict=True)], k)
        at = pa.array(i)
        return pa.table({
            "doc_id": table.column("doc_id").take(at), "start": a, "length": k, "ids_crc32": crc.astype(np.int64), "doc_tokens": tokens[i],
            "sequence_id": (np.int64(key[0].as_py()) << np.int64(32)) + w, "offset": p, "row": table.column("row").take(at),
        })

    return C.by_group(shard_of(base, n, -(-n // shard), idf, mean), ["shard"], one, schema)
