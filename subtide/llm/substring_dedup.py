"""Exact substring dedup: suffixes sorted by a common-prefix-aware distributed merge sort.

A byte goes if a ``WIDTH``-byte string that covers it starts anywhere else too.

Sparse suffixes.  Every window of ``WIDTH`` bytes owns the smallest (by hash) of its
``SEED``-byte strings, the leftmost of equals; that position is the window's anchor.
Equal windows have their anchors at the same place, so only the suffixes that begin
at anchors are sorted, one in about 85 bytes of ordinary text.  An anchor's context
is its suffix up to the end of its last window (the right part) and what lies before
it from the start of its first window (the left part).

1. Blocks of some megabytes of text are written to the shared folder, with the
   fingerprints of their anchors' seeds.  Only anchors whose fingerprint occurs twice
   go on: no others can own a repeated window (a distinguishing-prefix filter).
2. Each block sorts the right parts of those anchors into runs, one for each bucket
   of seeds, equal contexts once, and sends them front-coded: the length of the
   common prefix with the one before, and the bytes after it.
3. A bucket merges its runs with a loser tree.  Heads carry the length of their common
   prefix with the last winner: the longer one wins without a look at the bytes, and
   equal ones are compared from there on, so no known prefix is compared again.
4. In the merged order the suffixes that share ``WIDTH - j`` bytes are an interval, for
   every j; two windows that start j bytes before their anchors are equal if they lie
   in one interval and their j left bytes agree.  Repeated windows go back to their
   blocks as bit maps, where covered bytes are removed.

Scale: texts are written once and never shuffled; a task has a block or a bucket of
about ``BUCKET`` contexts; a context that many documents share is sent once by each
block.  Left bytes agree by a 64-bit rolling hash within one interval.

Defined results: a null text is empty; strings shorter than ``WIDTH`` bytes lose
nothing; repeated rows are documents of their own and lose what they share; empty
tables give no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .warc import Output, open_fs

WIDTH = 200
SEED = 32
REACH = WIDTH - SEED + 1
BUCKET = 20_000
_MULT = np.uint64(0xD6E8FEB86659FD93)
_BYTE = C.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Anchors:
    """Anchors ``p`` of a block of texts, their first and last windows ``a`` and ``b``, and the fingerprints of their seeds."""

    def __init__(self, rows: list[bytes]) -> None:
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.raw = b"".join(rows)
        self.data = np.frombuffer(self.raw, np.uint8)
        none = np.zeros(0, np.int64)
        self.p = self.a = self.b = none
        self.seed = np.zeros(0, np.uint64)
        n = len(self.data) - WIDTH + 1
        if n <= 0:
            return
        h, step, mult = _BYTE[self.data], 1, _MULT
        while step < SEED:  # hash of 2, 4, ... SEED bytes at each position
            h = h[:-step] * mult + h[step:]
            step, mult = 2 * step, np.uint64(int(mult) ** 2 % (1 << 64))
        h = C.mix64(h)
        bits = np.uint64(32)  # of the place; the other half of the hash decides, alike in all blocks and for texts up to 4 GB
        low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= REACH:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: n], low[REACH - span : REACH - span + n])
        anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        fits = np.zeros(n + 1, np.int8)
        some = size >= WIDTH
        np.add.at(fits, self.start[some], 1)
        np.add.at(fits, self.stop[some] - WIDTH + 1, -1)
        at = np.flatnonzero(np.cumsum(fits[:n]))
        if not len(at):
            return
        own = anchor[at]
        # the same anchor can't belong to windows of two documents: it lies inside them
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        self.p, self.a, self.b = own[first], at[first], at[np.append(first[1:], len(at)) - 1]
        self.seed = h[self.p]


class Contexts:
    """The distinct contexts of some anchors of a block, by right part: ``of`` has each anchor's number among them."""

    def __init__(self, anchors: Anchors, chosen: np.ndarray) -> None:
        raw, self.chosen = anchors.raw, chosen
        p, a, b = (x[chosen].tolist() for x in (anchors.p, anchors.a, anchors.b))
        seed = anchors.seed[chosen]
        text = [(raw[x : z + WIDTH], raw[y:x]) for x, y, z in zip(p, a, b, strict=True)]
        self.right, self.left, self.seed, self.many = [], [], [], []
        of, last = np.zeros(len(text), np.int64), None
        for i in sorted(range(len(text)), key=text.__getitem__):
            if text[i] != last:
                last = text[i]
                self.right.append(last[0])
                self.left.append(last[1])
                self.seed.append(seed[i])
                self.many.append(0)
            else:
                self.many[-1] = 1
            of[i] = len(self.right) - 1
        self.of, self.many = of, np.array(self.many, np.uint8)
        self.seed = np.array(self.seed, np.uint64)


def common_prefix(x: bytes, y: bytes, k: int = 0) -> int:
    """Length of the common prefix, ``k`` of which is known."""
    n = min(len(x), len(y))
    u, v = x[k:n], y[k:n]
    if u == v:
        return n
    differ = int.from_bytes(u, "big") ^ int.from_bytes(v, "big")
    return n - (differ.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    shared, rest, last = np.zeros(len(strings), np.uint8), [], b""
    for i, x in enumerate(strings):
        shared[i] = k = common_prefix(last, x)
        rest.append(x[k:])
        last = x
    return shared, rest


def merge(runs: list[tuple[np.ndarray, list[bytes]]]) -> tuple[list[int], list[int]]:
    """Runs of front-coded sorted strings in one order: the run each string comes from, and its common prefix with the one before.

    A tree of losers.  ``known[r]`` is the common prefix of run r's head with the last
    string that won against it, which is the last one given out wherever r is asked.
    """
    k = 1
    while k < len(runs):
        k *= 2
    shared = [r[0].tolist() for r in runs] + [[]] * (k - len(runs))
    rest = [r[1] for r in runs] + [[]] * (k - len(runs))
    head: list[bytes | None] = [x[0] if x else None for x in rest]
    known, at = [0] * k, [0] * k
    tree = [0] * (2 * k)

    def beats(r: int, s: int) -> bool:
        x, y = head[r], head[s]
        if y is None or x is None:
            return y is None
        a, b = known[r], known[s]
        if a != b:
            return a > b
        n = common_prefix(x, y, a)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[s] = n
            return True
        known[r] = n
        return False

    level = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        r, s = level[2 * node], level[2 * node + 1]
        level[node], tree[node] = (r, s) if beats(r, s) else (s, r)
    top = level[1]
    origin, prefix = [], []
    while head[top] is not None:
        origin.append(top)
        prefix.append(known[top])
        at[top] += 1
        i = at[top]
        if i < len(rest[top]):
            n = shared[top][i]
            head[top] = head[top][:n] + rest[top][i]
            known[top] = n
        else:
            head[top] = None
        node = (top + k) >> 1
        while node:
            s = tree[node]
            if not beats(top, s):
                tree[node], top = top, s
            node >>= 1
    return origin, prefix


def repeated(prefix: np.ndarray, left: list[bytes], lo: np.ndarray, hi: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each context, in merged order, and each j: whether its window that starts j bytes before the anchor is found in another context."""
    n = len(left)
    out = np.zeros((n, REACH), bool)
    size = np.fromiter(map(len, left), np.int64, n)
    flat = np.frombuffer(b"".join(left), np.uint8)
    stop = np.cumsum(size)
    h = np.zeros(n, np.uint64)
    for j in range(REACH):
        if j:  # the j-th byte before the anchor
            has = size >= j
            h[has] = h[has] * _MULT + _BYTE[flat[stop[has] - j]]
        cut = prefix < WIDTH - j
        group = np.cumsum(cut)
        alone = cut & np.append(cut[1:], True)
        at = np.flatnonzero((lo <= j) & (j <= hi) & ~alone)
        if not len(at):
            continue
        key = C.mix64(h[at] + C.mix64(group[at].astype(np.uint64) + _MULT))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        out[at[order[1:][same]], j] = True
        out[at[order[:-1][same]], j] = True
    inside = (lo[:, None] <= np.arange(REACH)) & (np.arange(REACH) <= hi[:, None])
    out[many > 0] |= inside[many > 0]
    return out


def removed(anchors: Anchors, starts: np.ndarray) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each document, from the starts of repeated windows."""
    n = len(anchors.data)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WIDTH, -1)
    gone = np.cumsum(edge[:n]) > 0
    out = []
    for a, b in zip(anchors.start, anchors.stop, strict=True):
        mask = gone[a:b]
        k = int(mask.sum())
        kept = anchors.raw[a:b] if not k else anchors.data[a:b][~mask].tobytes()
        spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(len(mask) > 0 and mask[0]) if k else 0
        out.append((int(b - a), k, spans, hashlib.sha256(kept).hexdigest()))
    return out


# The steps below run in tasks.  A block is named by its file, offset and length.


def _read_block(folder: str, name: str) -> pa.Table:
    file, offset, length = name.split(":")
    fs, path = open_fs(folder)
    with fs.open_input_file(f"{path}/{file}") as f:
        f.seek(int(offset))
        return pa.ipc.open_stream(f.read(int(length))).read_all()


def write_blocks(folder: str):
    def run(batches):
        out, rows, held = None, [], 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def flush():
            nonlocal out, rows, held
            out = out or Output(folder, ".blocks")
            table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table)
            raw = sink.getvalue()
            name = f"{out.name}:{out.size}:{len(raw)}"
            out.write(raw)
            found, times = np.unique(Anchors([r[1] for r in rows]).seed, return_counts=True)
            rows, held = [], 0
            return name, found.view(np.int64), times > 1

        done = []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), C.texts(batch.column("text")), strict=True):
                rows.append((doc, text))
                held += len(text) + 64
                if held >= C.BLOCK_BYTES:
                    done.append(flush())
        if rows:
            done.append(flush())
        if out is not None:
            out.close()
        for name, found, twice in done:  # known only when the file is complete
            yield pa.RecordBatch.from_pydict({"block": [name], "seeds": pa.array([found], pa.list_(pa.int64())), "twice": pa.array([twice], pa.list_(pa.bool_()))})

    return run


def _chosen(anchors: Anchors, seeds) -> np.ndarray:
    return np.flatnonzero(np.isin(anchors.seed, np.asarray(seeds, np.int64).view(np.uint64)))


def send_runs(folder: str, buckets: int):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                anchors = Anchors(_read_block(folder, block).column("text").to_pylist())
                chosen = _chosen(anchors, batch.column("seeds")[k].values.to_numpy())
                c = Contexts(anchors, chosen)
                first = np.zeros(len(c.right), np.int64)
                first[c.of[::-1]] = chosen[::-1]
                lo, hi = anchors.p[first] - anchors.b[first], anchors.p[first] - anchors.a[first]
                home = (c.seed % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []
                for part in parts:
                    shared, rest = front_code([c.right[i] for i in part])
                    left = [c.left[i] for i in part]
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([home[part[0]]], pa.int64()), "block": [block], "ids": pa.array([part.astype(np.int32).tobytes()], pa.binary()),
                        "shared": pa.array([shared.tobytes()], pa.binary()), "size": pa.array([np.array([len(x) for x in rest], np.uint8).tobytes()], pa.binary()),
                        "bounds": pa.array([np.stack((lo[part], hi[part], c.many[part])).astype(np.uint8).tobytes()], pa.binary()),
                        "bytes": pa.array([squeeze.compress(b"".join(rest + left))], pa.binary()),
                    })

    return run


def _cut(raw: bytes, sizes: np.ndarray, at: int = 0) -> list[bytes]:
    edge = (at + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))).tolist()
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def merge_bucket(key, table: pa.Table) -> pa.Table:
    runs, left, bounds, ids = [], [], [], []
    for r in table.select(["ids", "shared", "size", "bounds", "bytes"]).to_pylist():
        size, three = np.frombuffer(r["size"], np.uint8), np.frombuffer(r["bounds"], np.uint8).reshape(3, -1)
        raw = zstandard.ZstdDecompressor().decompress(r["bytes"], max_output_size=1 << 31) if r["bytes"] else b""
        runs.append((np.frombuffer(r["shared"], np.uint8), _cut(raw, size)))
        left.append(_cut(raw, three[1], int(size.sum(dtype=np.int64))))
        bounds.append(three)
        ids.append(np.frombuffer(r["ids"], np.int32))
    origin, prefix = merge(runs)
    origin = np.array(origin, np.int64)
    # the i-th string of a run is the i-th time that the run is named
    place = np.zeros(len(origin), np.int64)
    order = np.argsort(origin, kind="stable")
    counts = np.array([len(x) for x in ids])
    place[order] = np.arange(len(origin)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(counts) - counts)[origin] + place
    three = np.concatenate(bounds, 1)[:, at].astype(np.int64)
    every = [x for part in left for x in part]
    found = repeated(np.array(prefix, np.int64), [every[i] for i in at.tolist()], three[0], three[1], three[2])
    hit = np.flatnonzero(found.any(1))
    packed, number = np.packbits(found[hit], axis=1), np.concatenate(ids)[at[hit]]
    blocks, rows = table.column("block").to_pylist(), []
    for r in np.unique(origin[hit]):
        mine = origin[hit] == r
        rows.append((blocks[r], number[mine].tobytes(), packed[mine].tobytes()))
    names, kinds = ("block", "ids", "bits"), (pa.string(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=list(names))


def finish(folder: str):
    def run(batches):
        wide = -(-REACH // 8)
        for batch in batches:
            for k in range(batch.num_rows):
                table = _read_block(folder, batch.column("block")[k].as_py())
                anchors = Anchors(table.column("text").to_pylist())
                starts = np.zeros(0, np.int64)
                seeds = batch.column("seeds")[k]
                if seeds.is_valid and len(seeds.values):
                    c = Contexts(anchors, _chosen(anchors, seeds.values.to_numpy()))
                    found = np.zeros((len(c.right), REACH), bool)
                    for reply in batch.column("replies")[k].as_py() or ():
                        bits = np.unpackbits(np.frombuffer(reply["bits"], np.uint8).reshape(-1, wide), axis=1, count=REACH)
                        found[np.frombuffer(reply["ids"], np.int32)] = bits
                    i, j = np.nonzero(found[c.of])
                    starts = anchors.p[c.chosen[i]] - j
                rows = removed(anchors, starts)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    spark = docs.sparkSession
    folder = f"{C.shared_dir(spark)}/{uuid.uuid4().hex}"
    blocks = C.scratch(C.documents(docs).mapInArrow(write_blocks(folder), "block string, seeds array<long>, twice array<boolean>"), "blocks")
    # a seed that a third of all texts share has one row for each block
    seeds = blocks.select("block", F.explode(F.arrays_zip("seeds", "twice")).alias("x")).select("block", "x.seeds", "x.twice")
    often = C.summed(seeds, ["seeds"], F.count("*").alias("n"), F.bool_or("twice").alias("again")).where("n > 1 or again").select("seeds")
    seeds = seeds.join(often, "seeds")
    chosen = C.scratch(seeds.groupBy("block").agg(F.collect_list("seeds").alias("seeds")), "chosen")
    total = chosen.agg(F.sum(F.size("seeds")).alias("n"), F.count("*").alias("blocks")).first()
    tasks = max(1, total["blocks"] or 0)
    buckets = max(1, (total["n"] or 0) // BUCKET + 1)
    tasks = min(tasks, 8 * spark.sparkContext.defaultParallelism + tasks // 8)
    runs = chosen.repartition(tasks).mapInArrow(send_runs(folder, buckets), "bucket long, block string, ids binary, shared binary, size binary, bounds binary, bytes binary")
    replies = C.scratch(C.by_group(runs, ["bucket"], merge_bucket, "block string, ids binary, bits binary"), "replies")
    answers = replies.groupBy("block").agg(F.collect_list(F.struct("ids", "bits")).alias("replies"))
    work = blocks.select("block").join(chosen, "block", "left").join(answers, "block", "left").select("block", "seeds", "replies")
    # blocks are work, their rows are small: adaptive coalescing would put them into a few tasks
    return work.repartition(tasks, "block").mapInArrow(finish(folder), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
