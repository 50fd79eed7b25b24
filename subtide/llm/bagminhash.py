"""Near-dedup by BagMinHash: weighted-Jaccard signatures, banding, exact multiset verification.

The elements of a text are its windows of five words, weighted by how often they
occur.  Every element owns Poisson points over (time, weight).  The weight axis is
discretised to integers and halved hierarchically ([0,1), [1,2), [2,4), ...), one
process for each part with the part's width as rate; an element of weight w takes the
points below w, those of its last part by their own place in it.  A signature entry
is the earliest point that fell to it, so two entries are equal with the weighted
Jaccard similarity of their texts as probability.  Elements stop as soon as their
next point comes after the latest entry of the signature.

Rows of equal words are one class before anything else.  Class representatives whose
signatures agree in a band are candidates; candidates are gathered into clusters
(components of stars around each bucket's smallest row), clusters are cut into blocks
of bounded text, and every pair of a cluster meets in exactly one task.  There the
pairs that share a band are compared by their exact multisets, but for those that are
joined already: a group of thousands of near copies is settled by one pass over it.
A task returns a spanning forest of its links.

With ``BANDS`` bands of ``ROWS`` rows a pair at the threshold of 0.8 shares a band but
for 5 in 100,000; pairs that share none still join through a third text.

Defined results: null and empty texts are equal to each other; texts below five words
join their equals only; of repeated rows one stays; the kept row of a class has the
smallest doc_id (null ids last).  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import graph

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
BLOCK_SHINGLES = 600_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(block: C.TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle, by document and hash."""
    at, h = block.windows(SHINGLE)
    owner = block.owner[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(n: int, owner: np.ndarray, h: np.ndarray, count: np.ndarray, size: int = SIZE) -> np.ndarray:
    """``n`` rows of ``size`` times of first points; infinite for texts without elements."""
    sig = np.full(n * size, np.inf)
    doc, seed, rate, low, weight = [owner], [h], [np.ones(len(h))], [np.zeros(len(h))], [count.astype(float)]
    part, width = np.flatnonzero(count > 1), 1
    while len(part):  # the parts [1,2), [2,4), ... that an element's weight reaches into
        doc.append(owner[part])
        seed.append(C.mix64(h[part] + np.uint64(width * int(_GOLD) % (1 << 64))))
        rate.append(np.full(len(part), float(width)))
        low.append(np.full(len(part), float(width)))
        weight.append(count[part].astype(float))
        width *= 2
        part = part[count[part] > width]
    doc, seed, rate, low, weight = (np.concatenate(x) for x in (doc, seed, rate, low, weight))
    time, number = np.zeros(len(doc)), 0
    while len(doc):
        steps = int(np.clip(40_000 // len(doc), 1, 64))
        j = (np.arange(number + 1, number + steps + 1, dtype=np.uint64) * np.uint64(3))[None, :]
        draw = C.mix64(seed[:, None] + j * _GOLD)
        gaps = -np.log(_uniform(draw)) / rate[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        pick = C.mix64(draw + _GOLD)
        entry = doc[:, None] * size + ((pick >> np.uint64(33)) % np.uint64(size)).astype(np.int64)
        place = low[:, None] + np.floor(_uniform(C.mix64(pick + _GOLD)) * rate[:, None])
        inside = place < weight[:, None]
        np.minimum.at(sig, entry[inside], times[inside])
        time, number = times[:, -1], number + steps
        go = time <= sig.reshape(n, size).max(1)[doc]
        doc, seed, rate, low, weight, time = (x[go] for x in (doc, seed, rate, low, weight, time))
    return sig.reshape(n, size)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; times count to single precision."""
    bits = sig.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, bits.shape[:2])
    for r in range(rows):
        key = C.mix64(key ^ bits[:, :, r]) + _GOLD
    return key.astype(np.int64)


def sketch(batches):
    """Adds to the numbered documents what is compared of them; the documents go through as they are."""
    for batch in batches:
        rows = C.texts(batch.column("text"))
        for part in C.blocks(rows):
            block = C.TextBlock(rows[part])
            owner, h, count = bags(block)
            n = len(block.rows)
            keys = band_keys(signatures(n, owner, h, count))
            whole = np.maximum(block.n_words - SHINGLE + 1, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(whole > 0, BANDS, 0)))), pa.int32()), pa.array(keys[whole > 0].ravel()))
            same = pa.array([hashlib.md5(b" ".join(x.split())).digest() for x in block.rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.start, n) for c in ("row", "doc_id")), same, pa.array(whole), bands], ["row", "doc_id", "same", "shingles", "bands"])


def forest(hits: list[tuple[int, np.ndarray]], label: np.ndarray, links: list[tuple[int, int]]) -> None:
    """Join ``i`` with the components of each of its hits; only links that join two components are noted."""
    for i, others in hits:
        others = others[label[others] != label[i]]
        while len(others):
            links.append((i, int(others[0])))
            label[label == label[others[0]]] = label[i]
            others = others[label[others] != label[i]]


def verify(rows: list[bytes], cluster: np.ndarray, side: np.ndarray, bands: np.ndarray, similar: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the links among texts of the same cluster that share a band (and, where both sides are there, are of different ones).

    Each text's counts are laid out over the task's shingle numbers, and the overlaps
    with all longer candidates that can reach the threshold are one gather and one sum.
    """
    owner, h, count, base = [], [], [], 0
    for part in C.blocks(rows):
        o, x, c = bags(C.TextBlock(rows[part]))
        owner.append(o + base)
        h.append(x)
        count.append(c)
        base += part.stop - part.start
    owner, h, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, h, count))
    n = len(rows)
    total = np.bincount(owner, count, n).astype(np.int64)
    _, number = np.unique(h, return_inverse=True)
    start = np.searchsorted(owner, np.arange(n + 1))
    order = np.lexsort((total, cluster))
    order = order[total[order] > 0]
    # buckets: the texts of each band key, in the order of cluster and size
    key = bands[order].ravel()
    text = np.repeat(np.arange(len(order)), bands.shape[1])
    by_key = np.lexsort((text, key))
    key, text = key[by_key], text[by_key]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    place = np.empty(len(text), np.int64)
    place[by_key] = np.arange(len(text))
    stop_of = np.repeat(edge[1:], np.diff(edge))
    place = place.reshape(len(order), -1)
    two = len(np.unique(side)) > 1
    size, laid = np.diff(start), np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    label, links = np.arange(len(order)), []
    for i, mine in enumerate(order):
        # the texts behind this one in its buckets that it isn't joined with
        found = [text[p + 1 : z] for p, z in zip(place[i], stop_of[place[i]], strict=True) if z > p + 1]
        if not found:
            continue
        near = np.concatenate(found)
        near = np.unique(near[label[near] != label[i]])
        their = order[near]
        near = near[(cluster[their] == cluster[mine]) & (total[their] * similar <= total[mine] + 1e-9)]
        if two:
            near = near[side[order[near]] != side[mine]]
        own = slice(start[mine], start[mine + 1])
        laid[number[own]] = count[own]
        for a in range(0, len(near), 64):  # what the first ones join need not be compared any more
            some = near[a : a + 64]
            some = some[label[some] != label[i]] if a else some
            if not len(some):
                continue
            their = order[some]
            stop = np.cumsum(size[their])
            at = np.repeat(start[their] - stop + size[their], size[their]) + np.arange(stop[-1])
            common = np.add.reduceat(np.minimum(laid[number[at]], count[at]), stop - size[their])
            forest([(i, some[common >= similar * (total[mine] + total[their] - common) - 1e-9])], label, links)
        laid[number[own]] = 0
    return [(int(order[a]), int(order[b])) for a, b in links]


def compare(key, table: pa.Table) -> pa.Table:
    rows = C.texts(table.column("text"))
    row = table.column("row").to_numpy()
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    links = verify(rows, table.column("cluster").to_numpy(), table.column("side").to_numpy(), bands)
    a, b = (row[[x[k] for x in links]] if links else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def classes(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``class_id`` (smallest doc_id of the class), ``class_row`` (the row that stays) for the rows of ``docs``.

    ``docs`` has row, doc_id and text and is a written table, so that rows keep their numbers.
    """
    small = C.scratch(docs.mapInArrow(sketch, "row long, doc_id long, same binary, shingles long, bands array<long>"), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("row").alias("row")))
    heads = C.scratch(C.summed(small, ["same"], best.alias("head")), "heads")
    leads = heads.select(F.col("head.row").alias("row")).join(small.select("row", "shingles", "bands"), "row").where("shingles > 0")
    leads = C.scratch(leads, "leads")
    cells = leads.select("row", F.explode("bands").alias("key"))
    full = C.summed(cells, ["key"], F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    near = cells.join(full, "key").where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b"))
    member = graph.components(near).select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    member = C.scratch(member.join(leads, "row"), "members")
    sums = C.summed(member, ["cluster"], F.sum("shingles").alias("all"))
    sums = C.scratch(sums.withColumn("cuts", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int")), "clusters")
    # small clusters share tasks; a large one is cut, and each pair of its cuts is a task
    tasks = max(1, int((sums.agg(F.sum("all")).first()[0] or 0) // BLOCK_SHINGLES) + 1)
    dealt = member.join(sums, "cluster").withColumn("side", F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("row"), F.col("cuts"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    home = F.when(F.col("cuts") > 1, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(tasks)))
    dealt = dealt.select("row", "cluster", "bands", "side", home.alias("home"), F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"))
    # a merge join at every size: Spark prunes the large side by a Bloom filter of the members where that pays
    texts = docs.select("row", "text").hint("merge").join(dealt, "row")
    links = C.by_group(texts, ["home", "p", "q"], compare, "a long, b long")
    joined = graph.components(links)
    lead = heads.select("same", F.col("head.row").alias("lead"), F.col("head").alias("head"))
    lead = C.scratch(lead.join(joined.withColumnRenamed("node", "lead"), "lead", "left").withColumn("root", F.coalesce("root", "lead")), "roots")
    chosen = C.summed(lead, ["root"], F.min("head").alias("chosen"))
    lead = C.scratch(lead.join(chosen, "root").select("same", "chosen"), "chosen")
    return small.select("row", "doc_id", "same").join(lead, "same").select("row", "doc_id", F.col("chosen.doc").alias("class_id"), F.col("chosen.row").alias("class_row"))


def _parts(held: DataFrame) -> DataFrame:
    return held.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept for every row."""
    held = C.numbered(docs.select("doc_id", "text"))
    return classes(_parts(held)).select("doc_id", "class_id", (F.col("row") == F.col("class_row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, all columns as they are."""
    held = C.numbered(docs)
    kept = classes(_parts(held)).where("row = class_row").select("row")
    kept = held.join(kept, "row", "left_semi")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
