"""Embedding near-dedup by product quantisation.

Vectors of unit length are put into the inverted list of their nearest coarse
centroid; their residuals are cut into subspaces and coded.  A label's lists hold
about ``LIST`` vectors each whatever its size: their number is a power of two that
grows with the label up to ``LISTS``.  Centroids and codebooks of each power in use
are fitted on a bounded sample (``SAMPLE`` vectors a list, 4,096 at least, those of
smallest hash); every vector is indexed.

Every vector is a query.  It probes its ``2 log2(lists + 1)`` nearest lists, all of
them up to 4 lists.  A pair is found if either vector probes the other's list, and
counts for both.  In a list, distances come from table look-ups over the codes, and a
vector is a candidate if its coded distance is at most the linking distance
``sqrt(2 - 2 * cosine)`` plus its own coding error: by the triangle inequality the
codes lose nothing.  Candidates are decided by the exact cosine in double precision.
So recall is that of the probes: for pairs at a cosine of exactly 0.93 in uniformly
random directions of 64 dimensions 0.998 in a simulation with 390 lists (tests ask for
0.99 at up to 256 lists), and closer pairs are found more often.

Rows of equal vectors and labels are one entry with a multiplicity.  Lists of a label
are cut into blocks, a task compares one block with one block of queries; counts and
a spanning forest of the links leave it, not the pairs.  Vectors are scaled by powers
of two, which changes no cosine and keeps squares in range.

Scale: a query's vector goes to each list that it probes, so the shuffle is the table
times the probes; work is linear in the table up to ``LIST * LISTS`` vectors a label,
and then grows with the longer lists.  The driver holds the sample and the centroids (at
4,096 lists 131,072 vectors), and distances between them ``DISTANCES`` at a time.

Defined results: vectors that are null, zero or hold null or non-finite parts, and
null labels, link with nothing; vectors of different lengths don't compare; repeated
rows and ids count as other vectors.  A null vec_id takes part but is no component's id
while there is another.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import graph
from .bagminhash import forest

COSINE = 0.93
LIST, LISTS = 256, 4096
SAMPLE = 32
SUBSPACES = 16
CODES = 128
BLOCK = 2048
DISTANCES = 1 << 21  # distances held at a time, 16 MB
CHUNK = 256  # queries that are looked up at a time
NODE = "struct<none: boolean, vec: bigint, row: bigint>"


def slices(rows: int, centroids: int) -> list[slice]:
    """Rows whose distances to all centroids are held at a time."""
    step = max(1, DISTANCES // max(1, centroids))
    return [slice(a, a + step) for a in range(0, rows, step)]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, but for the row's own square."""
    return (c * c).sum(1)[None, :] - 2 * x @ c.T


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    return np.concatenate([distances(x[s], c).argmin(1) for s in slices(len(x), len(c))] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        c[found] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


def fit(x: np.ndarray, lists: int) -> dict:
    """Coarse centroids and a codebook for each subspace of the residuals."""
    coarse = kmeans(x, lists)
    rest = x - coarse[nearest(x, coarse)]
    cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    return {"coarse": coarse, "cuts": cuts, "books": [kmeans(rest[:, s], CODES, 4, 11 + i) for i, s in enumerate(cuts)]}


def probes(lists: int) -> int:
    return min(lists, int(np.ceil(2 * np.log2(lists + 1))))


def encode(u: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """List, codes, least look-up sum of a candidate, and lists to probe (own list first) of each row."""
    parts = [_encode(u[s], model) for s in slices(len(u), len(model["coarse"]))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _encode(u: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    d = distances(u, model["coarse"])
    near = d.argmin(1)
    rest = u - model["coarse"][near]
    codes = np.stack([nearest(rest[:, s], b) for s, b in zip(model["cuts"], model["books"], strict=True)], 1).astype(np.uint8)
    coded = model["coarse"][near] + np.concatenate([b[codes[:, i]] for i, b in enumerate(model["books"])], 1)
    far = np.sqrt(2 - 2 * COSINE) + np.sqrt(((u - coded) ** 2).sum(1))
    # |q - coded|^2 = 1 - 2 q.coded + |coded|^2 is at most far^2
    least = (1 + (coded * coded).sum(1) - far * far) / 2 - 1e-4
    n = probes(len(model["coarse"]))
    d[np.arange(len(u)), near] = -np.inf
    probe = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(n), d.shape)
    return near, codes, least, probe.astype(np.int32)


def candidates(q: np.ndarray, codes: np.ndarray, least: np.ndarray, center: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(member, query) pairs whose look-up sums reach the member's least one."""
    at = np.broadcast_to((q @ center).astype(np.float32), (len(codes), len(q))).copy()
    for m, (s, b) in enumerate(zip(model["cuts"], model["books"], strict=True)):
        at += (b @ q[:, s].T).astype(np.float32)[codes[:, m]]
    return np.nonzero(at >= least[:, None])


def compare(key_list: int, table: pa.Table, model: dict) -> pa.Table:
    """Of one block of a list and one block of its queries: how many vectors each links, and a spanning forest of the links."""
    raw = table.column("v").to_pylist()
    inside = ~np.array(table.column("codes").is_null())
    v = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    norm = np.sqrt((v * v).sum(1))
    member, query = np.flatnonzero(inside), np.flatnonzero(~inside)
    row, times = table.column("row").to_numpy(), table.column("times").to_numpy()
    codes = np.frombuffer(b"".join(table.column("codes").filter(pa.array(inside)).to_pylist()), np.uint8).reshape(len(member), -1)
    probe = np.frombuffer(b"".join(table.column("probe").filter(pa.array(inside)).to_pylist()), np.int32).reshape(len(member), -1)
    least, home = table.column("least").to_numpy()[member], table.column("home").to_numpy()[query]
    names, first, number = np.unique(row, return_index=True, return_inverse=True)
    counts, label, links = np.zeros(len(names), np.int64), np.arange(len(names)), []
    for a in range(0, len(query), CHUNK):
        some = query[a : a + CHUNK]
        mi, qi = candidates(v[some] / norm[some, None], codes, least, model["coarse"][key_list], model)
        if not len(mi):
            continue
        ms, qs = np.unique(mi), np.unique(qi)
        left, right = member[ms], some[qs]
        cosine = (v[left] @ v[right].T) / (norm[left][:, None] * norm[right][None, :])
        x, y = np.nonzero(((cosine >= COSINE) & (row[left][:, None] != row[right][None, :])).T)  # by query
        if not len(x):
            continue
        one, other = right[x], left[y]
        np.add.at(counts, number[one], times[other])
        # a member that doesn't probe the query's list has no other task to find this link in
        alone = ~(probe[ms[y]] == home[a + qs[x]][:, None]).any(1)
        np.add.at(counts, number[other[alone]], times[one[alone]])
        edge = np.flatnonzero(np.diff(x, prepend=-1))
        forest([(number[one[i]], number[other[i:j]]) for i, j in zip(edge, np.append(edge[1:], len(x)), strict=True)], label, links)
    some = np.flatnonzero(counts)
    a = first[np.concatenate((some, np.array([x for x, _ in links], np.int64)))]
    b = first[np.array([y for _, y in links], np.int64)]
    vec = table.column("vec_id").combine_chunks()
    pad = pa.nulls(len(some), pa.int64())
    return pa.table({
        "a_vec": vec.take(pa.array(a)), "a_row": row[a], "b_vec": pa.concat_arrays([pad, vec.take(pa.array(b))]), "b_row": pa.concat_arrays([pad, pa.array(row[b])]),
        "n": np.concatenate((counts[some], np.zeros(len(links), np.int64))),
    })


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest part into [0.5, 1)."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    base = base.withColumn("row", F.monotonically_increasing_id())
    sound = F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("same", F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws("\x1f", "label", F.to_json("v")), 256)).otherwise(F.concat(F.lit("none "), F.col("row").cast("string"))))
    base = C.scratch(base, "vectors")
    order = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("vec"), F.col("row").alias("row")).cast(NODE)
    heads = C.scratch(C.summed(base, ["same"], F.min(order).alias("head"), F.count("*").alias("times")), "heads")
    entry = base.where(~F.col("same").startswith("none ")).join(heads, "same").where(F.col("row") == F.col("head.row"))
    entry = C.scratch(entry.select("row", "vec_id", "label", "v", "times", F.size("v").alias("d")), "entries")
    sizes = entry.groupBy("d").agg(F.count("*").alias("n")).collect()  # a row for each length of vector
    found = [_search(entry.where(F.col("d") == r["d"])) for r in sorted(sizes, key=lambda r: r["d"])]
    if not found:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    hits = found[0]
    for x in found[1:]:
        hits = hits.union(x)
    node = lambda x: F.struct(F.col(f"{x}_vec").isNull().alias("none"), F.col(f"{x}_vec").alias("vec"), F.col(f"{x}_row").alias("row")).cast(NODE)
    hits = C.scratch(hits.select(node("a").alias("a"), F.when(F.col("b_row").isNotNull(), node("b")).alias("b"), "n"), "hits")
    links = hits.groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n"))
    roots = graph.components(hits.where("b is not null").select("a", "b")).withColumnRenamed("node", "head")
    answers = heads.join(links, "head", "left").join(roots, "head", "left")
    answers = answers.select("same", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root.vec", "head.vec").alias("component_id"))
    out = base.select("vec_id", "same").join(C.scratch(answers, "answers"), "same")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _search(entry: DataFrame) -> DataFrame:
    """(a, null, n): links of vector ``a`` in one task, and (a, b, 0): a spanning forest, for vectors of one length."""
    spark = entry.sparkSession
    steps = int(np.log2(LISTS))
    level = F.least(F.greatest(F.round(F.log2(F.col("size") / LIST)), F.lit(0)), F.lit(steps)).cast("int")
    sizes = C.scratch(C.summed(entry, ["label"], F.count("*").alias("size")).select("label", level.alias("level")), "labels")
    used = sorted(r["level"] for r in sizes.select("level").distinct().collect())  # 13 numbers at most
    drawn = entry.select("v", "row").orderBy(F.xxhash64("row"), "row").limit(max(4096, SAMPLE << used[-1])).toArrow()
    x = scaled(drawn.column("v").combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, -1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = spark.sparkContext.broadcast({k: fit(x[: max(4096, SAMPLE << k)], 1 << k) for k in used})

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = scaled(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            levels = batch.column("level").to_numpy()
            home, least = np.zeros(len(v), np.int32), np.zeros(len(v))
            codes, probe, lists = [b""] * len(v), [b""] * len(v), [None] * len(v)
            for k in np.unique(levels):
                at = np.flatnonzero(levels == k)
                home[at], c, least[at], p = encode(u[at], model.value[int(k)])
                for i, x, y in zip(at, c, p, strict=True):
                    codes[i], probe[i], lists[i] = x.tobytes(), y.tobytes(), y
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "vec_id", "label", "level", "times")), pa.array([z.tobytes() for z in v], pa.binary()), pa.array(home), pa.array(codes, pa.binary()), pa.array(least), pa.array(probe, pa.binary()), pa.array(lists, pa.list_(pa.int32()))],
                ["row", "vec_id", "label", "level", "times", "v", "home", "codes", "least", "probe", "lists"],
            )

    coded = entry.join(sizes, "label").select("row", "vec_id", "label", "level", "times", "v")
    coded = C.scratch(coded.mapInArrow(code, "row long, vec_id long, label string, level int, times long, v binary, home int, codes binary, least double, probe binary, lists array<int>"), "codes")
    asked = coded.select("row", "vec_id", "label", "level", "times", "v", "home", F.explode("lists").alias("list"))
    held = coded.groupBy("label", F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    visits = asked.groupBy("label", "list").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    cells = C.scratch(held.join(visits, ["label", "list"]), "cells")
    # block p of a list meets part q of its queries
    mine = coded.withColumn("list", F.col("home")).join(cells, ["label", "list"]).withColumn("p", F.pmod(F.xxhash64("row"), F.col("cuts"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    theirs = asked.join(cells, ["label", "list"]).withColumn("q", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    columns = ["label", "level", "list", "p", "q", "row", "vec_id", "times", "v", "home"]
    mine = mine.select(*columns, "codes", "least", "probe")
    theirs = theirs.select(*columns, F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("binary").alias("probe"))

    def one(key, table: pa.Table) -> pa.Table:
        return compare(key[2].as_py(), table, model.value[key[1].as_py()])

    return C.by_group(mine.union(theirs), ["label", "level", "list", "p", "q"], one, "a_vec long, a_row long, b_vec long, b_row long, n long")


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN roots ON roots.a = v.vec_id LEFT JOIN degrees ON degrees.a = v.vec_id
"""
