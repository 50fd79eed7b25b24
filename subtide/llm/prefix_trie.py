"""A prefix trie of conversations: which beginnings conversations share, and what sharing saves.

Turns of a conversation are in the order of ``turn`` (null first; equal ones by a
digest of role and text).  A node is a distinct sequence of first turns, named by its
depth and two polynomial hashes modulo 2^61 - 1 of the digests of its turns.

1. Numbers and hashes of turns are a prefix scan in two levels: turns are sorted into
   ranges, each range scans its rows, and the sums of the ranges before it are added
   afterwards, so a conversation of any length is dealt over many tasks.
2. The hashes are linear in their beginning, so a conversation that takes its first
   turns from another one is rebuilt by one correction for all its hashes; no text moves.
3. Partial tries: each partition combines its rows into a table of nodes (members,
   smallest member) and of end lists (ids of conversations that end at a node, in pieces
   of at most ``PIECE`` ids, so a node with any number of ends is many bounded rows).
4. Merges: tables of ``FAN`` partitions each are merged by the hash of node and piece,
   until one table is left; members add up, end lists are joined.
5. The rollup goes bottom-up in steps of doubled length: after step k each node has the
   sums of all nodes fewer than 2^k levels below it.  Only nodes of 2^k levels or more
   take part, so the rounds are the logarithm of the greatest depth and most are small.
6. Digests of end lists are streamed over the sorted pieces of a node.

Scale: three shuffles of a thin row for each turn, then of the nodes.  Hot beginnings
are combined before each shuffle; SHA-256 of a node's list is sequential by nature, a
task reads a row for each ``PIECE`` ids.  The rows that are broadcast are two for each
partition of the scan at most.

Defined results: null roles and texts are empty; rows without conv_id belong to no
conversation and are left out; repeated rows are turns of their own; an empty table has
no nodes.  ``borrow`` and ``most`` are those of the query, ``borrow=0`` takes
conversations as they are.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
BORROW, MOST = 20, 4
PRIME = (1 << 61) - 1
BASE = (1_234_567_890_123_456_789 % PRIME, 987_654_321_098_765_432 % PRIME)
PIECE = 1024
FAN = 32
COMBINE = 1 << 18  # rows that a partition combines at a time
KEY = ["depth", "a", "b"]


def _digest(role: Column, text: Column) -> tuple[Column, Column]:
    d = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return tuple(F.conv(F.substring(d, at, 15), 16, 10).cast("long") + 1 for at in (1, 16))


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    x, y = _digest(F.col("role"), F.col("text"))
    return base.select("conv", "turn", x.alias("x"), y.alias("y"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def _scan(batches):
    """Position and prefix hashes of each turn within its range; at the end the sums of the first and the last conversation."""
    p, q = BASE
    part = TaskContext.get().partitionId()
    conv, n, a, b, first = None, 0, 0, 0, None
    names = ["part", "edge", "conv", "pos", "a", "b", "pa", "pb", "x", "y", "words"]
    for batch in batches:
        rows = []
        for c, x, y in zip(*(batch.column(k).to_pylist() for k in ("conv", "x", "y")), strict=True):
            if c != conv:
                if conv is not None and first is None:
                    first = (conv, n, a, b)
                conv, n, a, b = c, 0, 0, 0
            before = (a, b)
            n, a, b = n + 1, (a * p + x) % PRIME, (b * q + y) % PRIME
            rows.append((n, a, b, *before))
        if rows:
            k = len(rows)
            made = [pa.array(v, pa.int64()) for v in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int64()), pa.array([False] * k), batch.column("conv"), *made, batch.column("x"), batch.column("y"), batch.column("words")], names)
    ends = [x for x in (first, conv is not None and (conv, n, a, b)) if x]
    if ends:
        none = pa.nulls(len(ends), pa.int64())
        made = [pa.array(v, pa.int64()) for v in zip(*ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(ends), pa.int64()), pa.array([True] * len(ends)), *made, none, none, none, none, none], names)


def _carry(key, table: pa.Table) -> pa.Table:
    """What lies before each range of one conversation: turns and hashes."""
    n, a, b, out = 0, 0, 0, []
    for part, m, x, y in sorted(zip(*(table.column(c).to_pylist() for c in ("part", "pos", "a", "b")), strict=True)):
        if n:
            out.append((part, key[0].as_py(), n, a, b))
        n, a, b = n + m, (a * pow(BASE[0], m, PRIME) + x) % PRIME, (b * pow(BASE[1], m, PRIME) + y) % PRIME
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.table(dict(zip(("part", "conv", "ahead", "ca", "cb"), (pa.array(v, pa.int64()) for v in columns), strict=True)))


def _shift(batch: pa.RecordBatch, add: tuple[str, str], powers: str, pairs: list[tuple[str, str]], lower: tuple[int, ...]) -> pa.RecordBatch:
    """Adds ``add * BASE ** (powers - lower)`` to the hash columns ``pairs`` where ``add`` isn't zero or null."""
    hot = pc.fill_null(pc.or_kleene(pc.not_equal(batch.column(add[0]), 0), pc.not_equal(batch.column(add[1]), 0)), False)
    at = [i for i, x in enumerate(hot.to_pylist()) if x]
    if not at:
        return batch
    values = {c: batch.column(c).to_pylist() for pair in (*pairs, add) for c in pair}
    power = batch.column(powers).to_pylist()
    for pair, low in zip(pairs, lower, strict=True):
        for c, d, base in zip(pair, add, BASE, strict=True):
            v, w = values[c], values[d]
            for i in at:
                v[i] = (v[i] + w[i] * pow(base, power[i] - low, PRIME)) % PRIME
    changed = {c for pair in pairs for c in pair}
    return pa.RecordBatch.from_arrays([pa.array(values[c], pa.int64()) if c in changed else batch.column(c) for c in batch.schema.names], batch.schema.names)


def _settle(batches):
    for batch in batches:
        if batch.num_rows:
            batch = _shift(batch, ("ca", "cb"), "pos", [("a", "b"), ("pa", "pb")], (0, 1))
            batch = batch.set_column(batch.schema.names.index("pos"), "pos", pc.add(batch.column("pos"), pc.fill_null(batch.column("ahead"), 0)))
        yield batch.select(["conv", "pos", "a", "b", "pa", "pb", "x", "y", "words"])


def positions(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), prefix hashes a, b at the turn and pa, pb before it, digest x, y, words of every turn."""
    turns = C.scratch(_turns(conversations), "turns")
    order = ["conv", F.col("turn").asc_nulls_first(), "x", "y"]
    scanned = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "x", "y", "words")
    scanned = C.scratch(scanned.mapInArrow(_scan, "part long, edge boolean, conv long, pos long, a long, b long, pa long, pb long, x long, y long, words long"), "scanned")
    ahead = C.by_group(scanned.where("edge").select("conv", "part", "pos", "a", "b"), ["conv"], _carry, "part long, conv long, ahead long, ca long, cb long")
    ahead = C.scratch(ahead, "ahead")
    # two rows for each partition of the scan at most
    held = scanned.where("not edge").drop("edge").join(F.broadcast(ahead), ["part", "conv"], "left")
    return C.scratch(held.mapInArrow(_settle, "conv long, pos long, a long, b long, pa long, pb long, x long, y long, words long"), "positions")


def memberships(turns: DataFrame, borrow: int = BORROW, most: int = MOST) -> DataFrame:
    """A row for each node of each (rebuilt) conversation; hashes lack the correction ``da, db`` times the base to ``power``."""
    first = F.when(F.col("pos") < most, F.struct("pos", "a", "b", "x", "y", "words"))
    heads = turns.groupBy("conv").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(first)).alias("first"))
    heads = C.scratch(heads, "heads")
    cut = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int") if borrow else F.lit(0)
    plan = heads.withColumn("cut", cut).withColumn("from", F.col("conv") - F.col("conv") % borrow if borrow else F.col("conv"))
    donors = heads.where(F.col("conv") % borrow == 0 if borrow else F.lit(False)).select(F.col("conv").alias("from"), F.col("first").alias("lent"))
    plan = plan.join(donors, "from", "left").withColumn("lent", F.expr("case when cut > 0 and lent is not null then slice(lent, 1, cut) else slice(first, 1, 0) end"))
    plan = plan.withColumn("k", F.size("lent"))

    def at(list_: str, index: str, field: str) -> Column:
        return F.expr(f"coalesce(try_element_at({list_}, {index}).{field}, 0L)")

    gap = lambda f: F.expr(f"pmod({at_lent(f)} - {at_own(f)}, {PRIME}L)")
    at_lent = lambda f: f"coalesce(case when k > 0 then try_element_at(lent, k).{f} end, 0L)"
    at_own = lambda f: f"coalesce(case when cut > 0 then try_element_at(first, cut).{f} end, 0L)"
    plan = C.scratch(plan.select("conv", "n", "cut", "k", "lent", gap("a").alias("da"), gap("b").alias("db")), "plan")

    names = ["conv", "depth", "a", "b", "pa", "pb", "x", "y", "words", "da", "db", "power", "ended"]
    zero = F.lit(0).cast("long")
    own = turns.join(plan.drop("lent"), "conv").where("pos > cut").select(
        "conv", (F.col("pos") - F.col("cut") + F.col("k")).alias("depth"), "a", "b", "pa", "pb", "x", "y", "words", "da", "db", (F.col("pos") - F.col("cut")).alias("power"), (F.col("pos") == F.col("n")).alias("ended"))
    taken = plan.where("k > 0").select("conv", "n", "cut", "k", "lent", F.posexplode("lent").alias("i", "t")).select(
        "conv", (F.col("i") + 1).cast("long").alias("depth"), "t.a", "t.b", at("lent", "if(i = 0, null, i)", "a").alias("pa"), at("lent", "if(i = 0, null, i)", "b").alias("pb"), "t.x", "t.y", "t.words",
        zero.alias("da"), zero.alias("db"), zero.alias("power"), F.expr("i + 1 = k and n <= cut").alias("ended"))
    root = plan.select("conv", *[zero.alias(c) for c in names[1:12]], F.expr("k = 0 and n <= cut").alias("ended"))
    return own.select(names).union(taken.select(names)).union(root.select(names))


TRIE = "part long, depth long, a long, b long, pa long, pb long, x long, y long, words long, low long, n long, piece long, ids array<long>"


def _partial(batches):
    """One partition's trie: nodes with their members, and pieces of end lists."""
    part = TaskContext.get().partitionId()
    held: list[pa.Table] = []
    facts = ["pa", "pb", "x", "y", "words"]

    def combine(rows: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(rows)
        out = t.group_by(KEY).aggregate([*((c, "min") for c in facts), ("low", "min"), ("n", "sum")])
        return out.rename_columns({**{f"{c}_min": c for c in (*facts, "low")}, "n_sum": "n"}).select([*KEY, *facts, "low", "n"])

    def nodes(t: pa.Table) -> list[pa.RecordBatch]:
        t = pa.table([pa.array([part] * len(t), pa.int64()), *t.columns, pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.list_(pa.int64()))], names=["part", *KEY, *facts, "low", "n", "piece", "ids"])
        return t.to_batches(10_000)

    def ends(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.append_column("piece", pc.shift_right(t.column("conv"), pa.scalar(PIECE.bit_length() - 1, pa.int64())))
        t = t.group_by([*KEY, "piece"]).aggregate([("conv", "list")])
        none = [pa.nulls(len(t), pa.int64())] * 7
        t = pa.table([pa.array([part] * len(t), pa.int64()), *(t.column(c) for c in KEY), *none, t.column("piece"), t.column("conv_list")], names=["part", *KEY, *facts, "low", "n", "piece", "ids"])
        return t.to_batches(10_000)

    over, size, waiting = [], 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([_shift(batch, ("da", "db"), "power", [("a", "b"), ("pa", "pb")], (0, 1))])
        over.append(t.filter(t.column("ended")).select([*KEY, "conv"]))
        t = t.rename_columns(["low" if c == "conv" else c for c in t.schema.names])
        waiting.append(t.append_column("n", pa.array([1] * len(t), pa.int64())).select([*KEY, *facts, "low", "n"]))
        size += len(t)
        if size >= COMBINE:
            held, waiting, size = [combine([*held, *waiting])], [], 0
            yield from ends(pa.concat_tables(over))
            over = []
            if len(held[0]) > 2 * COMBINE:  # merges take what comes twice
                yield from nodes(held[0])
                held = []
    if held or waiting:
        yield from nodes(combine([*held, *waiting]))
    if over:
        yield from ends(pa.concat_tables(over))


def _merge(tries: DataFrame) -> DataFrame:
    """The tables of ``FAN`` parts each made one."""
    facts = [F.min(c).alias(c) for c in ("pa", "pb", "x", "y", "words", "low")]
    merged = tries.groupBy(*KEY, "piece", F.expr(f"part div {FAN}").alias("part")).agg(*facts, F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"))
    return merged.select(*[x.split()[0] for x in TRIE.split(", ")])


def _sha256(batches):
    """Digest of each node's end list, over pieces that come in order, a node's pieces one after another."""
    key, hash_ = None, None
    names, types = [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
    for batch in batches:
        out = []
        for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            text = ",".join(map(str, sorted(ids))).encode()
            if k == key:
                hash_.update(b"," + text)
            else:
                if key:
                    out.append((*key, hash_.hexdigest()))
                key, hash_ = k, hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, hash_.hexdigest()), types, strict=True)], names)


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children, and n_leaves and saved_tokens summed over subtrees."""
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    base = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    base = C.scratch(base.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("words")), "base")
    deepest = base.agg(F.max("depth")).first()[0] or 0
    live = base.where("depth > 0").select(*KEY, F.col("pa").alias("ja"), F.col("pb").alias("jb"), "leaves", "saved")
    step, lifted = 1, None
    while step <= deepest:
        up = live.groupBy((F.col("depth") - step).alias("depth"), F.col("ja").alias("a"), F.col("jb").alias("b")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = C.scratch(up, "lifted")
        lifted = up if lifted is None else lifted.union(up)
        if 2 * step <= deepest:
            far = live.select((F.col("depth") + step).alias("depth"), F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("na"), F.col("jb").alias("nb"))
            live = live.where(F.col("depth") >= 2 * step).join(up, KEY, "left").join(far, ["depth", "ja", "jb"])
            live = live.select(*KEY, F.col("na").alias("ja"), F.col("nb").alias("jb"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
            live = C.scratch(live, "live")
        step *= 2
    if lifted is None:
        return base.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    more = lifted.groupBy(*KEY).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    total = lambda c, name: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(name)
    return base.join(more, KEY, "left").select(*nodes.columns, "n_children", total("leaves", "n_leaves"), total("saved", "saved_tokens"))


def trie(conversations: DataFrame, borrow: int = BORROW, most: int = MOST) -> DataFrame:
    """Every node: depth, a, b (its name), pa, pb (its parent's), x, y (digest of its last turn), words, low (smallest member), n, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = C.scratch(memberships(positions(conversations), borrow, most).mapInArrow(_partial, TRIE), "partial")
    last = parts.agg(F.max("part")).first()[0] or 0
    merged = _merge(parts)
    while (last := last // FAN) > 0:
        merged = _merge(merged)
    merged = C.scratch(merged, "trie")
    nodes = merged.where("piece is null").drop("part", "piece", "ids")
    ends = merged.where("piece is not null").select(*KEY, "piece", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    ends = ends.mapInArrow(_sha256, "depth long, a long, b long, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return _rolled_up(nodes).join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``trie``'s nodes with role and text of their last turn (null at the root)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x, y = _digest(role, text)
    turns = conversations.select(x.alias("x"), y.alias("y"), role.alias("role"), text.alias("text")).groupBy("x", "y").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(turns, ["x", "y"], "left")


def shared_beginnings(conversations: DataFrame, borrow: int = BORROW, most: int = MOST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    nodes = C.scratch(trie(conversations, borrow, most), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("low").alias("parent_conv_id"))
    out = nodes.join(above, ["depth", "pa", "pb"], "left")
    return out.select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS r, coalesce("text", '') AS x FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY p) AS l FROM t GROUP BY c),
bits AS (SELECT c, 4294967295::BIGINT AS s, 0 AS i FROM v
  UNION ALL SELECT c, list_reduce([CASE WHEN i % 8 = 0 THEN xor(s, ascii(substr(c::VARCHAR, i // 8 + 1, 1))::BIGINT) ELSE s END, 0], lambda u, _: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END), i + 1
  FROM bits WHERE i < 8 * length(c::VARCHAR)),
h AS (SELECT c, xor(s, 4294967295) % {MOST} AS h FROM bits WHERE i = 8 * length(c::VARCHAR)),
b AS (SELECT v.c, list_concat(coalesce(d.l[1:h], []), v.l[h + 1:]) AS l FROM v JOIN h USING (c) LEFT JOIN v d ON d.c = v.c - v.c % {BORROW}),
m AS (SELECT c, unnest(range(len(l) + 1)) AS d, l FROM b),
k AS (SELECT c, d, md5(to_json(l[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(l[1:d - 1])::VARCHAR) END AS up, d = len(l) AS ended,
  CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].x, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM m),
n AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '') AS ends FROM k GROUP BY d, k),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, k)),
a AS (SELECT d, k, d AS at, k AS top FROM f UNION ALL SELECT a.d, a.k, f.d - 1, f.up FROM a JOIN f ON f.d = a.at AND f.k = a.top WHERE f.d > 0),
s AS (SELECT a.at AS d, a.top AS k, count(*) FILTER (WHERE f.kids = 0) AS leaves, sum((f.n - 1) * f.words) AS saved FROM a JOIN f ON f.d = a.d AND f.k = a.k GROUP BY ALL)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (d, k) LEFT JOIN f p ON p.d = f.d - 1 AND p.k = f.up
"""
