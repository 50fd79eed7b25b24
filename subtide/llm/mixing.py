"""Mixing sources to target weights, in DataFrame expressions alone.

Tokens (words) of a source form one stream, its documents in a fixed order; the
stream is cut into blocks of a fixed length.  The mix has as many slots as blocks are
wanted, dealt to output shards.  A pseudorandom permutation of all slots draws the
source of each: a shard's source counts are multinomial draws given their totals over
all shards, which are the targets in blocks, so no source misses its target by chance
and none is drawn beyond two passes.  The k-th slot of a source takes block
``perm(k mod n)``, where perm is a keyed pseudorandom permutation of the source's n
block indexes, another one for each pass.  Slots and blocks meet in an equi-join by
(source, index).

Reruns agree on any cluster: documents are ordered by a hash of their content, so file
splits and cores change nothing.

Scale: prefix sums over documents go by (source, bucket) and then over buckets, whose
number grows with the rows, so no task gets a whole source; slots and blocks are spread by index; only the table of
sources (a row for each source, bounded by their number) is gathered by one task.

Defined results: a null text has size 0; a null source is a source of its own and
comes last; repeated rows are documents of their own; sources without a word take
nothing; a source's slots are two passes at most, so no word is taken more than twice.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
LEAST_BLOCKS = 512
SHARD = 8192
CELL = 1 << 16  # slots of a cell, and rows of a bucket, at most (on average)
CELLS = 4096  # cells and buckets of small inputs, so that they are spread as well
WALKS = 16


def _hash(*parts) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts])


def permute(k: Column, n: Column, key: Column) -> Column:
    """Position of ``k`` in a permutation of 0..n-1 that depends on ``key``.

    Two rounds of a Feistel scheme over a grid of a x b >= n cells; results of n or
    more are walked on along the cycle.  The grid has fewer than a = ceil(sqrt n)
    cells to spare, so small n leave within a - 1 < WALKS steps and for large n a walk
    of k steps has a chance of n ** (-k / 2).
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(x: Column) -> Column:
        u, v = F.pmod(x, a), F.floor(x / a).cast("long")
        u = F.pmod(u + F.pmod(_hash(key, v, 1), a), a)
        v = F.pmod(v + F.pmod(_hash(key, u, 2), b), b)
        u = F.pmod(u + F.pmod(_hash(key, v, 3), a), a)
        return u + v * a

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.lit(-1).cast("long"), lambda x, _: F.when(x < 0, step(k)).when(x < n, x).otherwise(step(x)))
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(walk)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Each source's target: ``share`` of all words by weight, stopped at ``most`` times the source, the excess reshared.

    With caps c and weights w, the stopped sources are those of smallest c / w; the
    others get w times one level.  Running sums over the sources in that order find it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("at", F.col("cap") / F.col("w"))
    rising, everything = Window.orderBy("at", F.col("source").isNull(), "source"), Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", level)
    # levels fall once no cap is met any more; the first of them in this order is the one that holds
    t = t.withColumn("free", F.first(F.when(F.col("at") > F.col("level"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", "w", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("free"))).alias("target"))


def sized(docs: DataFrame, row: Column | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, size, row, key, bucket of every document, written once.

    ``row`` (by this scan unless it is given) only names a row within this run.  Order and
    buckets come from the content: rows that differ have other keys, and for equal rows
    it doesn't matter which of them comes first.
    """
    doc, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    content = [x for c in (doc, source, text) for x in (c.isNull(), c)]
    base = docs.select(
        doc.alias("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"), F.array(_hash(seed, *content), _hash(seed + 1, *content)).alias("key"),
    )
    base = C.scratch(base, "sizes")
    buckets = max(CELLS, -(-base.count() // CELL))
    return base.withColumn("bucket", F.pmod(F.element_at("key", 1), F.lit(buckets)))


def planned(base: DataFrame, share: float, most: float, weights: tuple[float, ...], block: int) -> DataFrame:
    """Each source's target, block length, number of blocks and range [lo, hi) among all slots."""
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    # blocks of `block` words, or shorter where the source is small; the last one of a source can be short
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    plan = plan.withColumn("length", length).withColumn("blocks", F.expr("(source_size + length - 1) div length"))
    wanted = F.round(F.col("target") / F.col("source_size") * F.col("blocks"))
    plan = plan.withColumn("wanted", F.when(F.col("source_size") > 0, F.least(wanted, F.floor(most * F.col("blocks")))).otherwise(0).cast("long"))
    line = Window.orderBy(F.col("source").isNull(), "source")
    plan = plan.withColumn("hi", F.sum("wanted").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("wanted"))
    return C.scratch(plan, "plan")


def slots(plan: DataFrame, seed: int = 17) -> DataFrame:
    """(shard, source, index): the block that each slot of each output shard takes."""
    total = int(plan.agg(F.max("hi")).first()[0] or 0)
    wide = min(CELL, max(1, -(-total // CELLS)))
    cells = plan.where("wanted > 0").select("source", "blocks", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"(hi - 1) div {wide}"))).alias("cell"))
    drawn = plan.sparkSession.range(total).select(F.expr(f"id div {SHARD}").alias("shard"), permute(F.col("id"), F.lit(total).cast("long"), _hash(seed, 7)).alias("at"))
    drawn = drawn.withColumn("cell", F.expr(f"at div {wide}")).join(cells, "cell").where("at >= lo and at < hi")
    drawn = drawn.select("shard", "source", "blocks", (F.col("at") - F.col("lo")).alias("k"))
    return drawn.select("shard", "source", permute(F.pmod("k", "blocks"), F.col("blocks"), _hash(F.col("source"), F.expr("k div blocks"), seed)).alias("index"))


def draw(base: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, size, source_size, target, row) and the pieces of them that are taken (row, from, words, times), from ``sized`` ones."""
    plan = planned(base, share, most, weights, block)
    parts = base.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    b, p = base.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))), parts
    b = b.join(p, same(b, p) & (b["bucket"] == p["bucket"])).select("doc_id", b["source"], "size", "row", (F.col("before") + F.col("ahead")).alias("start"))
    # a document's pieces: the blocks it reaches into, and how many of its words are in each
    s = plan.select(F.col("source").alias("of"), "source_size", "target", "length")
    d = b.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    reached = F.sequence(F.expr("start div length"), F.expr("(start + size - 1) div length"))
    pieces = d.where("size > 0").select("row", "source", "start", "size", "length", F.explode(reached).alias("index"))
    words = F.least((F.col("index") + 1) * F.col("length"), F.col("start") + F.col("size")) - F.greatest(F.col("index") * F.col("length"), F.col("start"))
    since = F.greatest(F.col("index") * F.col("length") - F.col("start"), F.lit(0))
    pieces = pieces.select("row", "source", "index", since.alias("from"), words.alias("words"))

    taken = slots(plan, seed).groupBy("source", "index").agg(F.count("*").alias("times"))
    got = pieces.alias("p").join(taken.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.index") == F.col("t.index")))
    return d.select("doc_id", "size", "source_size", "target", "row"), got.select("row", "from", "words", "times")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    d, got = draw(sized(docs), **options)
    taken = got.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return d.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each document and pass, its text the words that were drawn.

    Words keep the white space that follows them; ``n_chars``, if there, is counted anew.
    """
    held = C.numbered(docs)
    _, got = draw(sized(held.select("doc.doc_id", "doc.source", "doc.text", "row"), F.col("row")), **options)
    runs = got.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "words", "times"))).alias("runs"))
    out = held.join(runs, "row").select("doc", "runs", F.regexp_extract_all(F.col("doc.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)).alias("list"), F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))
    chosen = F.filter("runs", lambda x: x["times"] >= F.col("turn"))
    slices = F.transform(chosen, lambda x: F.slice("list", (x["from"] + 1).cast("int"), x["words"].cast("int")))
    out = out.where(F.size(chosen) > 0).select("doc", F.array_join(F.flatten(slices), "").alias("mixed"))
    columns = {"text": F.col("mixed"), "n_chars": F.length("mixed")}
    return out.select(*[columns.get(f.name, F.col("doc").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema])
