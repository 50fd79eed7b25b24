"""Each training-data operator against brute force, round trips or held-out rows, and on odd inputs."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subtide.llm import bagminhash, common, graph, gru_lm, line_dedup, mixing, packing, pq_dedup, quality_qda, quality_rules, substring_dedup, warc

ODD = [
    (9001, None, "a", "x"), (9002, "", "a", "x"), (9003, "   \n\t ", None, "x"), (9004, "short text", "a", "x"), (9004, "short text", "a", "x"), (None, "no id here", "b", "x"),
    (9005, "ß é 好 " * 30, "b", "x"), (9006, "word " * 3000, "b", "x"), (9007, "x" * 5000, "a", "x"), (9008, "the same line\nthe same line\nanother", "a", "x"),
]


def odd(spark, rows=None):
    """doc_id, text, source and columns whose names operators might use themselves."""
    df = spark.createDataFrame(ODD if rows is None else rows, "doc_id long, text string, source string, row string")
    return df.withColumn("size", F.lit(1)).withColumn("bucket", F.lit("b")).withColumn("kept", F.lit(None).cast("string"))


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and", "to"]) + rng.choice(["", "s", "ed", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Writes frames to files, as operators read tables from files."""

    def store(df):
        path = str(tmp_path_factory.mktemp("t") / "t.parquet")
        df.write.parquet(path)
        return spark.read.parquet(path)

    common.ship(spark)
    return store


@pytest.fixture(scope="module")
def docs(spark, stored):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(20, 300)), f"s{i % 5}", "r") for i in range(200)]
    rows += [(200 + i, rows[i][1], "s0", "r") for i in range(10)]  # exact copies
    for i in range(20):  # near copies
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((300 + i, " ".join(w), "s1", "r"))
    passage = prose(rng, 60)
    rows += [(400 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "s2", "r") for i in range(15)]
    junk = [(500 + i, " ".join(x.upper() + "!!" for x in prose(rng, 80).split()), "s3", "r") for i in range(60)]
    return stored(odd(spark, rows + junk))


@pytest.fixture(scope="module")
def labels(spark, docs):
    return docs.select("doc_id", (F.col("doc_id") < 500).cast("int").alias("quality"), F.lit(0).alias("toxic")).where("doc_id < 180 or doc_id >= 500")


# --- 1 and 8: quality ---------------------------------------------------------------------


def test_discriminant_on_held_out_rows(docs, labels):
    got = quality_qda.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out & ((got.doc_id < 180) | (got.doc_id >= 500))]
    assert (held.predicted == (held.doc_id < 500)).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(0)
    x = {c: rng.normal(c, 1 + c, (400, quality_qda.N_STATS)) for c in (0, 1)}
    m = quality_qda.solve({c: quality_qda.moments(x[c]) for c in (0, 1)}, shrink=0, pooled=0, ridge=0)
    z = x[1][:5]
    log = []
    for c in (0, 1):
        s = np.cov(x[c].T, bias=True)
        d = z - x[c].mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-np.clip((log[1] - log[0]) * 4 / quality_qda.N_STATS, -40, 40)))
    assert np.allclose(quality_qda.scores(z, m), want)


def test_quality_odd_inputs(spark, stored, labels):
    d = stored(odd(spark))
    assert quality_qda.classify(d, labels.limit(0)).where("score = 0.5").count() == len(ODD)
    assert quality_qda.classify(d.limit(0), labels).count() == 0
    got = quality_rules.rules(d, quality_rules.train(d, labels.limit(0))).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id == 9001].base_failed.all()
    assert quality_rules.keep(d, None).columns == d.columns
    assert quality_rules.rules(d.limit(0), None).count() == 0


def brute_rules(text):
    words = (text or "").encode().split()
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").encode().split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_base_rules(spark, stored, docs):
    texts = [r["text"] for r in docs.limit(60).collect()] + [r[1] for r in ODD] + ["a b c a b c", "a|b #\n\na|b #\n x", "好 好 好 好 好 好"]
    got = quality_rules.judge([(t or "").encode() for t in texts], None)
    want = [brute_rules(t) for t in texts]
    for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")):
        assert list(got[name]) == [w[k] for w in want], name


def test_ngram_classifier(docs, labels):
    model = quality_rules.train(docs, labels, max_labelled=160)
    got = quality_rules.rules(docs, model).toPandas()
    long = got[~got.base_failed]
    assert (long.kept == (long.doc_id < 500)).mean() > 0.97


# --- 2: substrings ------------------------------------------------------------------------


def brute_substrings(texts, width=200):
    c = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if c[t[i : i + width]] > 1:
                m[i : i + width] = True
        spans = int(np.count_nonzero(m[1:] & ~m[:-1])) + int(len(m) > 0 and m[0])
        out.append((len(t), int(m.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1 << 12, 4 << 20])
def test_substrings(spark, stored, docs, monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK_BYTES", block)
    rng = random.Random(3)
    base = prose(rng, 200)
    more = [(600 + i, base[rng.randint(0, 300) :][: rng.randint(150, 700)] + prose(rng, 9), "s", "r") for i in range(40)]
    d = stored(docs.select("doc_id", "text").union(odd(spark).select("doc_id", "text")).union(odd(spark, more).select("doc_id", "text")))
    rows = d.collect()
    got = sorted(tuple(r) for r in substring_dedup.dedup(d).na.fill(-1, ["doc_id"]).collect())
    want = brute_substrings([(r["text"] or "").encode() for r in rows])
    assert got == sorted((-1 if r["doc_id"] is None else r["doc_id"], *w) for r, w in zip(rows, want, strict=True))
    assert substring_dedup.dedup(d.limit(0)).count() == 0


def test_loser_tree_merges_without_known_prefixes():
    rng = random.Random(5)
    for _ in range(50):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        origin, prefix = substring_dedup.merge([substring_dedup.front_code(r) for r in runs])
        at, got = [0] * len(runs), []
        for r in origin:
            got.append(runs[r][at[r]])
            at[r] += 1
        assert got == sorted(x for r in runs for x in r)
        assert all(p == substring_dedup.common_prefix(a, b) for a, b, p in zip(got, got[1:], prefix[1:], strict=False))


# --- 3: mixing ----------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark, stored, docs):
    d = stored(docs.union(odd(spark)))
    got, again = mixing.mix(d).toPandas(), mixing.mix(d).toPandas()
    assert sorted(got.taken) == sorted(again.taken) and len(got) == d.count()
    sizes = Counter()
    for r in d.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    want = brute_targets(sizes)
    m = got.merge(d.toPandas()[["doc_id", "source"]].drop_duplicates("doc_id"), on="doc_id")
    for s, g in m.groupby("source", dropna=False):
        s = None if s != s else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        if sizes[s] > 2000:
            assert g.taken.sum() == pytest.approx(want[s], rel=0.05)
    assert (got.taken <= 2 * got["size"]).all() and mixing.mix(d.limit(0)).count() == 0


def test_mix_is_the_same_over_other_file_splits_and_cores(spark, stored, docs):
    d = docs.union(odd(spark))
    a, b = str(stored(d.repartition(9)).inputFiles()[0]).rsplit("/", 1)[0], str(stored(d.orderBy(F.desc("text")).coalesce(1)).inputFiles()[0]).rsplit("/", 1)[0]
    seen = []
    for path, size, parts in ((a, "128m", "4"), (a, "4k", "13"), (b, "20k", "1")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = mixing.mix(spark.read.parquet(path))
        assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
        seen.append(sorted(map(repr, got.collect())))
        seen[-1] += sorted(map(repr, mixing.mixed(spark.read.parquet(path), block=64).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]


def test_mixed_documents_hold_the_words_that_were_taken(docs):
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=64).collect()}
    out = defaultdict(int)
    for r in mixing.mixed(docs, block=64).collect():
        out[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in got.items() if v} == dict(out) and mixing.mixed(docs).columns == docs.columns


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000, 1001):
        d = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        assert sorted(r["p"] for r in d.collect()) == list(range(n))


# --- 4: lines -----------------------------------------------------------------------------


def test_lines(spark, stored):
    rows = [(i, f"menu\nunique {i}\n\nfooter {i % 2}", f"h{i % 2}" if i < 20 else "rare", "r") for i in range(22)]
    rows += [(50, None, "h0", "r"), (51, "", None, "r")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_documents(stored(odd(spark, rows))).collect()}
    assert got[0] == "unique 0\n" and got[21] == rows[21][1] and got[50] is None and got[51] == ""
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"<p>menu</p><div>own {i}</div><script>x</script>") for i in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    out = {r["page_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_pages(pages).collect()}
    assert out[0] == (2, 1, "own 0") and out[9][:2] == (0, 0) and line_dedup.dedup_pages(pages.limit(0)).count() == 0


# --- 5: packing ---------------------------------------------------------------------------


def test_packing(spark, stored, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    d = stored(docs.union(odd(spark)).withColumn("text", F.when(F.col("doc_id") == 9003, F.lit(" a  b \n c d<|endoftext|> e ")).otherwise(F.col("text"))))
    got = packing.pack(d, shard=64).toPandas()
    ids = [np.array(own.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for r in d.collect()]
    want = Counter((len(x), zlib.crc32(x.tobytes())) for x in ids)
    have = Counter()
    for _, g in got.groupby("row"):
        g = g.sort_values("start")
        assert (g.start == g.length.cumsum() - g.length).all() and g.length.sum() == g.doc_tokens.iloc[0]
        crc = packing.join_crcs([np.array([c], np.uint32) for c in g.ids_crc32[:1]], g.length[:1].to_numpy())
        have[(int(g.length.sum()), int(crc[0]) if len(g) == 1 else None)] += 1
    assert Counter(n for n, _ in want.elements()) == Counter(n for n, _ in have.elements())
    for (n, crc), k in have.items():
        assert crc is None or want[(n, crc)] >= k
    by_doc = {r["doc_id"]: x for r, x in zip(d.collect(), ids, strict=True)}
    for r in got[got.doc_id.isin([i for i in by_doc if i is not None and i != 9004])].itertuples():
        assert zlib.crc32(by_doc[int(r.doc_id)][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert packing.pack(d.limit(0)).count() == 0


def test_ids_are_those_of_the_tokenizer_file(spark, sf_dir):
    """The ranks file against the tokenizer file, over whole texts of a table and odd strings; terms are words."""
    rng = random.Random(2)
    mine, own = packing.Tokens(), packing.load_encoder("byte_bpe_50k.json")[0]
    some = ["".join(rng.choice(["a", "Wort", " ", "  ", "\n", "\t", " ", "’s", "!", "好", "é", "12", " \n", "<|endoftext|>"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + some
    for x, y in zip(mine.batch(texts), own(texts), strict=True):
        assert x.tolist() == y + [1]
    owner, term, count = mine.terms(mine.batch(["a zorbulated apples, apples; zorbulated! ( apples", "a apples zorbulated", "", "!?"]))
    assert owner.tolist() == [0, 0, 0, 1, 1, 1] and sorted(count[:3].tolist()) == [1, 2, 3] and set(term[:3]) == set(term[3:])


def test_related_documents_share_a_shard_wherever_they_lie(spark, stored):
    rng = random.Random(4)
    words = lambda topic: " ".join([f"t{topic}x{rng.randrange(30)}" for _ in range(40)] + [f"common{rng.randrange(50)}" for _ in range(40)])
    rows = [(i, words(i % 40), "a", "x") for i in range(640)]
    got = packing.pack(stored(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")), shard=64).toPandas()
    assert len(got.doc_id.unique()) == 640
    again = packing.pack(stored(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")), shard=64).toPandas()
    columns = ["sequence_id", "offset", "doc_id", "start", "length"]
    assert (again.sort_values(columns)[columns].to_numpy() == got.sort_values(columns)[columns].to_numpy()).all()
    shard = (got.sequence_id // 2**32).groupby(got.doc_id).first()
    assert shard.nunique() >= 8 and shard.value_counts().max() <= 3 * 64
    together = [shard[i] == shard[j] for i in range(640) for j in range(i + 40, 640, 40)]
    assert np.mean(together) > 0.5  # a tenth by chance


def test_scores_are_bm25():
    rng = random.Random(3)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] for _ in range(30)] + [[]]
    df = Counter(w for t in texts for w in set(t))
    n, mean = len(texts), np.mean([len(t) for t in texts])
    idf = {w: math.log1p((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    term = lambda w: zlib.crc32(w.encode())
    table = np.zeros(1 << packing.DF_BITS)
    for w in df:
        table[packing.bucket(np.array([term(w)], np.uint32))] = idf[w]
    bags = [np.unique([term(w) for w in t], return_counts=True) if t else (np.zeros(0), np.zeros(0)) for t in texts]
    index = packing.Index([a.astype(np.uint32) for a, _ in bags], [c.astype(np.uint16) for _, c in bags], table, mean)
    for q in texts:
        want = [sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(q) if w in t) for t in texts]
        assert index.asked(index.known(np.array(sorted(term(w) for w in set(q)), np.uint32))[1]) == pytest.approx(want)


def test_neighbours_fill_the_seeds_window():
    terms = [np.array(x, np.uint32) for x in ([1, 2, 3], [4, 5], [1, 2, 9], [7, 8])]
    index = packing.Index(terms, [np.ones(len(t), np.uint16) for t in terms], np.ones(1 << packing.DF_BITS), 2.5)
    windows = packing.fill(np.array([1500, 600, 500, 5000]), terms, index)
    assert sum(k for w in windows for _, _, k in w) == 7600 and max(sum(k for _, _, k in w) for w in windows) <= 2048
    seeded = [[i for i, _, _ in w] for w in windows if len(w) > 1 and w[0][0] == 0]
    assert seeded and seeded[0][1] == 2  # the neighbour with words in common comes first


def test_texts_and_seeds_are_worked_on_together(monkeypatch):
    """Checksums of all units at once, and scores for many seeds at once, each the same as alone."""
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 50000, n).astype(np.uint16) for n in (1, 15, 16, 17, 31, 32, 33, 500)]
    for x, crcs in zip(ids, packing.unit_crcs(ids), strict=True):
        raw = x.astype("<u4").tobytes()
        assert crcs.tolist() == [zlib.crc32(raw[i : i + 4 * packing.UNIT]) for i in range(0, len(raw), 4 * packing.UNIT)]
    terms = [np.unique(rng.zipf(1.3, 80) % 3000).astype(np.uint32) << np.uint32(18) for _ in range(500)]
    index = packing.Index(terms, [rng.integers(1, 9, len(t)).astype(np.uint16) for t in terms], np.linspace(0.1, 3, 1 << packing.DF_BITS), 80.0)
    numbers = index.numbers(terms)
    assert len(index.rows) and (index.asked_all(numbers) == np.stack([index.asked(x) for x in numbers])).all()
    calls, asked = [], packing.Index.asked_all
    monkeypatch.setattr(packing.Index, "asked_all", lambda self, some: calls.append(len(some)) or asked(self, some))
    packing.fill(rng.integers(600, 2040, 500), terms, index)
    assert 300 < sum(calls) <= 500 and len(calls) <= 12


# --- 6: archives --------------------------------------------------------------------------


def test_archives(spark, stored):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} " + "é" * (i % 5)) for i in range(40)] + [(50, None, None), (51, "u", ""), (3, "http://again", "<p>3 ééé"), (None, "n", "<p>0 ")]
    d = stored(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash")))
    got = warc.round_trip(d).collect()
    assert len(got) == len(rows)
    firsts = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        firsts.setdefault((html or "").encode(), page)
    payload = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for p in firsts}
    n_response = Counter()
    for r in got:
        p = payload[r["payload_digest"]]
        assert r["payload_bytes"] == len(p) and (r["record_type"] == "response") == (r["refers_to"] is None)
        n_response[p] += r["record_type"] == "response"
        assert r["record_type"] == "response" or r["refers_to"] == firsts[p]
    assert set(n_response.values()) == {1} and warc.round_trip(d.limit(0)).count() == 0
    some = warc.round_trip(d, min_bytes=8).where("record_type = 'revisit' and payload_bytes < 8").count()
    assert some == 0


def test_any_gzip_layout_is_read(tmp_path):
    raw = [warc.record("response", f"urn:page:{i}:0", "u", warc.digest(b"x" * i), i, b"x" * i) for i in range(50)]
    import gzip
    import io

    whole = gzip.compress(b"".join(raw))
    members = b"".join(gzip.compress(x) for x in raw)
    mixed = gzip.compress(b"".join(raw[:20])) + b"".join(gzip.compress(x) for x in raw[20:])
    for data in (whole, members, mixed):
        assert list(warc.inflate(io.BytesIO(data))) == raw
    with pytest.raises((ValueError, zlib.error)):
        list(warc.inflate(io.BytesIO(whole[: len(whole) // 2])))


# --- 7: near copies -----------------------------------------------------------------------


def brute_classes(rows):
    bags = []
    for r in rows:
        w = (r["text"] or "").encode().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    same = {}
    for i, r in enumerate(rows):
        key = b" ".join((r["text"] or "").encode().split())
        parent[find(i)] = find(same.setdefault(key, i))
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b and (n := sum((a & b).values())) >= 0.8 * (a.total() + b.total() - n) - 1e-9:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_copies(spark, stored, docs, monkeypatch):
    d = stored(docs.union(odd(spark)))
    rows = d.collect()
    root = brute_classes(rows)
    best = {}
    for r, k in zip(rows, root, strict=True):
        best[k] = min(best.get(k, math.inf), math.inf if r["doc_id"] is None else r["doc_id"])
    want = Counter((r["doc_id"], None if best[k] == math.inf else best[k]) for r, k in zip(rows, root, strict=True))
    got = bagminhash.near_duplicates(d).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want and sum(r["kept"] for r in got) == len(best)
    monkeypatch.setattr(bagminhash, "BLOCK_SHINGLES", 300)  # clusters in many blocks
    got = bagminhash.near_duplicates(d).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want
    kept = bagminhash.keep_one(d)
    assert kept.count() == len(best) and kept.columns == d.columns and bagminhash.near_duplicates(d.limit(0)).count() == 0


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    b[:100] = a[:100]
    sig = bagminhash.signatures(2, np.repeat([0, 1], 300), np.concatenate((h, h)), np.concatenate((a, b)), 4000)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)
    one = bagminhash.signatures(1, np.zeros(300, int), h, a, 4000)
    assert (one[0] == sig[0]).all()  # alike, whatever else is in the batch


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}


# --- 9: vectors ---------------------------------------------------------------------------


def test_vectors(spark, stored, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 40)  # lists in several blocks
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 16))
    x[50:90] = x[:40] + rng.normal(size=(40, 16)) * 0.35
    x[90:110] = x[0] + rng.normal(size=(20, 16)) * 0.2
    x[110:115] = x[1]
    rows = [(i, [float(np.float32(z)) for z in v], int(i % 2 if i < 50 else 0)) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[0][1], None), (304, rows[0][1][:8], 0), (305, [None] + rows[0][1][1:], 0), (306, [], 1)]
    d = stored(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1)))
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = defaultdict(set)
    for i, v, a in usable:
        for j, u, b in usable:
            if i != j and a == b and len(v) == len(u) and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.93:
                links[i].add(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq_dedup.near_duplicates(d).collect()}
    assert got == {i: (len(links[i]), reach(i), reach(i) == i) for i, _, _ in rows}
    assert pq_dedup.near_duplicates(d.limit(0)).count() == 0


def test_vectors_of_any_size_and_repeated_ids(spark, stored):
    v = [3.0, 1.0, -2.0, 0.5]
    rows = [(1, v), (2, [x * 1e300 for x in v]), (3, [x * 1e-300 for x in v]), (3, [x * 2 for x in v]), (None, v), (4, [-x for x in v]), (5, [float("inf")] + v[1:])]
    d = stored(spark.createDataFrame([(i, x, 7) for i, x in rows], "vec_id long, embedding array<double>, label int"))
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in pq_dedup.near_duplicates(d).collect())
    assert got == Counter([(1, 4, 1), (2, 4, 1), (3, 4, 1), (3, 4, 1), (None, 4, 1), (4, 0, 4), (5, 0, 5)])


def test_recall_of_the_probes():
    """Pairs at just the linking cosine, in random directions, against what the probes of either vector reach."""
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for n in (1000, 20_000, 60_000):
        level = int(round(np.log2(n / pq_dedup.LIST)))
        model = pq_dedup.fit(unit(rng.standard_normal((max(4096, pq_dedup.SAMPLE << level), 64))), 1 << level)
        x, r = unit(rng.standard_normal((1000, 64))), rng.standard_normal((1000, 64))
        y = pq_dedup.COSINE * x + (1 - pq_dedup.COSINE**2) ** 0.5 * unit(r - (r * x).sum(1, keepdims=True) * x)
        (hx, cx, lx, px), (hy, cy, ly, py) = pq_dedup.encode(x, model), pq_dedup.encode(y, model)
        found = (px == hy[:, None]).any(1) | (py == hx[:, None]).any(1)
        assert found.mean() >= 0.99
        for i in range(50):  # the codes lose none of them
            assert len(pq_dedup.candidates(x[i : i + 1], cy[i : i + 1], ly[i : i + 1], model["coarse"][hy[i]], model)[0])


def test_fit_at_all_lists_stays_small():
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.standard_normal((16_384, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    model = pq_dedup.fit(x, pq_dedup.LISTS)
    near, codes, least, probe = pq_dedup.encode(x[:10_000], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 27 and probe.shape == (10_000, pq_dedup.probes(pq_dedup.LISTS))
    d = ((x[:300, None, :] - model["coarse"][None, :, :]) ** 2).sum(2)
    assert np.array_equal(near[:300], d.argmin(1)) and all(set(p) == set(np.argsort(r)[: len(p)]) for p, r in zip(probe[:300], d, strict=True))


# --- 10: language model -------------------------------------------------------------------


def test_base_scores_and_model(spark, stored, docs):
    d = stored(docs.union(odd(spark)))
    rows = d.collect()
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = [(r["text"] or "").encode().translate(low).split() + [0] for r in rows]
    held = [gru_lm.held_out(r["doc_id"]) for r in rows]
    c = Counter(t for x, h in zip(tokens, held, strict=True) if not h for t in x)
    n, v = c.total(), len(c)
    got = gru_lm.score(d).toPandas()
    want = sorted((len(x), sum(c[t] > 0 for t in x), round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x), 6)) for x in tokens)
    assert sorted(zip(got.n_tokens, got.n_known, got.base_score.round(6), strict=True)) == [(a, b, pytest.approx(s, abs=2e-6)) for a, b, s in want]
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all() and (got.score < 0).all()
    assert gru_lm.score(d.limit(0)).count() == 0


def test_the_model_beats_the_counts_on_held_out_documents(spark, stored):
    """Texts of a small grammar: what follows a word is known from it, but not from the counts."""
    rng = random.Random(6)
    after = {w: [f"w{rng.randrange(120)}" for _ in range(3)] for w in (f"w{i}" for i in range(120))}

    def text():
        out = [f"w{rng.randrange(120)}"]
        for _ in range(150):
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    got = gru_lm.score(stored(spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string"))).where("held_out").toPandas()
    assert (got.score / got.n_tokens).mean() > (got.base_score / got.n_tokens).mean() + 0.2


def test_model_learns_and_is_a_distribution():
    rng = np.random.default_rng(0)
    size = gru_lm.CLASSES * gru_lm.WIDE
    model = gru_lm.Model.fresh(np.log(np.full(size, 1 / size)))
    entry = np.tile([5, 9, 700, 33], 800)
    start, n = np.arange(0, 3200, 100), np.full(32, 100)
    before = gru_lm.score_documents(model, entry, entry, start, n).sum()
    trainer = gru_lm.Trainer(model)
    for _ in range(6):
        trainer.documents(entry, entry, start, n)
    assert gru_lm.score_documents(model, entry, entry, start, n).sum() > 0.5 * before
    states = rng.normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    total = np.exp(model.log_probs(np.repeat(states, size, 0), np.arange(size))).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_gradients(monkeypatch):
    """Backpropagation against differences."""
    size = gru_lm.CLASSES * gru_lm.WIDE
    model = gru_lm.Model.fresh(np.log(np.full(size, 1 / size)), 3)
    rng = np.random.default_rng(1)
    for k in gru_lm.Model.NAMES:
        setattr(model, k, (getattr(model, k) + rng.normal(size=getattr(model, k).shape) * 0.3).astype(np.float64))
    ids, target = rng.integers(0, size, (6, 4)), rng.integers(0, size, (6, 4))
    h0 = np.zeros((4, gru_lm.HIDDEN))

    def loss():
        h, states = h0, []
        for k in range(6):
            h = model.step(model.embed[ids[k]] @ model.inputs + model.bias, h)[4]
            states.append(h)
        return -model.log_probs(np.concatenate(states), target.ravel()).sum() / 4

    grads = {}
    trainer = gru_lm.Trainer(model)
    monkeypatch.setattr(trainer, "_update", lambda name, at, g: grads.setdefault(name, []).append((at, g)))
    monkeypatch.setattr(gru_lm.np, "clip", lambda x, *_: x)
    trainer.window(ids, target, np.ones((6, 4), bool), h0)
    for name, index in (("recur", (3, 5)), ("inputs", (2, 40)), ("bias", (7,)), ("classes", (1, 2))):
        p = getattr(model, name)
        p[index] += 1e-5
        up = loss()
        p[index] -= 2e-5
        down = loss()
        p[index] += 1e-5
        assert grads[name][0][1][index] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), name


def test_scores_do_not_depend_on_windows():
    size = gru_lm.CLASSES * gru_lm.WIDE
    model = gru_lm.Model.fresh(np.log(np.full(size, 1 / size)), 3)
    model.classes = np.random.default_rng(2).normal(size=model.classes.shape).astype(np.float32)
    entry = np.random.default_rng(3).integers(0, size, 500)
    start, n = np.array([0, 100, 130, 499]), np.array([100, 30, 369, 1])
    want = gru_lm.score_documents(model, entry, entry, start, n)
    for lanes, steps in ((1, 1000), (2, 7), (4, 1)):
        assert np.allclose(want, gru_lm.score_documents(model, entry, entry, start, n, lanes, steps), rtol=1e-4)


def test_three_factors_are_a_distribution_of_few_logits():
    """Each entry's share from the logits of its class, group and own row alone, also where sums leave the numbers' range."""
    p = 1 / np.arange(1, 20001)
    p /= p.sum()
    model = gru_lm.Model.fresh(np.log(p), 3)
    rng, y = np.random.default_rng(4), np.arange(len(p))
    logits = np.zeros(len(p))
    for name, _, runs in model.levels(y):
        for own, rows in runs:
            logits[rows] += own.stop - own.start
        setattr(model, name, (getattr(model, name) + rng.normal(size=getattr(model, name).shape) * 0.3).astype(np.float32))
    assert (p * logits).sum() < 1.2 * np.sqrt(p).sum()  # twice as many in two factors
    states = np.repeat(rng.normal(size=(1, gru_lm.HIDDEN)).astype(np.float32), len(p), 0)
    want = 0
    for name, number, runs in model.levels(y):
        s = (getattr(model, name).astype(float) @ np.append(states[0], 1))
        for own, rows in runs:
            s[own] -= np.log(np.exp(s[own]).sum())
        want = want + s[number] * np.isin(number, np.concatenate([np.arange(own.start, own.stop) for own, _ in runs]))
    assert np.allclose(model.log_probs(states, y), want, atol=1e-3) and np.exp(want).sum() == pytest.approx(1, abs=1e-3)
    for name, shift in (("classes", 100), ("groups", -100), ("entries", 100)):
        getattr(model, name)[:, -1] += np.float32(shift)
    assert np.allclose(model.log_probs(states, y), want, atol=2e-3)


def test_every_training_document_gives_gradients_once(tmp_path):
    docs = list(range(400))
    texts = [b" ".join(b"w%d" % (i * k % 97) for k in range(1 + i % 7)) for i in docs]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "text": pa.array([t.decode() for t in texts])})
    names = [b.column("block")[0].as_py() for b in gru_lm.write_blocks(f"file://{tmp_path}")([batch])]
    size = gru_lm.CLASSES * gru_lm.WIDE
    model = gru_lm.Model.fresh(np.log(np.full(size, 1 / size)))

    class Shared:
        value = (np.arange(1, size + 1, dtype=np.uint64), model)

    seen = 0
    for k in range(gru_lm.ROUNDS):
        got = list(gru_lm.train_round(f"file://{tmp_path}", Shared, k, gru_lm.ROUNDS)([pa.RecordBatch.from_pydict({"block": names})]))
        seen += got[0].column("weight")[0].as_py()
    assert seen == sum(len(t.split()) + 1 for d, t in zip(docs, texts, strict=True) if not gru_lm.held_out(d))


def test_texts_become_tokens_once(tmp_path, monkeypatch):
    """Training and scoring read numbers of distinct words, which give back every token, its suffix, counts and sizes."""
    rng = random.Random(9)
    texts = [(prose(rng, rng.randint(0, 400)) + rng.choice(["", "\n é 好 Ab aB"])).encode() for _ in range(300)] + [b"", b"   ", b"alone"]
    docs = [None, *range(1, len(texts))]
    e = gru_lm.Encoded(texts)
    monkeypatch.setattr(gru_lm, "PART", 5000)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "text": pa.array([t.decode() for t in texts])})
    (written,) = gru_lm.write_blocks(f"file://{tmp_path}")([batch])
    name, words = written.column("block")[0].as_py(), np.array(written.column("words")[0].as_py(), np.int64).view(np.uint64)
    calls = []
    monkeypatch.setattr(gru_lm, "Encoded", lambda rows: calls.append(len(rows)))
    block = gru_lm._read_block(f"file://{tmp_path}", name)
    assert block.docs == docs and (block.size == e.size).all() and (block.length == [len(t) for t in texts]).all()
    assert (block.words == words).all() and len(set(words)) == len(words) and set(words) == set(e.hash)
    assert (words[block.number] == e.hash).all() and (block.suffix[block.number] == e.suffix).all()
    learn = Counter(e.hash[np.repeat([not gru_lm.held_out(d) for d in docs], e.size)])
    assert written.column("counts")[0].as_py() == [learn[w] for w in words]

    size, n, v = gru_lm.CLASSES * gru_lm.WIDE, sum(learn.values()), len(learn)

    class Shared:
        value = (np.concatenate((np.array([1, gru_lm.END_HASH], np.uint64), np.arange(2, size, dtype=np.uint64))), gru_lm.Model.fresh(np.log(np.full(size, 1 / size))))

    class Names:
        value = {7: name}

    got = [list(gru_lm.train_round(f"file://{tmp_path}", Shared, k, 4)([pa.RecordBatch.from_pydict({"block": [name]})])) for k in range(4)]
    assert sum(x[0].column("weight")[0].as_py() for x in got) == n
    table = pa.table({"word": pa.array(words.view(np.int64)), "c": pa.array([learn[w] for w in words], pa.int64())})
    out = gru_lm.score_block(f"file://{tmp_path}", Shared, Names, n, v, (n - learn[gru_lm.END_HASH], v - 1))((pa.scalar(7),), table)
    assert out.column("doc_id").to_pylist() == docs and out.column("n_tokens").to_pylist() == e.size.tolist()
    base = np.log10([(learn[w] + 0.1) / (n + 0.1 * (v + 1)) for w in e.hash])
    assert np.allclose(out.column("base_score"), np.add.reduceat(base, e.start)) and np.isfinite(out.column("score").to_numpy()).all()
    assert calls == []


def test_listed_words_grow_with_the_tokens(spark, stored, monkeypatch):
    sizes = [a * b for a, b in map(gru_lm.shape_of, (0, 10**6, 10**8, 10**10))]
    assert sizes[0] == 2048 and sizes[1] >= 4000 and sizes[2] >= 40000 and sizes[3] >= 400000
    made, fresh = [], gru_lm.Model.fresh
    monkeypatch.setattr(gru_lm.Model, "fresh", lambda x, **k: made.append((len(x), int((x > -20).sum()))) or fresh(x, **k))
    rows = [(i, " ".join(f"w{(i * 37 + k) % 6000}" for k in range(500)), "a", "x") for i in range(1000)]
    got = gru_lm.score(stored(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))).toPandas()
    n = int(got.train_tokens[0])
    assert made == [(math.prod(gru_lm.shape_of(n)),) * 2] and made[0][0] >= 4 * int(n**0.5) - 4 > 2048
    assert np.isfinite(got.score).all() and got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_takes_repeated_lines_out(spark, stored):
    import corpus_pipeline

    rows = [(i, f"own first line {i}\n" + "a line that every source repeats\n" * (i % 25 < 2) + "own copies\n" * (i % 250 == 9) + f"own last line {i}", f"s{i % 2}", "x") for i in range(1000)]
    d = stored(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.length("text").cast("long")))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, d, "").collect()}
    assert got == {i: text.replace("a line that every source repeats\n", "") for i, text, *_ in rows}
    assert sum(text != got[i] for i, text, *_ in rows) == 80


def test_pipeline(spark, stored, docs, labels, tmp_path):
    import corpus_pipeline

    docs = docs.select("doc_id", "text", "source", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = stored(stage(spark, d, str(tmp_path)))
        sizes[name] = d.count()
        if name != "packing":
            assert d.columns == before.columns
        if name == "quality_rules":
            clean = {r["doc_id"] for r in before.where("doc_id < 500").collect() if not brute_rules(r["text"])[5]}
            assert len(clean - {r["doc_id"] for r in d.collect()}) <= 0.03 * len(clean)
            assert d.where("doc_id >= 500").count() < 5
        if name == "near_dedup":
            assert sizes[name] == len(set(brute_classes(before.collect())))
        if name == "mixing":
            words = sum(len(r["text"].split()) for r in before.collect())
            assert sum(len(r["text"].split()) for r in d.collect()) == pytest.approx(1.5 * words, rel=0.1)
        if name == "packing":
            n = d.groupBy("sequence_id").agg(F.sum("length").alias("n"))
            assert n.where("n > 2048").count() == 0 and d.select("row").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes["packing"]


# --- rows, shared folders and odd inputs ---------------------------------------------------


def test_rows_keep_their_numbers_when_files_are_split_anew(spark, tmp_path, docs, monkeypatch):
    """Executors that come or go change how a scan is cut: here the cut changes after the first written table."""
    path = str(tmp_path / "t.parquet")
    docs.withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.sha2("text", 256), 40))).coalesce(1).write.option("parquet.block.size", 1 << 16).parquet(path)
    d = spark.read.parquet(path)
    key = "spark.sql.files.maxPartitionBytes"

    def results():
        near = sorted(tuple(r) for r in bagminhash.near_duplicates(d).collect())
        mix = sorted(tuple(r) for r in mixing.mixed(d, block=64).select("doc_id", "text").collect())
        return near, mix

    want, before, real = results(), spark.conf.get(key), common.scratch_at

    def scratch_at(*a):
        out = real(*a)
        spark.conf.set(key, str(1 << 16))
        return out

    monkeypatch.setattr(common, "scratch_at", scratch_at)
    try:
        first = sorted(tuple(r) for r in bagminhash.near_duplicates(d).collect())
        spark.conf.set(key, before)
        second = sorted(tuple(r) for r in mixing.mixed(d, block=64).select("doc_id", "text").collect())
    finally:
        spark.conf.set(key, before)
    assert want[0] == first and want[1] == second and second


def test_a_cluster_needs_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = Conf  # noqa: N815

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_pipeline_on_odd_and_empty_tables(spark, stored, tmp_path, labels):
    import corpus_pipeline

    odd_docs = odd(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    rows = odd_docs.union(odd_docs.withColumn("text", F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) for i in range(80)])))
    for name, docs in (("odd", rows), ("none", rows.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.limit(0).write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, folder).count() >= (name == "odd")


def test_lines_and_mixes_of_odd_rows(spark, stored):
    d = stored(odd(spark))
    out = line_dedup.dedup_documents(d)
    assert out.count() == len(ODD) and out.columns == d.columns and line_dedup.dedup_documents(d.limit(0)).count() == 0
    assert mixing.mixed(d.limit(0)).count() == 0 and mixing.mixed(d).columns == d.columns
    pages = stored(spark.createDataFrame([(1, "http://h/a", "<p>x</p>"), (1, "http://h/a", "<p>x</p>"), (2, "http://h/b", "<p>x</p><p>" + "long " * 200_000 + "</p>"), (None, None, None)], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("kept", F.lit(1)))
    got = sorted((r["page_id"] or 0, r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_pages(pages).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 1)]


def test_statistics_of_a_text():
    """A few of the discriminant's statistics, counted plainly."""
    rows = ["Hello, World! the end.\nHello\nHello\n", "", "a a a a a a", "ÄÖ 12 ##"]
    x = quality_qda.statistics([r.encode() for r in rows])
    odds = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    names, k = list(quality_qda._CLASS), len(quality_qda._CLASS)
    for i, r in enumerate(rows):
        raw, words = r.encode(), r.split()
        for j, members in enumerate(quality_qda._CLASS.values()):
            assert x[i, j] == pytest.approx(odds(sum(b in members for b in raw), len(raw))), names[j]
        assert x[i, k] == pytest.approx(math.log1p(len(raw))) and x[i, k + 1] == pytest.approx(math.log1p(len(words)))
        assert x[i, k + 4] == pytest.approx(odds(len(set(words)), len(words)))
