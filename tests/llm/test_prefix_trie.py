"""The prefix trie against a brute-force one: odd rows, long conversations over many ranges, hot beginnings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from subtide.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, borrow=20, most=4):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            d = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            talks[c].append((t is not None, t or 0, int(d[:15], 16), int(d[15:30], 16), r, x))
    talks = {c: [x[4:] for x in sorted(v)] for c, v in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % most if borrow else 0
        donor = talks.get(c - (c % borrow if c >= 0 else -(-c % borrow)), []) if borrow else []
        rebuilt[c] = tuple(donor[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(rebuilt.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    kids = defaultdict(int)
    for t in members:
        if t:
            kids[t[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for t, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", t[-1][1])) if t else 0
        for d in range(len(t) + 1):
            leaves[t[:d]] += not kids[t]
            saved[t[:d]] += (len(m) - 1) * words
    sha = lambda t: hashlib.sha256(",".join(map(str, ends.get(t, []))).encode()).hexdigest()
    return sorted((m[0], len(t), members[t[:-1]][0] if t else None, len(m), kids[t], leaves[t], saved[t], sha(t)) for t, m in members.items())


def got(df, **options):
    return sorted(tuple(r) for r in prefix_trie.shared_beginnings(df, **options).collect())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["ja", "nein", "oui", "x\ty"]) for _ in range(rng.randint(0, 3)))
    rows = [(c, t, rng.choice(["user", "bot", None]), line() or None) for c in range(-45, 130) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "the same") for c in range(200, 260) for t in range(4)]  # copies
    rows += [(300, t, "user", f"turn {t % 7}") for t in range(700)]  # one long conversation, and one that shares most of it
    rows += [(301, t, "user", f"turn {t % 7}" if t < 500 else "other") for t in range(600)]
    rows += [(400, None, "user", "first"), (400, 0, "user", "second"), (400, 0, "user", "second"), (400, 0, "bot", "second"), (None, 1, "user", "nobody's"), (401, 5, "", "")]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark, talks):
    common.ship(spark)
    df = spark.createDataFrame(talks, SCHEMA).withColumn("words", F.lit("x")).withColumn("depth", F.lit(None).cast("string"))
    assert got(df) == brute(talks)


def test_no_borrowing_and_many_ranges(spark, talks):
    for name, value in {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(name, value)
    try:
        assert got(spark.createDataFrame(talks, SCHEMA), borrow=0) == brute(talks, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_of_a_long_end_list(spark):
    rows = [(c * 3, 0, "user", "hello") for c in range(4000)]
    assert got(spark.createDataFrame(rows, SCHEMA), borrow=0) == brute(rows, 0)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_texts(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, 0, "user", "word " * 200_000), (2, 0, "user", "word " * 200_000), (2, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, borrow=0) == brute(rows, 0)
    texts = {(r.low, r.depth): (r.role, r.text) for r in prefix_trie.with_turns(prefix_trie.trie(df, 0), df).collect()}
    assert texts == {(1, 0): (None, None), (1, 1): ("user", rows[0][3]), (2, 2): ("", "")}
