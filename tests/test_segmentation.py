"""Words of run-together texts against every path, in both ways that a lexicon is used."""

import itertools
import math
import random

import pytest

from subtide.operators import segmentation


def brute(text, lexicon, longest=8):
    """Of all cuts the one of the greatest sum; of equal ones the one with the longer last word, and so on backwards."""
    total = math.log(sum(lexicon.values()) or 1)
    best = None
    for cuts in itertools.product((0, 1), repeat=max(len(text) - 1, 0)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        words = [text[a:b] for a, b in itertools.pairwise(at)]
        if any(len(w) > 1 and (w not in lexicon or len(w) > longest) for w in words):
            continue
        score = (round(sum(math.log(lexicon.get(w, 1)) - total for w in words), 7), [len(w) for w in reversed(words)])
        if best is None or score > best[0]:
            best = (score, words)
    return best[1] if text else []


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(8)
    letters = "ab中国𠀀"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    lexicon = {word(rng.randint(1, 4)): rng.choice([1, 2, 5, 9, 20]) for _ in range(60)}
    texts = [word(rng.randint(1, 10)) for _ in range(150)] + ["", None, "x", "a" * 12]
    return lexicon, texts


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_both_ways_find_the_likeliest_words(spark, cases, most):
    lexicon, texts = cases
    rows = [(w, float(n)) for w, n in lexicon.items()]
    rows = rows[:-1] + [(rows[-1][0], rows[-1][1] / 2)] * 2 + [(None, 3.0), ("ab", 0.0), ("a" * 9, 5.0)]
    d = spark.createDataFrame([(i, x, "y") for i, x in enumerate(texts)], "id long, text string, words_of string")
    got = {r["id"]: r["words"] for r in segmentation.segment(d, spark.createDataFrame(rows, "word string, weight double"), most=most).collect()}
    lexicon = {w: n for w, n in lexicon.items() if len(w) <= 8}
    for i, x in enumerate(texts):
        assert got[i] == brute(x or "", lexicon), x


def test_no_lexicon_and_long_texts(spark):
    d = spark.createDataFrame([("abc" * 50_000,), ("b",)], "text string")
    none = spark.createDataFrame([], "word string, weight double")
    assert sorted(len(r["words"]) for r in segmentation.segment(d, none).collect()) == [1, 150_000]
    got = segmentation.segment(d, spark.createDataFrame([("abc", 5.0), ("ca", 4.0)], "word string, weight double"))
    assert sorted(len(r["words"]) for r in got.collect()) == [1, 50_000]
    assert segmentation.segment(d.limit(0), none).count() == 0
