"""Whitening against the exact decomposition of the whole table, quick spectra and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.llm import common, whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    z = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return kept, n, deviation, z @ u, e, np.trace(z.T @ z / n)


def check(got, rows, decimals=1e-7):
    kept, n, deviation, projected, e, trace = brute(rows)
    k = len(e)
    assert len(got) == n * k
    got = sorted(got, key=lambda r: (r.component, r.vec_id))
    order = sorted(range(n), key=lambda i: kept[i][0])
    for j in range(k):
        mine = got[j * n : (j + 1) * n]
        assert [r.component for r in mine] == [j + 1] * n and [r.vec_id for r in mine] == [kept[i][0] for i in order]
        assert [r.deviation for r in mine] == [deviation[i] for i in order] and all(r.n == n for r in mine)
        w = np.array([r.whitened for r in mine])
        want = projected[order, j] / math.sqrt(e[j])
        assert np.allclose(w, want * np.sign(w @ want), atol=decimals)
        assert all(abs(r.explained - e[j] / trace) <= 1e-9 for r in mine)
    assert all(r.identity_error <= 1e-8 for r in got) and len({r.identity_error for r in got}) == 1


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("n", F.lit("x")).withColumn("component", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(1)


def test_flat_spectrum_needs_the_full_dimension(spark, rng):
    common.ship(spark)
    x = rng.standard_normal((600, 24)) / 5
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    fit = whitening.Fit(whitening.sound(frame(spark, rows)), 24)
    assert fit.widths == [16, 24]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_falling_spectrum_stays_in_the_small_basis(spark, rng):
    x = rng.standard_normal((500, 40)) * np.array([2.0 ** -min(j, 12) if j < 8 else 1e-4 for j in range(40)])
    x = np.linalg.qr(rng.standard_normal((40, 40)))[0] @ x.T * 50
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x.T)]
    fit = whitening.Fit(whitening.sound(frame(spark, rows)), 40)
    assert fit.widths == [16] and fit.passes_made <= whitening.PASSES
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_odd_rows(spark, rng):
    x = rng.standard_normal((60, 3))
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    odd = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 0.0], 1), (103, [float("inf"), 0.0, 0.0], 2), (104, [], 2), (None, [0.5, 0.5, 0.5], 1)]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    named = [r for r in got if r.vec_id is not None]
    assert len(got) == 61 * 3 and {r.vec_id for r in named} == set(range(60)) and all(r.n == 61 for r in got)
    kept, n, deviation, projected, e, trace = brute([*rows, (1000, [0.5, 0.5, 0.5], 1)])
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert whitening.whiten(frame(spark, odd[:5])).collect() == []


def test_no_variance_large_entries_and_lengths(spark):
    one = whitening.whiten(frame(spark, [(1, [0.1, 0.2], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    rows = [(i, [float(i), 7.0], 1) for i in range(50)] + [(100 + i, [float(i), float(i * i), 1.0], 1) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.n, r.component) for r in got} == {(50, 1), (50, 2), (20, 1), (20, 2), (20, 3)}
    assert all((r.whitened is None) == (r.component == (2 if r.n == 50 else 3)) for r in got) and all(r.identity_error < 1e-9 for r in got)
    huge = whitening.whiten(frame(spark, [(1, [1e300, 0.0], 1), (2, [-1e300, 1.0], 1), (3, [1e12, 2.0], 1)])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge)


def test_deviation_beyond_quick_sums(spark):
    rows = [(i, [2.0**i, float(i % 3)], 1) for i in range(20)]
    kept, n, deviation, *_ = brute(rows)
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {i: d if d < 1 << 63 else None for (i, _), d in zip(kept, deviation, strict=True)}
