"""Curves pooled over reaches against a dense search of the exponent."""

import numpy as np

from fluvial.operators import fits

KIND = "COMID long, base_elev double, inc array<struct<q:double,v:double,t:double,wse:double>>"


def best(q, y):
    """Least squares of y = a q^b: the exponent by ever finer grids, the factor in closed form."""
    low, high = -8.0, 8.0
    for _ in range(12):
        b = np.linspace(low, high, 401)
        p = q[None, :] ** b[:, None]
        a = (p * y).sum(axis=1) / (p * p).sum(axis=1)
        k = int(((a[:, None] * p - y) ** 2).sum(axis=1).argmin())
        low, high = b[max(k - 1, 0)], b[min(k + 1, 400)]
    return a[k], b[k]


def test_pooled_curves(spark):
    rng, rows, want = np.random.default_rng(11), [], {}
    for reach in range(6):
        q = rng.uniform(0.5, 300, (40, 5))
        noise = lambda: rng.normal(1, 0.25 * (reach > 2), q.shape)  # noqa: E731,B023
        v, t, d = 0.4 * q**0.35 * noise(), 7 * q ** (0.2 + reach / 10) * noise(), 0.3 * q**0.5 * noise()
        rows += [(reach, 10.0, [(*map(float, x),) for x in zip(q[i], v[i], t[i], 10 + d[i])]) for i in range(40)]
        want[reach] = [c for y in (d, t, v) for c in best(q.ravel(), y.ravel())]
    rows += [(10, 0.0, [(5.0, 1.0, 2.0, 3.0)]), (11, 0.0, [(5.0, 1.0, 2.0, 3.0), (5.0, 3.0, 2.0, 5.0)]), (12, 0.0, [(1.0, 0.0, 1.0, 1.0), (2.0, 0.0, 2.0**20, 0.5), (4.0, 0.0, 4.0**20, 0.25)]), (13, 0.0, [(0.0, 1.0, 1.0, 1.0), (-1.0, 2.0, 2.0, 2.0)]), (14, 0.0, [])]
    got = {r[0]: list(r)[1:] for r in fits.pooled_curves(spark.createDataFrame(rows, KIND).repartition(5)).collect()}
    for reach, w in want.items():
        assert np.allclose(got[reach], np.rint(np.array(w) * 1000) / 1000, rtol=0, atol=1.1e-3), (reach, got[reach], w)
    assert got[10] == [fits.FAILED] * 6  # one point
    level = lambda y, b: round(y / 5.0**b, 3)
    assert got[11] == [level(4.0, 0.5), 0.5, level(2.0, 0.3), 0.3, level(2.0, 0.3), 0.3]  # one flow: the first guess's exponent
    assert got[12][2:4] == [fits.FAILED] * 2 and abs(got[12][1] + 1) < 2e-3 and got[12][4] == 0.0  # beyond the grid; falling; nothing
    assert set(got) == {*range(6), 10, 11, 12}


def test_reaches_in_one_task_and_in_passes_give_the_same(spark):
    rng, rows = np.random.default_rng(12), []
    for reach in range(8):
        q = rng.uniform(0.5, 300, (60, 5))
        noise = lambda: rng.normal(1, 0.2, q.shape)  # noqa: E731,B023
        v, t, d = 0.4 * q**0.35 * noise(), 7 * q ** (0.2 + reach / 10) * noise(), 0.3 * q**0.5 * noise()
        rows += [(reach, 10.0, [(*map(float, x),) for x in zip(q[i], v[i], t[i], 10 + d[i])]) for i in range(10 if reach % 2 else 60)]
    rows += [(20, 0.0, [(2.0, None, 2.0, 3.0), (3.0, None, 2.5, None)]), (21, 0.0, None), (22, None, [(2.0, None, None, 3.0)])]
    results = spark.createDataFrame(rows, KIND).repartition(4)
    once, passes, mixed = ({r[0]: list(r)[1:] for r in fits.pooled_curves(results, long_reach=n).collect()} for n in (10**6, 0, 100))
    assert set(once) == set(passes) == set(mixed) == {*range(8), 20}
    for reach, w in passes.items():
        assert np.allclose(once[reach], w, rtol=0, atol=1.1e-3) and np.allclose(mixed[reach], w, rtol=0, atol=1.1e-3), reach
