"""Exact percentiles of small and large groups against numpy."""

import numpy as np
import pytest

from fluvial.operators.quantiles import percentiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.751, 1.0]


@pytest.mark.parametrize("hot_rows,buckets", [(0, 1024), (100, 32), (10**6, 1024)])
def test_percentiles(spark, hot_rows, buckets):
    rng = np.random.default_rng(7)
    groups = {
        1: rng.normal(size=501), 2: rng.integers(0, 5, 1000).astype(float), 3: np.full(400, 2.5), 4: np.array([1.0]), 5: 10.0 ** rng.uniform(-200, 200, 700) * rng.choice([-1, 1], 700),
        6: np.concatenate((np.zeros(900), rng.uniform(0, 1e-9, 99), [1e9])), 7: np.nextafter(1.0, 2.0) ** np.arange(350), 8: np.array([3.0, 4.0]),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(1, None), (2, float("nan")), (9, None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(7)
    got = {r.k: r.p for r in percentiles(df, "k", "x", PROBABILITIES, hot_rows, buckets).collect()}
    assert set(got) - {None} == set(groups)
    for k, v in groups.items():
        assert np.allclose(got[k], np.percentile(v, [100 * p for p in PROBABILITIES]), rtol=1e-12, atol=0), k
