"""Kernel drift by blocks against the whole matrix."""

import numpy as np

from failscope.operators import models as bm


def whole(x, r, bandwidth=1.0):
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / (2 * bandwidth**2))
    a, b = x[r], x[~r]
    n, m = len(a), len(b)
    return (k(a, a).sum() - n) / (n * (n - 1)) + (k(b, b).sum() - m) / (m * (m - 1)) - 2 * k(a, b).mean()


def test_one_block_is_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2)) + [[0.0, 5.0]]
    r = rng.random(500) < 0.5
    x[~r, 0] += 1.0
    rows = [(i, float(a), float(b), "reference" if k else "current") for i, ((a, b), k) in enumerate(zip(x, r))] + [(900, None, 1.0, "current"), (901, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, cohort string")
    got = bm.kernel_drift(df, ["a", "b"], block=600).first()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert abs(got.mmd2 - whole(z, r)) < 1e-5 and got.drift and got.p == round(1 / 101, 6)
    some = bm.kernel_drift(df, ["a", "b"], block=64)
    assert some.first().drift and some.collect() == bm.kernel_drift(df.repartition(5), ["a", "b"], block=64).collect()
    none = bm.kernel_drift(df.where("cohort = 'reference'"), ["a", "b"]).first()
    assert none.mmd2 is None and none.p is None and not none.drift and bm.kernel_drift(df.limit(0), ["a", "b"]).first().drift is False


def test_false_alarms_are_about_as_rare_as_they_should_be():
    rng, alarms = np.random.default_rng(2), 0
    for t in range(200):
        v = np.mean([bm.block_mmd(rng.normal(size=(64, 2)), rng.random(64) < 0.5, 100, 1.0, 1000 * t + b) for b in range(3)], axis=0)
        alarms += ((v[1:] >= v[0]).sum() + 1) / 101 < 0.05
    assert 2 <= alarms <= 20
