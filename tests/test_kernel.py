"""Kernel machines: features that approximate the kernel, and classes no plane can part."""

import numpy as np

from casewright.operators import kernel as k

SCHEMA = "vec_id bigint, label_index int, embedding array<float>"


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    z = k.FourierFeatures(5, 0.3, 20_000, 7).apply(x)
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def rings(n, seed):
    """Points on two circles around the same centre."""
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    radius = np.where(label == 0, 1.0, 3.0) + rng.normal(0, 0.1, n)
    angle = rng.uniform(0, 2 * np.pi, n)
    return label, np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)


def test_two_rings(spark):
    label, points = rings(600, 3)
    rows = [(i, int(y), [float(v) for v in p]) for i, (y, p) in enumerate(zip(label, points))]
    odd = [(900, 0, None), (901, 1, []), (902, 0, [1.0, None]), (903, 1, [float("nan"), 0.0]), (904, None, [0.0, 0.0]), (905, 0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = k.fit_kernel_machines(df.filter("vec_id % 3 > 0"))
    got = {r["vec_id"]: r["predicted"] for r in model.transform(df, "vec_id").collect()}
    held_out = [i for i in range(600) if i % 3 == 0]
    assert sum(got[i] == label[i] for i in held_out) >= 0.98 * len(held_out)
    assert [got[i] for i in (900, 901, 902, 903, 905)] == [None] * 5 and got[904] is not None
    assert len(got) == len(rows) + len(odd)


def test_gamma_follows_the_scale(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 2.0]), (1, 0, [4.0, 2.0])], SCHEMA)
    assert abs(k.scale_gamma(df) - 1 / (2 * 2.0)) < 1e-12
