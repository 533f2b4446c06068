"""Support vector machines with a Gaussian kernel, as linear ones on random Fourier features.

The kernel exp(-gamma |x - y|^2) is the mean of cos(w.x - w.y) over normal directions w (Rahimi and
Recht 2007). ``features`` directions with random phases turn each vector into a row whose inner
products are close to the kernel, and one linear machine per class is fitted on these rows. The
directions follow from a seed, so tasks make them on their own; only the vectors move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.sources.storage import written

FEATURES = 512


def usable(embedding: str = "embedding"):
    """Rows whose vector is there, whole and finite."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite


def scale_gamma(df: DataFrame, embedding: str = "embedding") -> float:
    """One over the width of the vectors and the variance of all their components."""
    parts = df.select(F.size(embedding).alias("width"), F.explode(embedding).alias("x"))
    width, variance = parts.agg(F.max("width"), F.var_pop("x")).first()
    return 1.0 / (width * variance) if width and variance else 1.0


@dataclass
class FourierFeatures:
    """Maps rows of ``width`` numbers to ``count`` features."""

    width: int
    gamma: float
    count: int = FEATURES
    seed: int = lx.SEED

    def apply(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(0.0, np.sqrt(2 * self.gamma), (self.width, self.count))
        phases = rng.uniform(0.0, 2 * np.pi, self.count)
        return np.sqrt(2.0 / self.count) * np.cos(x @ directions + phases)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


@dataclass
class KernelMachines:
    """One machine per class over the same features."""

    features: FourierFeatures
    weights: np.ndarray       # features x classes
    intercepts: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.features.apply(x) @ self.weights + self.intercepts

    def transform(self, df: DataFrame, *keep: str, embedding: str = "embedding") -> DataFrame:
        """``(keep..., predicted, margins)``; null for a vector that is missing, not finite or of another width."""
        width = self.features.width
        fits = usable(embedding) & (F.size(embedding) == width)
        rows = df.select(*keep, F.when(fits, F.col(embedding).cast("array<double>")).alias("_x"))
        schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["predicted int", "margins array<double>"])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *kept, vectors = batch.columns
                there = vectors.is_valid()
                margins = self.margins(_matrix(vectors.filter(there), width))
                known = there.to_numpy(zero_copy_only=False)
                best = np.full(len(vectors), -1, np.int32)
                best[known] = margins.argmax(axis=1)
                found = iter(margins.tolist())
                listed = pa.array([next(found) if k else None for k in known], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best, mask=~known), listed], [*keep, "predicted", "margins"])

        return rows.mapInArrow(judge, schema)


def fit_kernel_machines(
    train: DataFrame, embedding: str = "embedding", label: str = "label_index", c: float = 1.0,
    gamma: float | None = None, count: int = FEATURES, max_iter: int = 100, seed: int = lx.SEED, parallelism: int = 8,
) -> KernelMachines:
    """Machines for labels ``0 .. n - 1`` from the rows with a usable vector of the first width and a label.

    ``gamma`` defaults to ``scale_gamma``. Spark averages the loss, so the penalty is 1 / (c n).
    """
    rows = train.filter(usable(embedding)).select(F.col(label).cast("double").alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.filter("label is not null")
    width = rows.agg(F.min(F.size("x"))).first()[0]
    if width is None:
        raise ValueError("no row has both a vector and a label")
    rows = rows.filter(F.size("x") == width)
    mapped = FourierFeatures(width, scale_gamma(rows, "x") if gamma is None else gamma, count, seed)

    def map_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = mapped.apply(_matrix(batch.column(1), width))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), count).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["label", "z"])

    # Read many times by every machine, so written once.
    table = written(rows.mapInArrow(map_rows, "label double, z array<double>"), "kernel-features")
    fitted = OneVsRest(
        classifier=LinearSVC(maxIter=max_iter, regParam=1.0 / (c * table.count()), standardization=False),
        featuresCol="features", labelCol="label", parallelism=parallelism,
    ).fit(table.select("label", array_to_vector("z").alias("features")))
    weights = np.stack([m.coefficients.toArray() for m in fitted.models], axis=1)
    return KernelMachines(mapped, weights, np.array([m.intercept for m in fitted.models]))
