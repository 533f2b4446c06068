"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts
labelled bad. A text is cut into blocks of ``BLOCK`` bytes and every block is compressed
with either dictionary; the difference of the two sizes, divided by the text's size, says
which of the two it resembles. Blocks keep the dictionaries' weight equal over the whole
of a long text. A logistic curve fitted on other labelled texts turns the difference and
the share it compresses to into a score between 0 and 1.

The training sample is bounded: ``SAMPLE`` ids of each class in the order of a hash, half
of them for the dictionaries and half for the curve, texts of at most ``SAMPLE_CHARS``
characters. Every text is scored, whole.

Defined results: a null text is empty; an empty text has no difference and gets the score of
the curve there; with labels of one class only, or none, all scores are that class's share
(or one half); repeated rows give repeated results; an empty table gives an empty result.
Other columns, labels among them, are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import text_of

SAMPLE = 1600
SAMPLE_CHARS = 16_000
DICTIONARY_BYTES = 64 << 10
BLOCK = 4096
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]   # intercept, difference, share
    constant: float | None = None


def held_out() -> Column:
    """Rows that nothing is learnt from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


class _Sizes:
    def __init__(self, model: Model) -> None:
        import zstandard

        def compressor(raw: bytes):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress

        self.good, self.bad = compressor(model.good), compressor(model.bad)

    def features(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        good = bad = 0
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            good += len(self.good(block))
            bad += len(self.bad(block))
        return (bad - good) / len(text), min(good, bad) / len(text)


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton's method with a small ridge; classes weigh the same."""
    scale = np.abs(x).max(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta, ridge = np.zeros(a.shape[1]), 1e-3 * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(beta[0]), *(beta[1:] / scale).tolist()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries and curve from labelled rows that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    ids = None
    for quality in (0, 1):
        part = known.filter(F.col("quality") == quality).select("doc_id", "quality", order.alias("_order"))
        part = part.orderBy("_order", "doc_id").limit(sample)
        ids = part if ids is None else ids.union(part)
    texts = docs.select("doc_id", text_of("text").alias("_text")).filter(F.length("_text") <= SAMPLE_CHARS)
    # At most ``sample`` ids and texts of each class.
    rows = texts.join(F.broadcast(ids), "doc_id").select("_order", "doc_id", "quality", "_text").limit(4 * sample).collect()
    rows.sort(key=lambda r: (r["_order"], r["doc_id"]))
    by_class = {q: [r["_text"].encode() for r in rows if r["quality"] == q] for q in (0, 1)}
    if not by_class[0] or not by_class[1]:
        n = len(by_class[0]) + len(by_class[1])
        return Model(b"", b"", [], len(by_class[1]) / n if n else 0.5)
    halves = {q: (t[: max(1, len(t) // 2)], t[len(t) // 2 :]) for q, t in by_class.items()}
    model = Model(_dictionary(halves[1][0]), _dictionary(halves[0][0]), [])
    sizes = _Sizes(model)
    x = np.array([sizes.features(t) for q in (0, 1) for t in halves[q][1]])
    y = np.array([q for q in (0, 1) for _ in halves[q][1]], float)
    model.weights = _logistic(x, y)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted, difference)`` for every document."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = None if model.constant is not None else _Sizes(model)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            pairs = [(0.0, 0.0) if sizes is None else sizes.features(t.as_py() or b"") for t in texts]
            x = np.array(pairs, float).reshape(-1, 2)
            if sizes is None:
                p = np.full(len(x), model.constant)
            else:
                p = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x[:, 0])], ["doc_id", "score", "difference"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(scores, f"doc_id {kind}, score double, difference double")
    return rows.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference"
    )
