"""Follow-the-regularised-leader logistic regression over hashed text features.

The labels are joined to the documents by id, a bounded sample of the labelled
ids is turned into sparse rows on the executors, one task runs FTRL-proximal over
them, and only the non-zero weights travel: they are broadcast (at most
2**BITS entries, whatever the corpus) and every document is scored as a sparse
dot product in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

BITS = 20
#: A feature function: texts -> (feature of each occurrence, text it occurs in, features' scale per text)
Features = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate rates alpha / (beta + sqrt(sum g^2)), L1 for sparsity, L2.

    ``max_rows`` bounds the labelled sample (the first rows by a hash of the id).
    """

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.1
    epochs: int = 3
    max_rows: int = 12_000
    binary: bool = False


def rows_of(features: Features, texts: list[bytes], binary: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and their values."""
    ids, owner, scale = features(texts)
    keys, counts = np.unique((owner.astype(np.int64) << BITS) | ids, return_counts=True)
    doc = keys >> BITS
    values = (np.ones(len(keys)) if binary else counts * scale[doc]).astype(np.float32)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    ids = (keys & ((1 << BITS) - 1)).astype(np.int32)
    return [(ids[a:b], values[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], model: Ftrl) -> np.ndarray:
    """Weights of 2**BITS features, and the bias last."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    for _ in range(model.epochs):
        for (ids, values), label in zip(rows, labels, strict=True):
            at, x = np.append(ids, bias), np.append(values, np.float32(1)).astype(np.float64)
            w = _weights(z[at], n[at], model)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / model.alpha * w
            n[at] = new
    return _weights(z, n, model).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray, model: Ftrl) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - model.l1, 0)
    return -shrunk / ((model.beta + np.sqrt(n)) / model.alpha + model.l2)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, features: Features, model: Ftrl) -> np.ndarray:
    """Weights from the labelled rows for which ``learn`` (over doc_id) holds.

    Rows with a null id or label are passed over; a repeated id takes its largest label and,
    of its texts, the one with the least hash. Without labelled rows all weights are
    0, so every score is 0.5.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(model.max_rows)
    )
    # at most max_rows rows, however often an id stands in the documents
    sample = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    sample = sample.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_label").alias("_label"))
    sample = sample.select(F.xxhash64("_id").alias("_order"), "text", "_label")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = rows_of(features, text_bytes(batch.column("text")), model.binary)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_order"),
                    batch.column("_label"),
                    pa.array([i for i, _ in rows], pa.list_(pa.int32())),
                    pa.array([v[:0] if model.binary else v for _, v in rows], pa.list_(pa.float32())),
                ],
                names=["_order", "_label", "ids", "vals"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, targets = [], []
        for batch in batches:
            ids, values = batch.column("ids"), batch.column("vals")
            for i in range(batch.num_rows):
                at = ids[i].values.to_numpy()
                rows.append((at, np.ones(len(at)) if model.binary else values[i].values.to_numpy()))
            targets += batch.column("_label").to_pylist()
        w = fit_rows(rows, targets, model)
        at = np.flatnonzero(w).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
    rows = sample.mapInArrow(sparse, "_order long, _label int, ids array<int>, vals array<float>")
    # at most max_rows sparse rows: one task takes them in the order of a hash
    one = rows.repartition(1).sortWithinPartitions("_order", "_label", "ids")
    for r in one.mapInArrow(train, "at int, w float").toLocalIterator():
        weights[r.at] = r.w
    return weights


def score_texts(texts: list[bytes], features: Features, weights: np.ndarray, binary: bool) -> np.ndarray:
    ids, owner, scale = features(texts)
    w = weights[ids]
    at = np.flatnonzero(w)  # L1 leaves few
    ids, owner, w = ids[at], owner[at].astype(np.int64), w[at]
    if binary:
        _, first = np.unique((owner << BITS) | ids, return_index=True)
        owner, w = owner[first], w[first]
    total = np.bincount(owner, weights=w, minlength=len(texts))
    total = weights[-1] + (total if binary else total * scale)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def add_score(docs: DataFrame, weights: np.ndarray, features: Features, binary: bool, name: str = "score") -> DataFrame:
    """``docs`` and their score (in place of a column so named), in one narrow pass.

    The weights that are not 0 are sent, with their places.
    """
    places = np.flatnonzero(weights).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((places, weights[places]))
    columns = [c for c in docs.columns if c != name]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << BITS) + 1, dtype=np.float32)
        own[sent.value[0]] = sent.value[1]
        for batch in slices(batches, 512):
            found = score_texts(text_bytes(batch.column("text")), features, own, binary)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found)], names=[*columns, name])

    kept = docs.select(*columns)
    schema = kept.withColumn(name, F.lit(0.0)).schema
    return kept.mapInArrow(score, schema)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of parallel 64-bit hashes, order kept."""
    out = np.array([0x27D4EB2F165667C5], dtype=np.uint64)
    for part in parts:
        out = (out ^ np.uint64(part) if isinstance(part, int) else out ^ part) * _M1
        out = (out ^ (out >> np.uint64(31))) * _M2
    return out


def fold(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)
