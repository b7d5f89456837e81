"""Toxicity: FTRL-proximal logistic regression over word n-grams and skip-grams.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
characters. Features are the presence of word unigrams, bigrams, trigrams and of
skip-grams (word pairs with one or two words between), hashed. Per-coordinate
rates let rare insults move fast while L1 keeps the weights that
are broadcast few. Labels, language, source and id are not inputs.

Null and empty texts have no features: their score is the bias alone.
Very long texts are scored whole. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memo, remainder
from .decontaminate import words_of
from .ftrl import Ftrl, add_score, fit, fold, mix

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
MODEL = Ftrl(alpha=2.0, l1=6.0, l2=0.1, epochs=6, max_rows=12_000, binary=True)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes: list[int] = []
    counts = []
    seen = memo("toxicity")
    get = seen.get
    for text in texts:
        words = words_of(text)
        found = list(map(get, words))
        if None in found:
            if len(seen) > 300_000:
                seen.clear()
            for i, h in enumerate(found):
                if h is None:
                    found[i] = seen[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        hashes += found
        counts.append(len(words))
    n = np.array(counts, dtype=np.int64)
    word = np.array(hashes, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), n)
    total = len(word)
    place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    ids, owners = [fold(mix(1, word))], [owner]
    for tag, offsets in ((2, (0, 1)), (3, (0, 1, 2)), (4, (0, 2)), (5, (0, 3))):
        size = offsets[-1] + 1
        if total < size:
            continue
        inside = place[size - 1 :] >= size - 1
        ids.append(fold(mix(tag, *(word[i : total - size + 1 + i][inside] for i in offsets))))
        owners.append(owner[size - 1 :][inside])
    return np.concatenate(ids), np.concatenate(owners), np.ones(len(texts))


def train(docs: DataFrame, labels: DataFrame, model: Ftrl = MODEL) -> np.ndarray:
    """Weights from the labelled documents outside the held-out fold."""
    return fit(docs, labels, "toxic", remainder("doc_id", FOLDS) != HELD_OUT, features, model)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    return add_score(docs, weights, features, MODEL.binary, name)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights = train(docs, labels)
    return score(docs.select("doc_id", "text"), weights).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
