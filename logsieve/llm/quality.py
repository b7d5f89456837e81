"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Tokens are words (letters and digits, A-Z lower-cased) and runs of the same
other character. Features are token unigrams and bigrams and 1- to 3-grams of
token shapes (case, digits, the character of a run, or that the token repeats the
one or two before it), each as the share of the text's tokens, so that length
does not decide. Labels, language, source and id are not inputs.

Null and empty texts have no features: their score is the bias alone.
Very long texts are scored whole. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, memo, remainder, unused
from .ftrl import Ftrl, add_score, fit, fold, mix

FOLDS = 5
THRESHOLD = 0.3
MODEL = Ftrl(alpha=0.5, l1=0.05, l2=0.01, epochs=3, max_rows=12_000)

#: A word, or a run of up to three of one other character.
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|([^\s0-9A-Za-z\x80-\xff])\1{0,2}")
_SCALE = 10.0
#: The hashes of the tokens of a chunk between white space are kept by each worker, packed.
_KEPT, _LONGEST = 300_000, 64


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _shape(word: bytes) -> bytes:
    if word[0] < 128 and not word.isalnum():
        return b"p" + word[:1]
    if word.isdigit():
        return b"0"
    upper, lower = word != word.lower(), word != word.upper()
    return b"x" if not upper else b"X" if len(word) == 1 else b"Xx" if lower else b"XX"


def _packed(chunk: bytes) -> bytes:
    """Hashes of each token's lower-cased form and of its shape."""
    found = []
    for m in _TOKEN.finditer(chunk):
        found += [_hash(m[0].translate(LOWER)), _hash(b"\0" + _shape(m[0]))]
    return struct.pack(f"<{len(found)}Q", *found)


def _look_up(chunks: list[bytes]) -> list[bytes]:
    seen = memo("quality")
    found = list(map(seen.get, chunks))
    if None in found:
        if len(seen) > _KEPT:
            seen.clear()
        for i, x in enumerate(found):
            if x is None:
                found[i] = _packed(chunks[i])
                if len(chunks[i]) <= _LONGEST:
                    seen[chunks[i]] = found[i]
    return found


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [b"".join(_look_up(text.split())) for text in texts]
    both = np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(-1, 2)
    counts = [len(x) // 16 for x in rows]
    n = np.array(counts, dtype=np.int64)
    word, shape = both[:, 0].copy(), both[:, 1].copy()
    owner = np.repeat(np.arange(len(texts)), n)
    total = len(word)
    first = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(total) - first
    for back in (2, 1):
        same = np.zeros(total, dtype=bool)
        same[back:] = (word[back:] == word[:-back]) & (place[back:] >= back)
        shape[same] = np.uint64(back)
    ids, owners = [fold(mix(1, word)), fold(mix(2, shape))], [owner, owner]
    for tag, size, tokens in ((3, 2, word), (4, 2, shape), (5, 3, shape)):
        if total < size:
            continue
        inside = place[size - 1 :] >= size - 1
        grams = mix(tag, *(tokens[i : total - size + 1 + i][inside] for i in range(size)))
        ids.append(fold(grams))
        owners.append(owner[size - 1 :][inside])
    return np.concatenate(ids), np.concatenate(owners), _SCALE / np.maximum(n, 1)


def train(docs: DataFrame, labels: DataFrame, model: Ftrl = MODEL, folds: int = FOLDS) -> np.ndarray:
    """Weights from the labelled documents outside fold 0."""
    return fit(docs, labels, "quality", remainder("doc_id", folds) != 0, features, model)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    return add_score(docs, weights, features, MODEL.binary, name)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights = train(docs, labels)
    return score(docs.select("doc_id", "text"), weights).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, as they were."""
    (name,) = unused(docs, "_quality")
    scored = score(docs, train(docs, labels), name)
    return scored.where(F.col(name) >= threshold).select(*docs.columns)
