"""Scores of whole texts by a gated recurrent language model (``gru``).

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end of text.
Training texts are those outside the held-out fold.

1. All training tokens are counted; the counts stay a table that grows with the
   corpus. Words above a count, at most ``KNOWN`` of them, are sent to the executors.
   The most frequent ones are the model's own words; the rest fall into tail
   classes by their last three bytes.
2. One task makes a first model of at most ``WARM_ROWS`` training texts; then each
   partition goes on training it on all of its training texts, and the models' weights are
   averaged by tokens in two steps (each task adds up a stream of models).
3. Every text is scored whole, its state carried from window to window. A word of
   a tail class has the class's probability times its share of the class's
   training tokens, smoothed as the base score is: (c + 0.5) / (N_k + 0.5 (V_k + 1)).
   Counts of the words that were not sent are joined to the texts that hold them.

Words of over 64 bytes are known by a digest. A null or empty text is its end alone.
Repeated rows are scored each for itself; a null id is in the fold of the empty text.
Without training texts all counts are 0 and the model is its starting point.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import LOWER, materialize, remainder, scratch, slices, text_bytes, unused

FOLDS, HELD_OUT = 5, 1
#: Bounds: words sent to the executors, and texts of the first model.
KNOWN, WARM_ROWS = 100_000, 2_000
END = b""
_LONGEST = 64
_DISTINCT, _TOGETHER = 300_000, 3_000_000


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(LOWER).split()
    if words and max(map(len, words)) > _LONGEST:
        # 0xff is in no UTF-8 text
        words = [w if len(w) <= _LONGEST else b"\xff" + xxhash.xxh3_128_digest(w) for w in words]
    return words


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % gru.TAILS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"]
        )
        found.clear()
        return out

    for batch in slices(batches):
        for text in text_bytes(batch.column("text")):
            found.update(words_of(text))
            found[END] += 1
            if len(found) > _DISTINCT:
                yield flush()
    yield flush()


class Known:
    """What the executors know of the counts: the sent words and the tail classes' totals."""

    def __init__(self, rows: list[tuple[bytes, int]], total: int, distinct: int, tails: dict[int, tuple[int, int]]):
        rows = sorted(rows, key=lambda r: (r[0] != END, -r[1], r[0]))
        self.total, self.distinct = total, distinct
        self.index = {w: i for i, (w, _) in enumerate(rows)}
        ends = END in self.index
        if not ends:  # no training text: the end is known to the model all the same
            rows, self.index = [(END, 0)] + rows, {END: 0} | {w: i + 1 for w, i in self.index.items()}
        c = np.array([r[1] for r in rows], dtype=np.float64)
        self.seen = c > 0
        self.logs = np.log10(c + 0.5)
        self.ids = np.array([i if i < gru.HEAD else gru.HEAD + tail_of(w) for i, (w, _) in enumerate(rows)], dtype=np.int16)
        n, v = np.zeros(gru.TAILS), np.zeros(gru.TAILS)
        for k, (count, words) in tails.items():
            n[k], v[k] = count, words
        for w, count in rows[: gru.HEAD]:  # the model's own words are in no tail class
            if count:
                n[tail_of(w)] -= count
                v[tail_of(w)] -= 1
        self.share = np.log10(n + 0.5 * (v + 1))
        head = np.zeros(gru.HEAD)
        head[: min(gru.HEAD, len(c))] = c[: gru.HEAD]
        self.frequencies = np.concatenate([head, n])

    def look_up(self, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, their places among the sent ones (-1: not sent), token ids; the end included."""
        words = words_of(text)
        words.append(END)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        ids = self.ids[at]
        for i in np.flatnonzero(at < 0).tolist():
            ids[i] = gru.HEAD + tail_of(words[i])
        return words, at, ids


def count_words(training: DataFrame) -> DataFrame:
    """(word, c) of all training tokens; the end of text is the empty word."""
    parts = training.select("text").mapInArrow(_count, "word binary, c long")
    return materialize(parts.groupBy("word").agg(F.sum("c").alias("c")), "words")


def known_of(counts: DataFrame, most: int = KNOWN) -> Known:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # eighths of powers of two: a few hundred levels whatever the corpus
    level = F.floor(8 * F.log2(F.col("c").cast("double")))
    limit, taken = 1 << 62, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if taken + row["count"] > most:
            break
        limit, taken = row["level"], taken + row["count"]
    sent = counts.where((level >= limit) | (F.col("word") == F.lit(END)))
    tail = F.crc32(F.expr("substring(word, -3, 3)")) % gru.TAILS
    tails = counts.groupBy(tail.alias("k")).agg(F.sum("c"), F.count("*")).collect()
    rows = [(bytes(r.word), r.c) for r in sent.toLocalIterator()]
    return Known(rows, total, distinct, {r[0]: (r[1], r[2]) for r in tails})


_MODEL = "weights binary, squares binary, tokens long"


def _model_row(flat: np.ndarray, squares: np.ndarray, tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([flat.tobytes()], pa.binary()), pa.array([squares.tobytes()], pa.binary()), pa.array([tokens], pa.int64())],
        names=["weights", "squares", "tokens"],
    )


def _learn(known, before, rate: float):
    """Train on a partition's texts, from ``before`` (weights, squares) or the starting point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        flat, squares = before.value if before else (gru.start(words.frequencies), None)
        trainer = gru.Trainer(flat, squares, rate)
        texts: list[np.ndarray] = []
        size = 0
        for batch in slices(batches):
            for text in text_bytes(batch.column("text")):
                ids = words.look_up(text)[2]
                texts.append(ids)
                size += len(ids)
            if size > _TOGETHER:
                trainer.learn(texts)
                texts, size = [], 0
        if texts:
            trainer.learn(texts)
        if trainer.tokens:
            yield _model_row(trainer.flat, trainer.sum, trainer.tokens)

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token-weighted mean of a stream of models."""
    weights, squares, tokens = np.zeros(gru.SIZE), np.zeros(gru.SIZE), 0
    for batch in batches:
        for row in batch.to_pylist():
            n = row["tokens"]
            weights += n * np.frombuffer(row["weights"], dtype=np.float32).astype(np.float64)
            squares += n * np.frombuffer(row["squares"], dtype=np.float32).astype(np.float64)
            tokens += n
    if tokens:
        yield _model_row((weights / tokens).astype(np.float32), (squares / tokens).astype(np.float32), tokens)


def train(training: DataFrame, known, warm_rows: int = WARM_ROWS) -> np.ndarray:
    """Weights learned from all of ``training`` (doc_id, text)."""
    context = training.sparkSession.sparkContext
    chosen = training.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(warm_rows)
    few = training.join(F.broadcast(chosen.distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # of a repeated id one text, so that they are not more than warm_rows
    few = few.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = few.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    first = one.select("text").mapInArrow(_learn(known, None, 0.1), _MODEL).collect()
    if not first:
        return gru.start(known.value.frequencies)
    pair = tuple(np.frombuffer(bytes(x), dtype=np.float32) for x in (first[0].weights, first[0].squares))
    with scratch(training.sparkSession):
        models = materialize(training.select("text").mapInArrow(_learn(known, context.broadcast(pair), 0.1), _MODEL), "models")
        some = max(1, math.isqrt(models.count()))
        mean = models.repartition(some).mapInArrow(_average, _MODEL).repartition(1).mapInArrow(_average, _MODEL).collect()
    return np.frombuffer(bytes(mean[0].weights), dtype=np.float32)


def _score(known, weights, columns: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = known.value, weights.value
        part, row = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        texts, facts, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal row
            scores = gru.score(flat, texts) / math.log(10)
            at = 0
            for batch in held:
                mine = facts[at : at + batch.num_rows]
                found = scores[at : at + batch.num_rows] + np.array([f[3] for f in mine])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in columns),
                        pa.array((part << 33) + row + np.arange(batch.num_rows)),
                        pa.array([f[0] for f in mine], pa.int64()),
                        pa.array([f[1] for f in mine], pa.int64()),
                        pa.array([f[2] for f in mine], pa.float64()),
                        pa.array(found, pa.float64()),
                        pa.array([f[4] for f in mine], pa.list_(pa.binary())),
                        pa.array([f[5] for f in mine], pa.list_(pa.int32())),
                    ],
                    names=[*columns, *added],
                )
                at += batch.num_rows
                row += batch.num_rows
            held.clear()
            texts.clear()
            facts.clear()

        for batch in slices(batches):
            for text in text_bytes(batch.column("text")):
                tokens, at, ids = words.look_up(text)
                sent = at >= 0
                places, tail = at[sent], ids >= gru.HEAD
                logs = np.where(sent, words.logs[at], 0.0)
                left = Counter(tokens[i] for i in np.flatnonzero(~sent).tolist())
                static = float(logs[tail].sum() - words.share[ids[tail] - gru.HEAD].sum())
                texts.append(ids)
                facts.append((len(tokens), int(words.seen[places].sum()), float(logs.sum()), static, list(left), list(left.values())))
                size += len(ids)
            held.append(batch.select(columns))
            if size > _TOGETHER:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def score(docs: DataFrame, counts: DataFrame, known: Known, weights: np.ndarray) -> DataFrame:
    """``docs`` (without text) and n_tokens, n_known, train_tokens, base_score, score, which replace columns so named."""
    context = docs.sparkSession.sparkContext
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    columns = [c for c in docs.columns if c != "text" and c not in results]
    kinds = ("bigint", "bigint", "bigint", "double", "double", "array<binary>", "array<int>")
    added = unused(docs, "_row", "_tokens", "_known", "_base", "_model", "_words", "_times")
    row, n_tokens, n_known, base, model, words, times = added
    schema = docs.select(*columns).withColumns({c: F.lit(None).cast(t) for c, t in zip(added, kinds, strict=True)}).schema
    run = _score(context.broadcast(known), context.broadcast(weights), columns, added)
    rows = materialize(docs.select(*columns, "text").mapInArrow(run, schema), "scores")
    # words that were not sent are rare, so no join key is hot
    pairs = F.arrays_zip(F.col(words).alias("word"), F.col(times).alias("times"))
    rare = rows.select(F.col(row).alias("at"), F.explode(pairs).alias("x")).select("at", "x.word", "x.times")
    found = rare.join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    at, more, more_known = unused(rows, "_at", "_more", "_more_known")
    sums = found.groupBy(F.col("at").alias(at)).agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias(more),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias(more_known),
    )
    out = rows.drop(words, times).join(sums, F.col(row) == F.col(at), "left")
    more = F.coalesce(more, F.lit(0.0))
    scale = math.log10(known.total + 0.5 * (known.distinct + 1))
    return out.select(
        *columns,
        F.col(n_tokens).alias("n_tokens"),
        (F.col(n_known) + F.coalesce(more_known, F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col(base) + more - F.col(n_tokens) * F.lit(scale)).alias("base_score"),
        (F.col(model) + more).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    held_out = remainder("doc_id", FOLDS) == HELD_OUT
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out)
    counts = count_words(training)
    known = known_of(counts)
    weights = train(training, docs.sparkSession.sparkContext.broadcast(known))
    found = score(docs, counts, known, weights)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
