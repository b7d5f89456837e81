"""Benchmark decontamination: a broadcast set of test n-grams scanned over documents.

Words are runs of ASCII letters (A-Z lower-cased), ASCII digits and non-ASCII
characters. A window is ``n`` consecutive words of one benchmark item; an item
of fewer words, but at least one, is a single window. A document word that lies
inside any occurrence of any window is *hit*. A document is contaminated when it
has a hit and the hit words make up ``share`` of its words.

The benchmark's windows go to the executors as one broadcast value. Its size is
measured first; a benchmark of more than ``block_bytes`` of text is scanned in
blocks of about that size, and each pass adds its hits to the rows' bit mask.
The scan is narrow: the texts are never shuffled, so no key can be hot.

Null, empty or wordless texts have no words and are clean. Repeated rows are
scanned each for itself. Benchmark rows with a null text have no windows; those
with a null id mark words but are not listed among the items.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, text_bytes, unused

N_WORDS = 13
#: A document is contaminated when 1 / SHARE_DIVISOR of its words are hit.
SHARE_DIVISOR = 20
BLOCK_BYTES = 8 << 20

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class WindowSet:
    """Windows of some items, by length: sorted hashes, where each window begins among all items' word ids, its item."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], n: int = N_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        parts, sizes = [], []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if words:
                self.names.append(item)
                parts.append(np.array(words, dtype=np.int32))
                sizes.append(len(words))
        self.ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        sizes = np.array(sizes, dtype=np.int64)
        heads = np.cumsum(sizes) - sizes
        self.tables = []
        for size in np.unique(np.minimum(sizes, n)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, n) == size)
            counts = sizes[mine] - size + 1
            owner = np.repeat(mine, counts).astype(np.int32)
            starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + heads[owner]
            hashes = self.hash_at(starts, size)
            order = np.lexsort((owner, hashes))
            hashes, starts, owner = hashes[order], starts[order], owner[order]
            # a window that an item repeats is there once
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            new[1:] |= (self.ids[starts[1:, None] + np.arange(size)] != self.ids[starts[:-1, None] + np.arange(size)]).any(axis=1)
            self.tables.append((size, hashes[new], starts[new], owner[new]))

    def hash_at(self, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        for i in range(size):
            out = (out ^ self.ids[starts + i].astype(np.uint64)) * _BASE
            out ^= out >> np.uint64(29)
        return out

    @staticmethod
    def hash(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.uint64)
        for column in keys.T:
            out = (out ^ column.astype(np.uint64)) * _BASE
            out ^= out >> np.uint64(29)
        return out

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """Word counts, a hit flag for each word of all texts in turn, items by text."""
        get, ids, counts = self.vocabulary.get, [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            ids.append(-1)
            ids.extend([get(w, -1) for w in words])
        ids.append(-1)
        ids = np.array(ids, dtype=np.int64)
        n = len(ids)
        at = np.arange(n)
        # last position at or before each one whose word no item has
        gap = np.maximum.accumulate(np.where(ids < 0, at, 0))
        marks = np.zeros(n + 1, dtype=np.int32)
        heads = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
        items: dict[int, set] = {}
        for size, hashes, windows, owner in self.tables:
            ends = np.flatnonzero(at - gap >= size)
            for part in np.array_split(ends, len(ends) // 200_000 + 1):
                starts = part - size + 1
                mine = self.hash(ids[starts[:, None] + np.arange(size)])
                low = np.searchsorted(hashes, mine, side="left")
                times = np.searchsorted(hashes, mine, side="right") - low
                # every window of the same hash: of other items, or another one
                found = np.repeat(starts, times)
                row = np.arange(len(found)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
                for some in np.array_split(np.arange(len(found)), len(found) // 200_000 + 1):
                    f, r = found[some], row[some]
                    ok = (ids[f[:, None] + np.arange(size)] == self.ids[windows[r][:, None] + np.arange(size)]).all(axis=1)
                    f, r = f[ok], r[ok]
                    np.add.at(marks, f, 1)
                    np.add.at(marks, f + size, -1)
                    docs = np.searchsorted(heads, f, side="right") - 1
                    for doc, item in np.unique(np.stack([docs, owner[r]], axis=1), axis=0).tolist():
                        items.setdefault(doc, set())
                        if self.names[item] is not None:
                            items[doc].add(self.names[item])
        hit = np.cumsum(marks[:n]) > 0
        return np.array(counts, dtype=np.int64), np.delete(hit, np.append(heads[:-1], n - 1)), items


def _runs(mask: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


#: Names of what is added to a row.
ADDED = ("_hits", "_items", "_n_words", "_n_hit")


def _scanner(windows, columns: list[str], added: tuple[str, ...]):
    """Adds what ``windows`` finds to the columns of hits (word ranges) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = windows.value
        for batch in slices(batches):
            counts, hit, items = found.scan(text_bytes(batch.column("text")))
            before = batch.column(added[0]).to_pylist(), batch.column(added[1]).to_pylist()
            ends = np.cumsum(counts)
            hits, names, total = [], [], []
            for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                mask = hit[end - n : end]
                if before[0][i]:
                    mask = mask.copy()
                    for a, b in before[0][i]:
                        mask[a:b] = True
                hits.append(_runs(mask) if mask.any() else [])
                names.append(sorted({*(before[1][i] or ()), *items.get(i, ())}))
                total.append(int(mask.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [
                    pa.array(hits, pa.list_(pa.list_(pa.int64()))),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(counts, pa.int64()),
                    pa.array(total, pa.int64()),
                ],
                names=[*columns, *added],
            )

    return run


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N_WORDS,
    block_bytes: int = BLOCK_BYTES,
    added: tuple[str, ...] = ADDED,
) -> DataFrame:
    """``docs`` and, under the names ``added``: hits (word ranges), items (sorted), number of words, of hit words.

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
    ).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    docs = docs.drop(*added)
    columns = docs.columns
    kinds = (T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType()), T.LongType(), T.LongType())
    schema = T.StructType(docs.schema.fields + [T.StructField(c, k) for c, k in zip(added, kinds, strict=True)])
    out = docs.withColumns({c: F.lit(None).cast(k) for c, k in zip(added[:2], kinds, strict=False)})
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        windows = WindowSet(((r.item, bytes(r.text)) for r in rows.toLocalIterator()), n)
        found = out.mapInArrow(_scanner(spark.sparkContext.broadcast(windows), columns, added), schema)
        # one block in memory at a time: a further pass starts from a written table
        out = materialize(found, "decontaminate").drop(*added[2:]) if block + 1 < blocks else found
    return out


def contaminated(n_hit, n_words, divisor: int = SHARE_DIVISOR):
    return (n_hit > 0) & (n_hit * divisor >= n_words)


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """The documents that are not contaminated, as they were."""
    added = tuple(unused(docs, *ADDED))
    keep = find_hits(docs, benchmark, n, added=added).where(~contaminated(F.col(added[3]), F.col(added[2])))
    return keep.select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """All documents, without the text from the first to the last word of each hit range."""

    @F.pandas_udf("string")
    def cut(texts, hits):
        def one(text, ranges):
            if text is None or ranges is None or not len(ranges):
                return text
            raw = text.encode()
            words = [m.span() for m in _WORD.finditer(raw)]
            out, at = [], 0
            for a, b in ranges:
                out.append(raw[at : words[a][0]])
                at = words[b - 1][1]
            return b"".join([*out, raw[at:]]).decode()

        return texts.combine(hits, one)

    added = tuple(unused(docs, *ADDED))
    found = find_hits(docs, benchmark, n, added=added)
    return found.select(*[cut("text", added[0]).alias(c) if c == "text" else c for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """One row per document: counts, the items' digest and the verdict."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, n)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        contaminated(F.col("_n_hit"), F.col("_n_words")).alias("contaminated"),
    )
