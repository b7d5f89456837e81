"""Near-duplicates by b-bit MinHash with band candidates, confirmed on full sets.

A document's set is its distinct shingles of ``words`` consecutive words (A-Z
lower-cased, split at ASCII white space); a shorter text is one shingle, an empty
or null one has none and is linked with nothing. Two documents are linked when
100 * intersection >= ``percent`` * union.

1. One pass makes each document's minima under ``HASHES`` permutations. Bands of
   minima become bucket keys; of each minimum ``BITS`` low bits are kept, packed
   in bit planes.
2. Documents with equal sets are one class (a vertex), however many they are.
3. Classes in one bucket are candidates, and each meets its bucket's hub. Pairs far below
   the threshold by the collision-corrected estimate (5 standard errors) go; the rest are
   confirmed by their full shingle sets. A bucket whose classes are all linked with its hub
   is done: further links in it change nothing.
4. Classes of other buckets are joined on their rarest shingles (a prefix filter, which
   is exact; ``prefix.py``). Each list of classes again meets a hub first, and what each
   class lacks and has beside the hub bounds its likeness to all others; only pairs
   that the bounds leave open are compared. No list is ever expanded into all its pairs
   and none is cut.
5. Components by star contraction; all tables stay distributed.

Repeated rows fall into one class. A null id takes part; a class of null ids
alone has a null component. Bands are chosen so that a pair at the threshold is
missed with probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix
from .common import LOWER, materialize, memo, scratch, slices, text_bytes, unused
from .components import components
from .ftrl import mix

HASHES, BITS = 192, 2
_PLANE = HASHES // 64
_random = np.random.default_rng(20240229)
_A = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


@dataclass(frozen=True)
class Near:
    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """The longest bands that miss a pair at the threshold with probability below 1e-6."""
        s = self.percent / 100
        return max([1] + [r for r in range(1, 17) if (1 - s**r) ** (HASHES // r) < 1e-6])

    @property
    def least_estimate(self) -> float:
        s, c = self.percent / 100, 0.5**BITS
        p = s + (1 - s) * c
        return s - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - c)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    seen = memo("minhash")
    found = list(map(seen.get, tokens))
    if None in found:
        if len(seen) > 300_000:
            seen.clear()
        for i, h in enumerate(found):
            if h is None:
                found[i] = seen[tokens[i]] = xxhash.xxh3_64_intdigest(tokens[i])
    h = np.array(found, dtype=np.uint64)
    n = min(words, len(h))
    return np.unique(mix(n, *(h[i : len(h) - n + 1 + i] for i in range(n))))


def signature(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        part = np.multiply.outer(_A, x[at : at + 1024])
        part += _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sketch(near: Near):
    rows, bands = near.rows, HASHES // near.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, names, signatures = [], [], []
            for text in text_bytes(batch.column("text")):
                found = shingles(text, near.words)
                sizes.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                signatures.append(signature(found))
            sig = np.array(signatures, dtype=np.uint32).reshape(-1, HASHES)
            low = (sig * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            planes = [np.packbits((low >> np.uint32(b)) & np.uint32(1), axis=1).view(np.int64) for b in range(BITS)]
            wide = sig.astype(np.uint64)
            keys = np.stack(
                [mix(j + 1, *(wide[:, j * rows + i] for i in range(rows))) for j in range(bands)], axis=1
            ).view(np.int64)
            some = np.array(sizes) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("digest"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(list(np.concatenate(planes, axis=1)), pa.list_(pa.int64())),
                    pa.array([k if s else k[:0] for k, s in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "n_shingles", "v", "planes", "bands"],
            )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingles(x, words) for x in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["v", "items"],
            )

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two rows of bit planes, corrected for chance collisions."""
    differ = [
        reduce(
            lambda x, y: x.bitwiseOR(y),
            [a[plane * _PLANE + i].bitwiseXOR(b[plane * _PLANE + i]) for plane in range(BITS)],
        )
        for i in range(_PLANE)
    ]
    equal = 1 - reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ]) / F.lit(float(HASHES))
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirm(pairs: DataFrame, planes: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) that are linked: by the estimate first, then by their full sets."""
    close = (
        _ordered(pairs)
        .join(planes.select(F.col("v").alias("a"), F.col("planes").alias("pa")), "a")
        .join(planes.select(F.col("v").alias("b"), F.col("planes").alias("pb")), "b")
        .where(estimate(F.col("pa"), F.col("pb")) >= near.least_estimate)
        .select("a", "b")
    )
    both = (
        close.join(sets.select(F.col("v").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("v").alias("b"), F.col("items").alias("y")), "b")
        .withColumn("common", F.size(F.array_intersect("x", "y")))
    )
    union = F.size("x") + F.size("y") - F.col("common")
    return materialize(both.where(100 * F.col("common") >= near.percent * union).select("a", "b"), "links")


def _links(lists: DataFrame, planes: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) that join all linked classes of the band lists (key, v) into components."""
    hubs = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("hub"))
    stars = materialize(lists.join(hubs.select("key", F.col("hub.v").alias("hub")), "key"), "stars")
    links = confirm(stars.select(F.col("v").alias("a"), F.col("hub").alias("b")), planes, sets, near)
    linked = links.withColumn("linked", F.lit(True))
    pair = stars.withColumns({"a": F.least("v", "hub"), "b": F.greatest("v", "hub")}).join(linked, ["a", "b"], "left")
    done = F.coalesce("linked", F.col("v") == F.col("hub"))
    open_ = pair.groupBy("key").agg(F.min(done).alias("done")).where("not done").select("key")
    classes = materialize(stars.join(open_, "key", "left_semi").select("v").distinct(), "open")
    if classes.isEmpty():
        return links
    more, pairs = prefix.candidates(sets.join(classes, "v", "left_semi"), near.percent)
    return links.unionByName(more).unionByName(confirm(pairs, planes, sets, near))


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _grouped(docs: DataFrame, near: Near, digests: bool) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and of each class v, first (its least id), row (its first row) and label (its component).

    The first row is the one with the least id, null last, then the least digest of
    its text; without ``digests`` the digest is null.
    """
    docs = docs.select("doc_id", "text", (_digest() if digests else F.lit(None).cast("binary")).alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = docs.mapInArrow(
        _sketch(near), f"doc_id {kind}, digest binary, n_shingles long, v binary, planes array<long>, bands array<long>"
    )
    rows = materialize(sketch, "sketch")
    classes = materialize(
        rows.where("n_shingles > 0")
        .groupBy("v")
        .agg(
            F.min("doc_id").alias("first"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row"),
            F.min_by("planes", "doc_id").alias("planes"),
            F.min_by("bands", "doc_id").alias("bands"),
            F.any_value("planes").alias("p0"),
            F.any_value("bands").alias("b0"),
        )
        .select("v", "first", "row", F.coalesce("planes", "p0").alias("planes"), F.coalesce("bands", "b0").alias("bands")),
        "classes",
    )
    members = classes.select("v", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    lists = materialize(members.join(shared, "key").select("key", "v"), "buckets")
    candidates = lists.select("v").distinct()
    planes = materialize(classes.select("v", "planes", "first").join(candidates, "v"), "planes")
    wanted = planes.select(F.col("first").alias("doc_id")).distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    sets = texts.select("text").mapInArrow(_full_sets(near.words), "v binary, items array<long>")
    sets = materialize(sets.join(candidates, "v", "left_semi").dropDuplicates(["v"]), "sets")

    links = _links(lists, planes.select("v", "planes"), sets, near)
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = labels.select(F.col("u").alias("v"), F.col("v").alias("label"))
    names = classes.select("v", "first", "row").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    return rows, names


def find(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, v (the class)."""
    with scratch(docs.sparkSession) as tables:
        rows, names = _grouped(docs, near, digests=False)
        least = names.groupBy("label").agg(F.min("first").alias("component_id"))
        names = materialize(names.join(least, "label").select("v", "component_id"), "names")
        tables.keep(rows, names)
    # a class may hold a third of all rows; the join is on it, and splits where it is skewed
    out = rows.select("doc_id", "n_shingles", "v").join(names, "v", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "v")


def report(docs: DataFrame, near: Near = Near()) -> DataFrame:
    found = find(docs, near)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_first(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id (null last), then the least text digest.

    Ids may be null or repeated. Of rows with the same id and text one stays, whichever
    it is. Rows without a word are linked with nothing and all stay.
    """
    with scratch(docs.sparkSession) as tables:
        rows, names = _grouped(docs, near, digests=True)
        first = names.groupBy("label").agg(F.min("row").alias("row")).select("row.doc_id", "row.digest")
        counts = rows.where("n_shingles > 0").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
        same = counts["doc_id"].eqNullSafe(first["doc_id"]) & (counts["digest"] == first["digest"])
        kept = materialize(counts.join(first, same, "left_semi"), "kept")
        tables.keep(kept)

    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    digest, key, text = unused(docs, "_digest", "_key", "_text")
    worded = docs.where(~blank).withColumn(digest, _digest())

    def of(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(key), F.col("digest").alias(text))
        same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(text))
        # what is held of a partition is an id and a digest for each of its documents
        return worded.join(keys.hint("shuffle_hash"), same, "left_semi")

    again = kept.where("n > 1")
    if again.isEmpty():
        out = of(kept)
    else:
        out = of(kept.where("n = 1")).unionByName(of(again).dropDuplicates(["doc_id", digest]))
    return out.select(*docs.columns).unionByName(docs.where(blank))
