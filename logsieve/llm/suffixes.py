"""Removal of byte strings that repeat anywhere in a corpus, by blockwise suffix sorting.

Every byte that a string of ``LENGTH`` bytes covers goes when that string also starts
at another place, in the same text or another one. Strings never cross texts.

*Buckets.* A string (window) is put down to one *anchor*: the first of its
``GRAM``-byte grams with the least hash. Equal windows have equal anchors at equal
offsets, so windows can only be equal within one anchor's bucket, and an
anchor owns a run of consecutive windows, a *record*. Buckets with one record are
done. Records that are equal as a whole are counted and need no sorting.

*Blockwise sort.* The suffixes of the other records are sorted one bucket after another,
several small buckets at a time, to depth ``LENGTH``. A bucket above ``BLOCK`` bytes is
split first, by halves of its offsets and by the bytes that all windows of a half
have in common, until the parts fit; at one offset these bytes are the whole window. A block
is laid out so that a window's place modulo ``PERIOD`` follows from its offset to the anchor.
Ranks of the suffixes at a difference cover's places are made first, by doubling; suffixes
that tie after ``PERIOD`` bytes are then told apart by the ranks of the cover
places that lie at equal distances in both. Memory follows the block, not the
corpus.

*Where things are.* The input is written once with a key for each row (the writing
partition and the row in it), and all passes read that copy; texts are never shuffled. What a
pass over a partition's texts needs is written in the shared folder, for each ``2 ** _PIECE`` texts
of a partition, and read by the tasks that meet their rows. A bucket of over ``LIMIT`` distinct records
is not gathered in a task: its windows are counted by 128-bit digests.

A null or empty text has no bytes. Texts below ``LENGTH`` bytes keep all. Repeated
rows are copies of one another, so of long enough ones nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, scratch, slices, text_bytes, wrote
from .storage import Store

LENGTH, GRAM = 200, 32
#: A perfect difference cover: every difference modulo 13 is one of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
DEPTH = 8 * PERIOD
LIMIT = 32_768
#: Bytes of text that are worked on at a time: in the pass over all texts, and in a sort.
MOST, BLOCK = 1 << 20, 1 << 20
_SPAN = LENGTH - GRAM + 1
#: Keys of texts that agree above so many bits have their rows in one file of a ``Side``.
_PIECE = 16
_POS = np.uint64((1 << 24) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a * _M1
    t ^= t >> np.uint64(32)
    t += b
    t *= _M2
    t ^= t >> np.uint64(29)
    return t


def records(data: bytes, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor and the anchor gram's hash of each record.

    ``owner``: each byte's text; windows across two texts are left out.
    """
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    x = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,)).astype(np.uint64)
    h = _pair(x[:-8], x[8:])
    h = _pair(h[:-16], h[16:])
    least = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _SPAN:
        least = np.minimum(least[: len(least) - (_SPAN - width)], least[_SPAN - width :])
    anchor = (least & _POS).astype(np.int64)
    inside = owner[: n - LENGTH + 1] == owner[LENGTH - 1 :]
    first = np.ones(len(anchor), dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (owner[1 : len(anchor)] != owner[: len(anchor) - 1])
    a = np.flatnonzero(first)
    b = np.append(a[1:], len(anchor)) - 1
    keep = inside[a]
    a, b = a[keep], b[keep]
    return a, b, anchor[a], h[anchor[a]]


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(keys, texts, segment start) of at most ``MOST`` bytes; a longer text comes in segments."""
    held, keys, size = [], [], 0
    for batch in slices(batches):
        for at, text in zip(batch.column("at").to_pylist(), text_bytes(batch.column("text")), strict=True):
            if held and size + len(text) > MOST:
                yield keys, held, 0
                held, keys, size = [], [], 0
            if len(text) > MOST:
                for start in range(0, len(text) - LENGTH + 1, MOST):
                    yield [at], [text[start : start + MOST + LENGTH - 1]], start
            else:
                held.append(text)
                keys.append(at)
                size += len(text)
    if held:
        yield keys, held, 0


def _emit_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for keys, texts, start in _blocks(batches):
        data = b"".join(texts)
        sizes = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        a, b, p, gram = records(data, owner)
        whole = np.array(
            [digest(data[i : j + LENGTH]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.uint64
        )
        text = owner[a] if len(a) else np.zeros(0, dtype=np.int32)
        begin = (np.cumsum(sizes) - sizes)[text] if len(a) else a
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(keys, dtype=np.int64)[text]),
                pa.array(p - begin + start),
                pa.array((a - p).astype(np.int16)),
                pa.array((b - p).astype(np.int16)),
                pa.array(gram.view(np.int64)),
                pa.array(whole.view(np.int64)),
            ],
            names=["at", "p", "lo", "hi", "gram", "whole"],
        )


class Side:
    """Rows by the key ``at`` of a text, written by Spark for each piece of a partition that wrote texts."""

    def __init__(self, rows: DataFrame, name: str):
        self.uri = fresh_path(rows.sparkSession, name)
        wrote(self.uri)
        part = F.shiftright("at", _PIECE).alias("part")
        # one file for each piece; its size follows that of the piece
        rows.select(part, "*").repartition("part").sortWithinPartitions("part", "at").write.option(
            "compression", "zstd"
        ).partitionBy("part").parquet(self.uri)


class _Places:
    """A task's view of some columns of a ``Side``; the rows of one piece are held at a time."""

    def __init__(self, side: Side, *columns: str):
        self.uri, self.names, self.part = side.uri, columns, None
        self.at, self.columns = np.zeros(0, dtype=np.int64), {}

    def _load(self, part: int) -> None:
        store = Store(f"{self.uri}/part={part}")
        try:
            names = [n for n in store.names() if n.endswith(".parquet")]
        except FileNotFoundError:
            names = []
        self.part, self.at, self.columns = part, np.zeros(0, dtype=np.int64), {}
        if not names:
            return
        # arrays once for a piece: a text's rows are a view of them, whatever the piece holds
        rows = pa.concat_tables([pq.read_table(store.open(n), columns=["at", *self.names]) for n in names])
        at = rows.column("at").to_numpy()
        order = None if np.all(at[:-1] <= at[1:]) else np.argsort(at, kind="stable")
        self.at = at if order is None else at[order]
        for c in self.names:
            values = rows.column(c).to_numpy()
            self.columns[c] = values if order is None else values[order]

    def of(self, at: int) -> list[np.ndarray] | None:
        """The columns of a text's rows; none if it has no rows."""
        if at >> _PIECE != self.part:
            self._load(at >> _PIECE)
        i, j = np.searchsorted(self.at, [at, at + 1]).tolist()
        return [self.columns[c][i:j] for c in self.names] if i < j else None


def _cut(side: Side):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(side, "gram", "whole", "lo", "hi", "p")
        for batch in slices(batches, 250):
            parts, found = [], []
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text"), strict=True):
                mine = places.of(at)
                if mine is None:
                    continue
                data = text.as_buffer().to_pybytes()
                lo, hi, p = (x.tolist() for x in mine[2:])
                found += [data[a + x : a + y + LENGTH] for a, x, y in zip(p, lo, hi, strict=True)]
                parts.append(mine[:4])
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=["gram", "whole", "lo", "hi", "text"])

    return run


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by parallel keys, first key first."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.int64)
    for key in keys[1:]:
        low = np.unique(key, return_inverse=True)[1].astype(np.int64)
        out = np.unique(out * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1].astype(np.int64)
    return out


def repeated_windows(texts: list[bytes], offsets: list[int], buckets: list[int]) -> list[np.ndarray]:
    """For each record, which of its windows also stands in another record of its bucket.

    ``offsets``: of each record's first window from the anchor. The record's windows
    are its suffixes with at least ``LENGTH`` bytes left.
    """
    # a record begins where its place modulo PERIOD is its offset's
    starts, parts, at = [], [], 0
    for text, offset in zip(texts, offsets, strict=True):
        gap = (offset - at) % PERIOD
        parts += [b"\0" * gap, text]
        starts.append(at + gap)
        at += gap + len(text)
    block = np.frombuffer(b"".join([*parts, b"\0" * (DEPTH + 4 * PERIOD)]), dtype=np.uint8)
    n = at
    # ranks by PERIOD bytes: two overlapping big-endian numbers
    word = np.ndarray((len(block) - 7,), dtype=">u8", buffer=block, strides=(1,)).astype(np.uint64)
    short = _rank(word[: n + DEPTH], word[PERIOD - 8 : n + DEPTH + PERIOD - 8])
    # ranks of the cover's suffixes by DEPTH bytes, doubling
    cover = np.flatnonzero(np.isin(np.arange(n + DEPTH) % PERIOD, COVER))
    place = np.full(n + 2 * DEPTH + PERIOD, -1, dtype=np.int64)
    place[cover] = np.arange(len(cover))
    rank, step = short[cover], PERIOD
    while step < DEPTH:
        later = place[cover + step]
        rank = _rank(rank, np.where(later >= 0, rank[later], -1))
        step *= 2
    to_cover = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    back = np.array([min((r - c) % PERIOD for c in COVER) for r in range(PERIOD)])

    counts = np.array([len(t) - LENGTH + 1 for t in texts])
    record = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    i = np.array(starts)[record] + inner
    offset = np.array(offsets)[record] + inner
    same = np.ones(len(i), dtype=bool)
    tie = _rank(np.array(buckets, dtype=np.int64)[record], offset)
    last = i + LENGTH - DEPTH
    for key in (
        short[i],  # the first PERIOD bytes
        rank[place[i + to_cover[i % PERIOD]]],  # then the cover place that follows
        rank[place[last - back[last % PERIOD]]],  # and the last one that ends inside
        short[i + LENGTH - PERIOD],  # and the bytes after it
    ):
        live = np.flatnonzero(same)
        tie[live] = _rank(tie[live], key[live])
        same[live] = np.bincount(tie[live])[tie[live]] > 1
    return np.split(same, np.cumsum(counts)[:-1]) if len(texts) else []


def _runs(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)


def _split(rows: list[dict], members: list[int], low: int, wide: int, masks: list[np.ndarray]):
    """Parts (members, low, wide) of a bucket's windows at offsets [low, low + wide) that fit a block.

    All windows that begin there have the bytes from the last offset to the end of the first
    window in common, so equal ones agree in them. Windows at one offset are then equal
    as a whole, and marked.
    """
    groups: dict[bytes, list[int]] = {}
    for m in members:
        lo, hi = rows[m]["lo"], rows[m]["hi"]
        if lo < low + wide and hi >= low:
            groups.setdefault(rows[m]["text"][low + wide - 1 - lo : low + LENGTH - lo], []).append(m)
    for group in groups.values():
        if len(group) == 1:
            continue
        if wide == 1:
            for m in group:
                masks[m][low - rows[m]["lo"]] = True
        elif len(group) * (wide + LENGTH - 1) <= BLOCK:
            yield group, low, wide
        else:
            yield from _split(rows, group, low, wide // 2, masks)
            yield from _split(rows, group, low + wide // 2, wide - wide // 2, masks)


def _repeated(rows: list[dict]) -> list[np.ndarray]:
    """For each record of whole buckets (rows in the order of ``gram``), which windows stand in another one too."""
    masks = [np.zeros(len(r["text"]) - LENGTH + 1, dtype=bool) for r in rows]
    held: list[tuple[int, int, int, int]] = []  # (bucket, record, first window's offset, last one's)
    size = number = 0

    def sort() -> None:
        texts = [rows[m]["text"][a - rows[m]["lo"] : b - rows[m]["lo"] + LENGTH] for _, m, a, b in held]
        for (_, m, a, b), mask in zip(held, repeated_windows(texts, [h[2] for h in held], [h[0] for h in held]), strict=True):
            masks[m][a - rows[m]["lo"] : b - rows[m]["lo"] + 1] |= mask
        held.clear()

    heads = [0, *(i for i in range(1, len(rows)) if rows[i]["gram"] != rows[i - 1]["gram"]), len(rows)]
    for i, j in zip(heads[:-1], heads[1:], strict=True):
        members = list(range(i, j))
        low, high = min(r["lo"] for r in rows[i:j]), max(r["hi"] for r in rows[i:j])
        fits = sum(len(r["text"]) for r in rows[i:j]) <= BLOCK
        parts = [(members, low, high - low + 1)] if fits else _split(rows, members, low, high - low + 1, masks)
        for group, first, wide in parts:
            spans = [(m, max(rows[m]["lo"], first), min(rows[m]["hi"], first + wide - 1)) for m in group]
            more = sum(b - a + LENGTH for _, a, b in spans)
            if held and size + more > BLOCK:
                sort()
                size = 0
            number += 1
            size += more
            held += [(number, m, a, b) for m, a, b in spans]
    if held:
        sort()
    return masks


_FOUND = "gram long, whole long, lo short, hi short, runs array<struct<x:int,y:int>>"


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by bucket -> the runs of repeated windows, as offsets from the anchor."""
    held: list[dict] = []

    def flush(upto: int) -> pa.RecordBatch:
        nonlocal held
        mine, held = held[:upto], held[upto:]
        out = []
        for r, mask in zip(mine, _repeated(mine), strict=True):
            if mask.any():
                runs = [{"x": int(a) + r["lo"], "y": int(b) - 1 + r["lo"]} for a, b in _runs(mask)]
                out.append((r["gram"], r["whole"], r["lo"], r["hi"], runs))
        kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["gram", "whole", "lo", "hi", "runs"]
        )

    for batch in slices(batches, 2000):
        held += batch.to_pylist()
        if sum(len(r["text"]) for r in held) >= BLOCK:
            # whole buckets only
            upto = next((i for i in range(len(held) - 1, 0, -1) if held[i]["gram"] != held[i - 1]["gram"]), 0)
            if upto:
                yield flush(upto)
    if held:
        yield flush(len(held))


def _digest_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        rows = batch.to_pylist()
        out = [
            (r["gram"], r["whole"], r["lo"], r["hi"], r["lo"] + i, xxhash.xxh3_128_digest(r["text"][i : i + LENGTH]))
            for r in rows
            for i in range(len(r["text"]) - LENGTH + 1)
        ]
        kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["gram", "whole", "lo", "hi", "d", "key"]
        )


def _finish(side: Side, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(side, "begin", "end")
        for batch in slices(batches, 250):
            out = []
            for at, text in zip(batch.column("at").to_pylist(), text_bytes(batch.column("text")), strict=True):
                mine, runs = places.of(at), []
                if mine is None:
                    out.append((len(text), text, runs))
                    continue
                begin, end = mine
                marks = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(marks, begin, 1)
                np.add.at(marks, end, -1)
                gone = np.cumsum(marks[:-1]) > 0
                raw = np.frombuffer(text, dtype=np.uint8)
                out.append((len(text), raw[~gone].tobytes(), _runs(gone).tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in columns),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.binary()),
                    pa.array([o[2] for o in out], pa.list_(pa.list_(pa.int64()))),
                ],
                names=[*columns, "n_bytes", "kept_bytes", "removed"],
            )

    return run


def find_repeats(texts: DataFrame) -> DataFrame:
    """``texts`` (at, text), a written table -> (at, begin, end): byte ranges to remove."""
    found = materialize(
        texts.mapInArrow(_emit_records, "at long, p long, lo short, hi short, gram long, whole long"), "records"
    )
    often = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    shared = materialize(found.join(often, "gram"), "shared")
    key = ["gram", "whole", "lo", "hi"]
    groups = materialize(
        shared.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("at", "p")).alias("place")), "groups"
    )
    buckets = groups.groupBy("gram").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("single"))
    unsorted = groups.join(buckets.where("m > 1 and single > 0").select("gram", "m"), "gram")
    unsorted = unsorted.select(*key, "m", F.col("place.at").alias("at"), F.col("place.p").alias("p"))
    cut = texts.mapInArrow(_cut(Side(unsorted, "bucket-places")), "gram long, whole long, lo short, hi short, text binary")
    hot = buckets.where(F.col("m") > LIMIT).select("gram")
    if hot.isEmpty():
        cool, extra = cut, None
    else:
        cut = materialize(cut, "bucket-texts")
        cool = cut.join(hot, "gram", "left_anti")
        windows = cut.join(hot, "gram", "left_semi").mapInArrow(
            _digest_windows, "gram long, whole long, lo short, hi short, d int, key binary"
        )
        windows = materialize(windows, "windows")
        twice = windows.groupBy("d", "key").agg(F.count("*").alias("n")).where("n > 1").select("d", "key")
        extra = windows.join(twice, ["d", "key"]).select(*key, F.array(F.struct(F.col("d").alias("x"), F.col("d").alias("y"))).alias("runs"))
    partial = cool.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_buckets, _FOUND)
    whole = groups.where("n > 1").select(
        *key, F.array(F.struct(F.col("lo").cast("int").alias("x"), F.col("hi").cast("int").alias("y"))).alias("runs")
    )
    runs = whole.unionByName(partial) if extra is None else whole.unionByName(partial).unionByName(extra)
    ranges = shared.join(runs, key).select("at", "p", F.explode("runs").alias("r"))
    return ranges.select("at", (F.col("p") + F.col("r.x")).alias("begin"), (F.col("p") + F.col("r.y") + LENGTH).alias("end"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_bytes, kept_bytes (what is left) and removed (byte ranges).

    Columns of ``docs`` with these three names, or named ``at``, are left out.
    """
    columns = [c for c in docs.columns if c not in ("text", "n_bytes", "kept_bytes", "removed", "at")]
    # the key of a row is stored with it, so it does not matter how later passes split the table
    with scratch(docs.sparkSession) as tables:
        keyed = materialize(docs.select(*columns, "text", F.monotonically_increasing_id().alias("at")), "dedup-input")
        side = Side(find_repeats(keyed.select("at", "text")), "repeats")
        tables.keep(keyed, side.uri)
    added = {"n_bytes": "bigint", "kept_bytes": "binary", "removed": "array<array<bigint>>"}
    schema = docs.select(*columns).withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema
    return keyed.mapInArrow(_finish(side, columns), schema)


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
