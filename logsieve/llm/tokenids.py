"""Token ids in training order, as binary shards of fixed stride.

1. Each input partition is tokenised, its documents are joined by an
   end-of-text token and cut into sequences of ``length`` tokens (the last one of
   a partition is filled up). Sequences are written in compressed blocks.
2. Partition counts give every sequence a number below N. A keyed Feistel network
   with cycle-walking permutes [0, N): the result is the sequence's global slot.
3. Sequences go to the shard of their slot and are written there at
   (slot % per_shard) * stride, so reading in slot order is sequential and can be
   taken up again at any slot by a seek.

Blocks are compressed while they are moved; a shard (``per_shard`` sequences) is
the most that a task holds. Slots are spread evenly whatever the documents are. A
shard's file is named by its task attempt; the manifest of committed ones is a
table, so a lost executor leaves at most an unused file.

A null or empty text is one end-of-text token. Repeated rows are tokenised each
for itself; very long texts run over many sequences. Without rows there is no
sequence and no shard. The tokenizer's files are read where ``vocabulary`` says.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, memo, release, scratch, slices
from .storage import Store, attempt_name


@dataclass(frozen=True)
class Packing:
    """``vocabulary``: a file of byte pieces and ranks; ``end``: the end-of-text id."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    end: int = 50256
    length: int = 1024
    per_shard: int = 8192
    key: int = 20240229

    @property
    def stride(self) -> int:
        return 2 * self.length


# fixed values: the split pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLOCK = 256


class Tokenizer:
    """Byte-pair encoding of whole texts.

    Memories of words' ids were measured and left out: with many rare words they are slower.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids are written with 16 bits; the vocabulary has larger ones")
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as 16-bit little-endian numbers."""
        return np.array(self.own.encode_ordinary(text), dtype=np.uint16).tobytes()


def tokenizer(vocabulary: str) -> Tokenizer:
    """One for each worker process."""
    kept = memo("tokenids")
    if vocabulary not in kept:
        kept[vocabulary] = Tokenizer(vocabulary)
    return kept[vocabulary]


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of [0, n): a balanced Feistel network, walked until inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def mixed(x, k):
        x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & mask

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ mixed(left, k), left
            else:
                left, right = right, left ^ mixed(right, k)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


_SEQUENCES = "part int, first long, n int, tokens array<int>, first_doc array<{}>, docs array<int>, payload binary"


def _pack(packing: Packing):
    end = np.array([packing.end], dtype=np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(packing.vocabulary), TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=3)
        pending, size, number = bytearray(), packing.stride, 0
        heads: list[tuple] = []  # (byte at which a document begins, its id)
        kind = pa.null()

        def block(count: int, tokens: list[int]) -> pa.RecordBatch:
            nonlocal pending, heads, number
            starts = np.array([h[0] for h in heads], dtype=np.int64)
            edges = np.arange(count) * size
            low = np.searchsorted(starts, edges, side="right") - 1
            high = np.searchsorted(starts, edges + size, side="left")
            row = {
                "part": [part], "first": [number], "n": [count], "tokens": [tokens],
                "first_doc": [[heads[i][1] for i in low]], "docs": [(high - low).tolist()],
                "payload": [squeeze.compress(bytes(pending[: count * size]))],
            }
            del pending[: count * size]
            number += count
            last = np.searchsorted(starts, count * size, side="right") - 1
            heads = [(at - count * size, d) for at, d in heads[last:]]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(kind), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in slices(batches):
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                heads.append((len(pending), doc))
                pending += own.encode(text or "")
                pending += end
                while len(pending) >= _BLOCK * size:
                    yield block(_BLOCK, [packing.length] * _BLOCK)
        if pending:
            full, rest = divmod(len(pending), size)
            tokens = [packing.length] * full + ([rest // 2] if rest else [])
            if rest:
                pending += end * ((size - rest) // 2)
            yield block(len(tokens), tokens)

    return run


_MOVED = "shard long, slots array<long>, tokens array<int>, first_doc array<{}>, docs array<int>, payload binary"


def _deal(packing: Packing, n: int, hold: int = 16 << 20):
    """Blocks of sequences -> one compressed piece for each shard that they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            first = np.empty(sum(len(h[3]) for h in held), dtype=object)
            first[:] = [x for h in held for x in h[3]]
            slots = np.concatenate([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            tokens, docs = (np.concatenate([np.array(h[i], dtype=np.int32) for h in held]) for i in (2, 4))
            held.clear()
            order = np.argsort(slots)
            shards = slots[order] // packing.per_shard
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(order)]])
            parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(slots[p[0]]) // packing.per_shard for p in parts], pa.int64()),
                    pa.array([slots[p] for p in parts], pa.list_(pa.int64())),
                    pa.array([tokens[p] for p in parts], pa.list_(pa.int32())),
                    pa.array([first[p].tolist() for p in parts], kind),
                    pa.array([docs[p] for p in parts], pa.list_(pa.int32())),
                    pa.array([squeeze.compress(ids[p].tobytes()) for p in parts], pa.binary()),
                ],
                names=["shard", "slots", "tokens", "first_doc", "docs", "payload"],
            )

        size, kind = 0, None
        for batch in batches:
            kind = batch.schema.field("first_doc").type
            for row in batch.to_pylist():
                index = row["start"] + row["first"] + np.arange(row["n"])
                ids = np.frombuffer(expand.decompress(row["payload"]), dtype=np.uint16).reshape(-1, packing.length)
                held.append((permute(index, n, packing.key), ids, row["tokens"], row["first_doc"], row["docs"]))
                size += ids.nbytes
                if size >= hold:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        release()

    return run


_ROWS = "slot long, shard long, file string, byte_offset long, n_tokens int, first_doc_id {}, n_docs int, ids_sha256 string"


def _write(packing: Packing, n: int, root: str):
    """Pieces in order of shard -> shard files, and a row for each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, expand = Store(root), zstandard.ZstdDecompressor()
        now, data, about, kind = None, None, None, None

        def finish() -> pa.RecordBatch:
            if any(x is None for x in about):
                raise ValueError(f"shard {now} lacks sequences")
            name = f"{attempt_name(f'ids-{now:08d}')}.bin"
            with store.create(name) as out:
                out.write(data.data)
            base, k = now * packing.per_shard, len(about)
            with store.open(name) as back:  # what is stored is what is reported
                sums = [hashlib.sha256(back.read(packing.stride)).hexdigest() for _ in range(k)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(base, base + k)), pa.array([now] * k, pa.int64()), pa.array([name] * k),
                    pa.array(np.arange(k) * packing.stride), pa.array([a[0] for a in about], pa.int32()),
                    pa.array([a[1] for a in about], kind), pa.array([a[2] for a in about], pa.int32()), pa.array(sums),
                ],
                names=["slot", "shard", "file", "byte_offset", "n_tokens", "first_doc_id", "n_docs", "ids_sha256"],
            )

        for batch in batches:
            kind = batch.schema.field("first_doc").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["shard"] != now:
                    if now is not None:
                        yield finish()
                    now = row["shard"]
                    k = min(packing.per_shard, n - now * packing.per_shard)
                    data, about = np.zeros((k, packing.length), dtype=np.uint16), [None] * k
                at = np.array(row["slots"]) - now * packing.per_shard
                data[at] = np.frombuffer(expand.decompress(row["payload"]), dtype=np.uint16).reshape(-1, packing.length)
                for j, facts in zip(at.tolist(), zip(row["tokens"], row["first_doc"], row["docs"], strict=True), strict=True):
                    about[j] = facts
        if now is not None:
            yield finish()
        release()

    return run


def write_shards(docs: DataFrame, packing: Packing = Packing(), root: str | None = None, max_tasks: int = 20_000) -> DataFrame:
    """Write shards under ``root``; one row for each sequence, in its shard's order.

    The rows name their file and ``root``, where ``manifest.json`` has what a reader needs.
    ``first_doc_id`` has the ids' own type. ``max_tasks`` bounds the number of tasks, not of
    shards: a task then writes several.
    """
    spark = docs.sparkSession
    root = root or fresh_path(spark, "token-ids")
    Store(root).make()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    with scratch(spark) as tables:
        rows = _placed(source, kind, packing, root, max_tasks)
        tables.keep(rows)
    return rows


def _placed(source: DataFrame, kind: str, packing: Packing, root: str, max_tasks: int) -> DataFrame:
    blocks = materialize(source.mapInArrow(_pack(packing), _SEQUENCES.format(kind)), "sequences")
    # a row for each input partition
    counts = materialize(blocks.groupBy("part").agg(F.sum("n").alias("k")), "counts")
    n = counts.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    starts = counts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("start"))
    shards = max(1, -(-n // packing.per_shard))
    tasks = min(shards, max_tasks)
    moved = blocks.join(F.broadcast(starts), "part").mapInArrow(_deal(packing, n), _MOVED.format(kind))
    placed = moved.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)"))
    rows = placed.sortWithinPartitions("shard").mapInArrow(_write(packing, n, root), _ROWS.format(kind))
    # written once: reading the result again does not write the shards anew
    rows = materialize(rows.withColumn("folder", F.lit(root)), "shard-rows")
    with Store(root).create("manifest.json") as out:
        about = {**asdict(packing), "stride": packing.stride, "sequences": n, "shards": shards if n else 0, "id_bytes": 2}
        out.write(json.dumps(about, sort_keys=True).encode())
    return rows


def read_slots(manifest: DataFrame, root: str, start: int = 0, packing: Packing = Packing()) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) in order from ``start`` on: one seek, then sequential reads."""
    files = manifest.where(F.col("slot") >= start).groupBy("shard", "file").agg(F.max("slot").alias("last")).orderBy("shard")
    store = Store(root)
    for row in files.toLocalIterator():
        slot = max(start, row.shard * packing.per_shard)
        with store.open(row.file) as data:
            data.seek((slot - row.shard * packing.per_shard) * packing.stride)
            for at in range(slot, row.last + 1):
                yield at, np.frombuffer(data.read(packing.stride), dtype=np.uint16)


def report(docs: DataFrame, packing: Packing = Packing()) -> DataFrame:
    return write_shards(docs, packing)
