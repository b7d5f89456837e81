"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG of ``WIDTH`` columns under the SHA-256 of
its bytes. Each task appends its payloads to a tar file of its own in
the shared folder, a digest once in each file; the rows carry digest, shard,
offset and length of the PNG inside the tar. Width and height are filled from a
range read of the PNG's header alone; full reads fetch exactly one payload.

A file is named by its task attempt and only the rows of a committed attempt name
it, so a lost executor leaves at most an unused file. Texts are not shuffled.

A null text is the empty text; texts are padded with spaces to a positive multiple
of ``WIDTH`` bytes. Equal texts give equal values. Repeated rows share a payload.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, slices, text_bytes
from .storage import Store, attempt_name

WIDTH = 192
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk.
HEADER_BYTES = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">II", header[16:24])


def decode_png(data: bytes) -> bytes:
    """Samples of a PNG as ``encode_png`` makes it; its checksums are tested."""
    width, height = png_size(data[:HEADER_BYTES])
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a PNG filter other than 0")
    return lines[:, 1:].tobytes()


class _Shard:
    """A tar file of this task attempt, and the places of the digests in it."""

    def __init__(self, store: Store, number: int):
        self.name = f"{attempt_name('media')}-{number}.tar"
        self.out, self.at, self.places = store.create(self.name), 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head)
            self.out.write(data)
            self.out.write(b"\0" * (-len(data) % 512))
            self.places[digest] = self.at + len(head), len(data)
            self.at += len(head) + len(data) + -len(data) % 512
        return self.places[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store(docs: DataFrame, root: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_bytes, digest, shard, offset, length; written at once."""
    Store(root).make()
    columns = [c for c in docs.columns if c not in (text, "n_bytes", "digest", "shard", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, shard, number = Store(root), None, 0
        for batch in slices(batches):
            rows = []
            for raw in text_bytes(batch.column(text)):
                payload = payload_of(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if shard is None or shard.at > SHARD_BYTES:
                    if shard:
                        shard.close()
                    shard, number = _Shard(target, number), number + 1
                place = shard.places.get(digest) or shard.add(digest, encode_png(payload))
                rows.append((len(raw), digest, shard.name, *place))
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *found],
                names=[*columns, "n_bytes", "digest", "shard", "offset", "length"],
            )
        if shard:
            shard.close()

    added = {"n_bytes": "bigint", "digest": "string", "shard": "string", "offset": "bigint", "length": "bigint"}
    schema = docs.select(*columns).withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema
    return materialize(docs.select(*columns, text).mapInArrow(run, schema), "media-rows")


class _Reader:
    """Range reads; the shard last used stays open."""

    def __init__(self, root: str):
        self.store, self.name, self.file = Store(root), None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.store.open(name)
        self.file.seek(offset)
        return self.file.read(length)


def with_size(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` with width and height, from header-only range reads."""
    columns = [c for c in rows.columns if c not in ("width", "height")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(root)
        for batch in batches:
            places = zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)
            sizes = [png_size(reader.read(name, at, HEADER_BYTES)) for name, at in places]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1))],
                names=[*columns, "width", "height"],
            )

    schema = rows.select(*columns).withColumns({c: F.lit(None).cast("bigint") for c in ("width", "height")}).schema
    return rows.select(*columns).mapInArrow(run, schema)


def describe(payload: bytes, width: int, height: int) -> str:
    """Samples' size, mean, standard deviation, distinct values and entropy."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    n, at = len(payload), np.arange(256)
    mean = float((counts * at).sum()) / n
    deviation = (float((counts * at * at).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    return f"{width}x{height} mean={mean:.4f} sd={deviation:.4f} values={len(p)} bits={float(-(p * np.log2(p)).sum()):.4f}"


def report(docs: DataFrame, root: str | None = None) -> DataFrame:
    """One row per document: what is stored, and what the stored bytes give when read back."""
    root = root or fresh_path(docs.sparkSession, "media")
    rows = store(docs.select("doc_id", "text"), root)
    # the rows are few bytes, what they point to is not: a task for each shard, in the shard's order
    shards = rows.select("shard").distinct().count()
    rows = rows.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "offset")
    rows = with_size(rows, root)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = _Reader(root), {}
        for batch in slices(batches):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "width", "height")]
            for digest, name, at, length, width, height in zip(*columns, strict=True):
                if digest not in known:
                    if len(known) > 20_000:
                        known.clear()
                    media = reader.read(name, at, length)
                    payload = decode_png(media)
                    known[digest] = (
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                        len(media), hashlib.sha256(media).hexdigest(), describe(payload, width, height),
                    )
                out.append(known[digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)),
                 batch.column("digest"), batch.column("shard"), batch.column("offset"), batch.column("length"),
                 pa.array([root] * batch.num_rows, pa.string())],
                names=["doc_id", "n_bytes", *names, "digest", "shard", "offset", "length", "folder"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string, digest string, shard string, offset long, length long, folder string"
    )
    return rows.mapInArrow(run, schema)
