"""Token ids in files of shuffled planes.

A shard holds the ids of a run of documents in ascending ``doc_id`` order. Ids
are cut into blocks of a fixed size; each block is transposed into planes (byte
``k`` of every id, or bit ``k`` of every id), and each plane is compressed with
zstandard on its own. The footer is the chunk index: for each block its number
of ids and, for each plane, its compressed length; and each document's id and
number of tokens. So a reader can fetch any block without the others.

    magic | planes of block 0 | planes of block 1 | ... | footer | length of the footer (8 bytes) | magic
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.shared import filesystem, importable, new_folder, stored, work_dir
from siftlode.llm.tokenization import encoder

MAGIC = b"IDPLANE1"
#: Texts encoded at a time: characters.
BATCH = 6_000_000
MANIFEST = "shard long, path string, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of 32-bit ids, without the leading ones that are all zero."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(np.ascontiguousarray(bits[:, k])) for k in range(32)]
    while planes and not planes[-1].any():
        planes.pop()
    return [x.tobytes() for x in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, x in enumerate(planes):
            raw[:, k] = np.frombuffer(x, np.uint8)
    elif planes:
        bits = np.zeros((n, 32), np.uint8)
        for k, x in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(x, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class ShardWriter:
    """Writes one shard to a binary stream; ids in, whole blocks out."""

    def __init__(self, out, block: int, kind: str, level: int = 3):
        self.out, self.block, self.kind = out, block, kind
        self.squeeze = zstandard.ZstdCompressor(level=level).compress
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.sizes: list[int] = []
        self.lengths: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.n_tokens: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_tokens.append(ids.size)
        self.waiting.append(ids)
        self.n_waiting += ids.size
        if self.n_waiting >= self.block:
            every = np.concatenate(self.waiting)
            whole = every.size // self.block * self.block
            for at in range(0, whole, self.block):
                self._put(every[at : at + self.block])
            self.waiting, self.n_waiting = [every[whole:]], every.size - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.squeeze(x) for x in to_planes(ids, self.kind)]
        self.sizes.append(ids.size)
        self.lengths.append([len(x) for x in planes])
        self.out.write(b"".join(planes))

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        table = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.n_tokens, pa.int64())})
        index = pa.table({"n_ids": pa.array(self.sizes, pa.int64()), "lengths": pa.array(self.lengths, pa.list_(pa.int32()))}, metadata={"kind": self.kind})
        footer = b"".join(struct.pack("<q", len(x)) + x for x in (_arrow(table), _arrow(index)))
        footer = self.squeeze(footer)
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)


def _arrow(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def read_shard(source) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """A shard's documents (``doc_id``, ``n_tokens``) and its blocks of ids, one at a time."""
    size = source.size()
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a whole shard of token planes")
    (length,) = struct.unpack("<q", tail[:8])
    source.seek(size - 16 - length)
    loose = zstandard.ZstdDecompressor().decompress
    footer, tables = loose(source.read(length)), []
    while footer:
        (n,) = struct.unpack("<q", footer[:8])
        tables.append(pa.ipc.open_stream(footer[8 : 8 + n]).read_all())
        footer = footer[8 + n :]
    docs, index = tables
    kind = index.schema.metadata[b"kind"].decode()

    def blocks() -> Iterator[np.ndarray]:
        source.seek(len(MAGIC))
        for n, lengths in zip(index["n_ids"].to_pylist(), index["lengths"].to_pylist(), strict=True):
            yield from_planes([loose(source.read(x)) for x in lengths], n, kind)

    return docs, blocks()


def write_token_planes(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, block: int = 65_536, kind: str = "byte", shards: int | None = None) -> DataFrame:
    """Encode every whole text of ``docs`` (``doc_id``, ``text``) and write shards below ``folder``.

    Returns the manifest: one row for each shard, in the order of its
    documents. A null text is an empty one; a null ``doc_id`` comes first;
    rows that share a ``doc_id`` stay apart, in the order of their texts; an
    empty table gives no shard with documents. Other columns are not read.

    Texts are dealt by ranges of ``doc_id``, as many as the table's scan has
    tasks. A shard's name is new for each attempt of a task and only the
    manifest names it, so a lost executor leaves no half shard to be read.
    """
    spark = docs.sparkSession
    importable(spark)
    new_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shards or max(1, docs.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        path = f"{place}/{uuid.uuid4().hex}.ids"
        tokens, end = encoder(vocabulary), np.array([end_id], "<u4")
        ids, texts, chars = [], [], 0
        with system.open_output_stream(path) as out:
            shard = ShardWriter(out, block, kind)

            def flush() -> None:
                for doc_id, x in zip(ids, tokens.encode(texts), strict=True):
                    shard.add(doc_id, np.concatenate([x, end]))

            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    chars += len(text or "")
                    if chars >= BATCH:
                        flush()
                        ids, texts, chars = [], [], 0
            flush()
            shard.close()
        n = len(shard.doc_ids)
        row = {"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [n], "n_tokens": [sum(shard.n_tokens)]}
        yield pa.RecordBatch.from_pydict(row)

    return stored(rows.mapInArrow(write, MANIFEST), folder, "manifest")


def read_token_planes(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Each document of the shards: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` and, if asked for, its ``ids``.

    The running sum is over the manifest, one row for each shard.
    """
    importable(manifest.sparkSession)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = max(1, manifest.count())
    shards = manifest.where("n_docs > 0").withColumn("before", before).select("path", "before").repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as source:
                    table, blocks = read_shard(source)
                    counts = table["n_tokens"].to_numpy()
                    starts = start + np.cumsum(counts) - counts
                    checks, kept = np.zeros(counts.size, np.int64), []
                    ids, at = np.empty(0, "<u4"), 0
                    for k, n in enumerate(counts.tolist()):
                        check, parts, need = 0, [], n
                        while need:
                            if at == ids.size:
                                ids, at = next(blocks), 0
                            part = ids[at : at + need]
                            check = zlib.crc32(part.tobytes(), check)
                            parts.append(part)
                            at, need = at + part.size, need - part.size
                        checks[k] = check
                        if with_ids:
                            kept.append(np.concatenate(parts))
                    out = {"doc_id": table["doc_id"].combine_chunks(), "start": starts, "n_tokens": counts, "ids_crc32": checks}
                    if with_ids:
                        out["ids"] = pa.array(kept, pa.list_(pa.int64()))
                    yield from pa.table(out).to_batches(max_chunksize=5_000)

    return shards.mapInArrow(read, RESULT + (", ids array<long>" if with_ids else ""))


def token_planes(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the shards of ``docs`` in a new shared folder, and read them back."""
    folder = work_dir(docs.sparkSession, "planes")
    return read_token_planes(write_token_planes(docs, vocabulary, folder, **options), folder)
