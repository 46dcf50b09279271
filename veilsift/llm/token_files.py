"""Token ids in seekable files of independent zstandard frames.

A shard is a run of zstandard frames, an index in a skippable frame, and the seek table of
the public "zstd seekable format" as the last skippable frame: compressed size, decompressed
size and checksum (low 32 bits of xxh64 of the content) of each frame, then the number of
frames, a descriptor and a magic number. Any zstandard reader can decompress a shard.

A data frame holds whole documents: their count (u32), doc_ids (i64), id counts (u64), then
all token ids (u32), all little-endian. The index frame holds each data frame's first doc_id,
so a reader finds a document by bisection and decompresses one frame only.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

# Fixed values of the zstd seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEK_FOOTER = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Stands for a null doc_id in files.
NULL_ID = -(2**63)

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def filesystem(uri: str):
    """A pyarrow file system and the path in it; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes documents to one shard; holds one frame in memory (or one longer document)."""

    def __init__(self, sink, frame_ids: int = 65_536, level: int = 3):
        self.sink, self.frame_ids = sink, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.docs: list[tuple[int, bytes]] = []
        self.held = self.n_docs = self.n_tokens = self.n_bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.first: list[int] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // 4
        if self.docs and self.held + n > self.frame_ids:
            self.flush()
        self.docs.append((doc_id, ids))
        self.held += n
        self.n_docs += 1
        self.n_tokens += n

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.n_bytes += len(data)

    def flush(self) -> None:
        if not self.docs:
            return
        heads = struct.pack("<I", len(self.docs)) + np.array([d for d, _ in self.docs], "<i8").tobytes() + np.array([len(x) // 4 for _, x in self.docs], "<u8").tobytes()
        plain = heads + b"".join(x for _, x in self.docs)
        packed = self.zstd.compress(plain)
        self.put(packed)
        self.seek.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.first.append(self.docs[0][0])
        self.docs, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.first, "<i8").tobytes()
        self.put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEK_FOOTER)
        self.put(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ShardReader:
    """Random access to one shard: ``frames()`` reads all of it, ``document(id)`` one frame."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n - 8)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_SEEK or length != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        source.seek(int(self.starts[-1]))
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_INDEX or length != 8 * n:
            raise ValueError("the document index is damaged")
        self.first = np.frombuffer(source.read(length), "<i8").tolist()

    def frame(self, k: int) -> Iterator[tuple[int, bytes]]:
        size, plain_size, checksum = map(int, self.table[k])
        self.source.seek(int(self.starts[k]))
        plain = zstandard.ZstdDecompressor().decompress(self.source.read(size), max_output_size=plain_size)
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        (n,) = struct.unpack_from("<I", plain)
        docs = np.frombuffer(plain, "<i8", n, 4).tolist()
        sizes = np.frombuffer(plain, "<u8", n, 4 + 8 * n)
        at = 4 + 16 * n
        for d, m in zip(docs, sizes.tolist(), strict=True):
            yield d, plain[at : at + 4 * m]
            at += 4 * m

    def frames(self) -> Iterator[tuple[int, bytes]]:
        for k in range(len(self.table)):
            yield from self.frame(k)

    def document(self, doc_id: int) -> list[bytes]:
        """Token ids of each row with this doc_id (repeated ids may run over several frames)."""
        out = []
        k = max(0, bisect_right(self.first, doc_id) - 1)
        while k > 0 and self.first[k] == doc_id:
            k -= 1
        while k < len(self.first) and self.first[k] <= doc_id:
            out += [x for d, x in self.frame(k) if d == doc_id]
            k += 1
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_ids: int = 65_536, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards in ascending doc_id order; returns the manifest.

    Nulls: a null text is empty (its row holds the end id alone); rows with a null doc_id come
    first. Repeated doc_ids stay separate rows in text order. An empty table gives shards without
    frames. Other columns are ignored. A shard's name carries the task attempt and only shards of
    attempts that ended are in the manifest, so retried or speculative tasks do no harm.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(common.tokenizer_spec(tokenizer))
    end = struct.pack("<I", end_id)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    ordered = plain.repartitionByRange(shards or common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, top = filesystem(folder)
        system.create_dir(top, recursive=True)
        name = f"{top}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.tokz"
        tokens = common.encoder(spec.value)
        with system.open_output_stream(name) as sink:
            shard = ShardWriter(sink, frame_ids)
            for batch in common.slices(batches):
                ids = tokens.encode(batch.column(1).to_pylist())
                for d, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                    shard.add(NULL_ID if d is None else d, x + end)
            shard.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [name], "n_docs": [shard.n_docs], "n_tokens": [shard.n_tokens], "n_bytes": [shard.n_bytes]})

    manifest = common.stored(ordered.mapInArrow(write, MANIFEST), "manifest")
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
    return manifest.withColumn("path", F.concat(F.lit(scheme), F.col("path"))) if scheme else manifest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document from the shards: doc_id, start (ids before it), n_tokens, ids_crc32.

    Each frame's checksum is verified. Starts follow from the manifest's totals, one row a shard.
    """
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("base")).repartition(common.partitions(spark), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = filesystem(path)
                with system.open_input_file(name) as source:
                    rows: list[tuple] = []
                    for d, ids in ShardReader(source).frames():
                        n = len(ids) // 4
                        rows.append((None if d == NULL_ID else d, base, n, zlib.crc32(ids)))
                        base += n
                        if len(rows) == 8192:
                            yield _digest(rows)
                            rows = []
                    if rows:
                        yield _digest(rows)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token ids of requested documents only: doc_id, ids (binary, little-endian u32).

    Shards are opened once for each task that holds requests for them; only frames with a
    requested document are decompressed. Unknown ids give no row; null ids are ignored.
    """
    spark = manifest.sparkSession
    bounds = manifest.where("n_docs > 0")

    def first_last(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = filesystem(path)
                with system.open_input_file(name) as source:
                    r = ShardReader(source)
                    last = max(d for d, _ in r.frame(len(r.first) - 1))
                    yield pa.RecordBatch.from_pydict({"path": [path], "lo": pa.array([r.first[0]], pa.int64()), "hi": pa.array([last], pa.int64())})

    spans = bounds.select("path").repartition(common.partitions(spark), "path").mapInArrow(first_last, "path string, lo long, hi long")
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # one row a shard on the small side of the range join
    asked = ids.join(F.broadcast(spans), F.col("doc_id").between(F.col("lo"), F.col("hi"))).select("path", "doc_id")

    def fetch(batches):
        for batch in batches:
            paths, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(paths):
                system, name = filesystem(paths[at])
                with system.open_input_file(name) as source:
                    r, path = ShardReader(source), paths[at]
                    while at < len(paths) and paths[at] == path:
                        found = r.document(docs[at])
                        if found:
                            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([docs[at]] * len(found), pa.int64()), "ids": pa.array(found, pa.binary())})
                        at += 1

    return asked.repartition(common.partitions(spark), "path").sortWithinPartitions("path", "doc_id").mapInArrow(fetch, "doc_id long, ids binary")
