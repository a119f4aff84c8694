"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending key order:

* data blocks: entries ``(shared, rest, size, key rest, ids)`` whose keys are
  prefix-compressed against the entry before; a block is compressed as a whole
  and starts with a full key;
* a sparse index with the first key and place of every block;
* a Bloom filter over all keys;
* a footer with the places of index and filter, counts and a checksum.

Keys are the order-preserving big-endian form of a signed 64-bit id; a null id
sorts first.  A lookup reads footer, filter and index, finds the block by
binary search and scans that block alone.

Shards are range-partitioned by key and written under attempt-unique names in
the shared folder, through the file systems that Arrow knows (local, HDFS, S3,
GCS).  Only those in the stored manifest are ever read, so lost
executors and repeated attempts leave no trace in a result.  Null texts are
empty (end id only), repeated ids keep all their rows, an empty table has an
empty manifest, extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, partitions_for, ship

MAGIC = b"TFSST001"
FOOTER = struct.Struct("<QQQQQQII8s")  # index, filter, end, docs, ids, hashes, width, crc, magic
ENTRY = struct.Struct("<BBI")
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Beside its text, a row counts so many bytes towards a shard, so that short and null texts fill shards too.
ROW_BYTES = 64
MANIFEST = "shard long, uri string, n_docs long, n_ids long, first_key binary, last_key binary, n_bytes long"


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key else None


def _hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9E3779B9)


def _bloom_places(pairs, bits: int) -> np.ndarray:
    """Places in the filter of keys whose two hashes stand one after another."""
    pair = np.array(pairs, np.uint64).reshape(-1, 2)
    return ((pair[:, :1] + (pair[:, 1:] | np.uint64(1)) * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Streams entries to a shard; memory holds one block, the index and eight bytes a key."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.at = stream, width, 0
        self.block, self.last = bytearray(), None
        self.index: list[tuple[bytes, int, int]] = []
        self.first_of_block = b""
        self.hashes, self.newest = array("I"), b""
        self.n_docs = self.n_ids = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.n_docs and key < self.newest:
            raise ValueError("keys must ascend")
        shared = 0
        if self.last is None:
            self.first_of_block = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids
        self.last = self.newest = key
        self.hashes.extend(_hashes(key))
        self.n_docs += 1
        self.n_ids += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.first_of_block, self.at, len(data)))
            self._write(data)
            self.block, self.last = bytearray(), None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def finish(self) -> int:
        self._flush()
        index_at = self.at
        index = b"".join(struct.pack("<BQI", len(k), at, size) + k for k, at, size in self.index)
        self._write(index)
        filter_at = self.at
        bits = max(64, -(-self.n_docs * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for lo in range(0, len(self.hashes), 1 << 15):
            bloom[_bloom_places(self.hashes[lo : lo + (1 << 15)], bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self._write(packed)
        self._write(FOOTER.pack(index_at, filter_at, self.at, self.n_docs, self.n_ids, BLOOM_HASHES, self.width, zlib.crc32(index + packed), MAGIC))
        return self.at


class Reader:
    """Reads a shard through any file with ``seek`` and ``read``."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        self.index_at, self.filter_at, self.end, self.n_docs, self.n_ids, _, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(self.index_at)
        rest = file.read(self.end - self.index_at)
        if zlib.crc32(rest) != crc:
            raise ValueError("shard is damaged")
        index, self.bloom = rest[: self.filter_at - self.index_at], np.frombuffer(rest[self.filter_at - self.index_at :], np.uint8)
        self.first, self.place, at = [], [], 0
        while at < len(index):
            n, start, length = struct.unpack_from("<BQI", index, at)
            at += 13
            self.first.append(index[at : at + n])
            self.place.append((start, length))
            at += n
        self.unzip = zstandard.ZstdDecompressor()

    def block(self, at: int) -> Iterator[tuple[bytes, bytes]]:
        start, length = self.place[at]
        self.file.seek(start)
        data, i, key = self.unzip.decompress(self.file.read(length)), 0, b""
        while i < len(data):
            shared, rest, size = ENTRY.unpack_from(data, i)
            i += ENTRY.size
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + size]
            i += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for at in range(len(self.place)):
            yield from self.block(at)

    def get(self, key: bytes) -> list[bytes]:
        """Ids of every entry with this key: filter, binary search, block scan."""
        from bisect import bisect_left

        places = _bloom_places(_hashes(key), 8 * len(self.bloom))
        if not self.n_docs or not (self.bloom[places >> 3] & (128 >> (places & 7))).all():
            return []
        found = []
        for at in range(max(0, bisect_left(self.first, key) - 1), len(self.place)):
            if self.first[at] > key:
                break
            found += [ids for k, ids in self.block(at) if k == key]
        return found


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def open_shard(uri: str) -> Reader:
    system, path = _file_system(uri)
    return Reader(system.open_input_file(path), system.get_file_info(path).size)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id", target_mb: int = 32) -> DataFrame:
    """Encode documents, write shards in key order, return the stored manifest."""
    spark = docs.sparkSession
    ship(spark)
    store = Scratch(spark, "sstable")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nbytes = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0
    folder = store.path("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, first = encoder(tokenizer), None, b""
        tail, pid = enc.pack([end_id]), TaskContext.get().partitionId()
        system, path = _file_system(folder)
        uri = f"{folder}/{pid:06d}-{uuid.uuid4().hex}.sst"
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    system.create_dir(path)
                    stream = system.open_output_stream(_file_system(uri)[1])
                    writer, first = Writer(stream, enc.width), key_bytes(doc)
                writer.add(key_bytes(doc), ids + tail)
        if writer is not None:
            size = writer.finish()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"shard": pid, "uri": uri, "n_docs": writer.n_docs, "n_ids": writer.n_ids, "first_key": first, "last_key": writer.newest, "n_bytes": size}], schema=pa.schema([("shard", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_bytes", pa.int64())]))

    ordered = rows.repartitionByRange(partitions_for(spark, nbytes, target_mb), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return store.keep(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards in order: id, start, count, crc32 of its ids.

    Shard starts are a prefix sum over the manifest, one row for each shard.
    """
    starts = F.sum("n_ids").over(Window.orderBy("shard", "uri")) - F.col("n_ids")
    listed = manifest.select("uri", starts.alias("start")).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = open_shard(uri)
                rows: list[tuple] = []
                for at in range(len(reader.place)):
                    for key, ids in reader.block(at):
                        wide = np.frombuffer(ids, f"<u{reader.width}").astype("<u4")
                        rows.append((key_value(key), start, len(wide), zlib.crc32(wide)))
                        start += len(wide)
                    if len(rows) > 5000 or at == len(reader.place) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Ids of one document by binary search: shard by key range, then block."""
    key, found = key_bytes(doc_id), []
    for row in manifest.filter((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("shard").select("uri").collect():
        reader = open_shard(row.uri)
        found += [np.frombuffer(ids, f"<u{reader.width}") for ids in reader.get(key)]
    return found
