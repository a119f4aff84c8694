"""Sequence packing by concatenate-and-cut.

Pass one encodes every document once and stores packed ids with each
document's offset inside its partition.  The partitions' token totals, one row
each, give global offsets by a prefix sum.  Pass two shifts local offsets by
the partition's global one and cuts at every multiple of the window, so a
document that straddles windows leaves boundary records in each.

Null texts are empty: a document still has its end id.  Repeated documents and
document ids are packed as often as they occur; an empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, ship

ENCODED = "pid int, doc_id long, ids binary, n_tokens long, before long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packed ids per document with its offset inside its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(tokenizer), 0
        pid, tail = TaskContext.get().partitionId(), enc.pack([end_id])
        for batch in batches:
            ids = [x + tail for x in enc.encode(batch.column(1).to_pylist())]
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // enc.width
            ends = before + np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), pid, np.int32)), batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(counts), pa.array(ends - counts)], names=["pid", "doc_id", "ids", "n_tokens", "before"])
            if len(ends):
                before = int(ends[-1])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ENCODED)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Pieces of documents placed in sequences of ``window`` tokens.

    Only the last sequence can be short.  ``padded_length`` is the length a
    trainer should pad a piece's sequence to: ``window``, except that a
    sequence whose own length is a power of two stays as it is.  ``ids`` holds
    the piece's ids as unsigned little-endian 32-bit integers.
    """
    spark = docs.sparkSession
    ship(spark)
    store = Scratch(spark, "packing")
    encoded = store.keep(encode_documents(docs, tokenizer, end_id, text, key), "encoded")
    # a row for each partition of pass one, whatever its documents
    totals = encoded.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select(F.col("pid"), (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = encoded.join(F.broadcast(offsets), "pid").select("doc_id", "ids", "n_tokens", (F.col("offset") + F.col("before")).alias("at"), "total")
    width = encoder(tokenizer).width

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                yield cut_batch(batch.slice(lo, 1000), window, width, with_ids)

    return placed.mapInArrow(cut, PIECES)


def cut_batch(batch: pa.RecordBatch, window: int, width: int, with_ids: bool) -> pa.RecordBatch:
    """Pieces of the documents ``doc_id, ids, n_tokens, at, total``; their ids stand on end as they are cut."""
    n, at, total = (batch.column(i).to_numpy() for i in (2, 3, 4))
    ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"<u{width}").astype("<u4")
    first, counts = at // window, (at + n - 1) // window - at // window + 1
    doc = np.repeat(np.arange(len(n)), counts)
    sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.maximum(at[doc], sequence * window)
    length = np.minimum((sequence + 1) * window, at[doc] + n[doc]) - place
    ends = 4 * np.concatenate([[0], np.cumsum(length)])
    view = memoryview(ids.tobytes())
    crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.int64, len(doc))
    tail = total[doc] % window
    short = (place >= total[doc] - tail) & (tail & (tail - 1) == 0)
    numbers = [place - at[doc], length, crc, n[doc], sequence, place - sequence * window, np.where(short, tail, window)]
    if with_ids:
        pieces = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(view)])
    else:
        pieces = pa.nulls(len(doc), pa.binary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in numbers), pieces], names=names)
