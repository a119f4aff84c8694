"""Removal of repeated runs of words by level-wise doubling.

Levels have windows of ``target / 2**k`` words, the smallest first.  A window
that occurs once needs no further look, so only where a window and the one
right after it are both repeated does a window of twice the length become a
candidate at the next level; levels double until ``target`` or until no
candidate survives.

Texts stay put in durable blocks.  At each level a block sends, for every range
of hash values, its distinct candidate hashes, sorted and delta-coded; whoever
owns the range answers with one bit a hash.  A hash is sent once a block however
often it occurs, so hot passages don't grow any range.  At lower levels the bit
says that another block has the hash too, and hashes are cut to the bits that
keep chance matches under one in 256, since those only make extra candidates.
At ``target`` all 64 bits go, with a second hash of 64 bits that is taken from the
words' bytes by other functions, and with the smallest document id; the bit says
whether the first occurrence of all is in this block.  So windows count as equal
on 128 bits of independent hashes, and windows that agree on one hash alone are
told apart.  A message holds one hash at least, so messages never outnumber the
hashes, though they carry fewer each as blocks and ranges grow in number.

A word covered by a window that also starts earlier (smaller document id, or
earlier in the same document) is removed; all windows are judged on the input.

Null and wordless texts have no words.  Rows sharing an id follow one another
in an unspecified but fixed order; a null id precedes all others.  Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .words import U64, pieces, runs, words_of

BLOCK_BYTES = 4 << 20
GROUP_BYTES = 32 << 20
LEAST_RANGES = 256
NULL_ID = -(1 << 63)
BLOCKS = "block long, n_docs long, payload binary"
ASKED = "rng int, block long, n int, keys binary, checks binary, ids binary"
ANSWERS = "block long, level int, rng int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def pack_numbers(values: np.ndarray) -> bytes:
    """Byte planes of unsigned numbers, as many as the largest needs, compressed."""
    wide = values.astype("<u8")
    width = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(wide) else 1
    planes = wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(U64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, n), dtype=U64)


def write_blocks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Documents in blocks of a few megabytes, ordered by id inside a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        zipper = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.set_column(0, "doc_id", rows.column(0).fill_null(NULL_ID))
            rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([(pid << 32) | made]), pa.array([len(rows)]), pa.array([zipper.compress(sink.getvalue().to_pybytes())], pa.binary())], names=["block", "n_docs", "payload"])

        for batch in batches:
            for lo, part in pieces(batch.column(1), BLOCK_BYTES):
                held.append(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), part], names=["doc_id", "text"]))
                size += held[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


class Block:
    """Words of one block and the levels it has been through."""

    def __init__(self, payload: bytes, check: bool = False):
        rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all().combine_chunks()
        self.ids = rows.column(0).to_numpy()
        texts = rows.column(1)
        self.texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
        parts = [words_of(part, check=check) for _, part in pieces(self.texts)]
        self.hash = np.concatenate([np.zeros(0, U64), *(p.hash for p in parts)])
        self.second = np.concatenate([np.zeros(0, U64), *(p.prefix[:, -1] for p in parts)]) if check else None
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(p.first) for p in parts)])
        self.first = np.concatenate([[0], np.cumsum(sizes)])  # text i has words first[i] .. first[i + 1]
        self.n = len(self.hash)
        self.end = np.repeat(self.first[1:], sizes)  # word index at which its text ends

    def level(self, length: int, within: np.ndarray | None, bits: int, last: bool = False) -> None:
        """Candidates of a level: ``within`` has the starts not ruled out below."""
        at = np.arange(max(0, self.n - length + 1))
        fits = at + length <= self.end[: len(at)]
        if within is not None:
            half = length // 2
            fits &= within[: len(at)] & within[half : half + len(at)]
        self.at = at[fits]
        keys = runs(self.hash, length)[fits] >> U64(64 - bits)
        if not last:
            self.keys, self.lead, self.which, self.count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            return
        checks = runs(self.second, length, 0x9FB21C651E98DF25)[fits]
        order = np.lexsort((checks, keys))  # stable: the first of equal windows leads
        keys, checks = keys[order], checks[order]
        opens = np.ones(len(order), bool)
        opens[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        self.keys, self.checks, self.lead = keys[opens], checks[opens], order[opens]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(opens) - 1

    def flags(self, answer: np.ndarray) -> np.ndarray:
        """Starts whose window occurs again, here or in another block."""
        out = np.zeros(self.n, bool)
        out[self.at[(answer | (self.count > 1))[self.which]]] = True
        return out

    def repeats(self, first_here: np.ndarray) -> np.ndarray:
        """Starts whose window starts earlier as well."""
        out = np.zeros(self.n, bool)
        own_first = np.zeros(len(self.at), bool)
        own_first[self.lead] = True
        out[self.at[~(own_first & first_here[self.which])]] = True
        return out


def one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, each made when it is its turn."""
    for i in range(len(batch)):
        yield tuple(column[i].as_py() for column in batch.columns)


def _levels(target: int) -> list[int]:
    out = [target]
    while out[0] % 2 == 0 and out[0] > 9:
        out.insert(0, out[0] // 2)
    return out


def _replay(block: Block, answers: list[tuple[int, int, bytes]], lengths: list[int], bits: int, upto: int) -> np.ndarray | None:
    """Bring a block to level ``upto`` with the answers to the levels below."""
    within = None
    for level in range(upto + 1):
        last = level == len(lengths) - 1
        block.level(lengths[level], within, 64 if last else bits, last)
        if level < upto:
            within = block.flags(_answer(block, answers, level))
    return within


def _answer(block: Block, answers: list[tuple[int, int, bytes]], level: int) -> np.ndarray:
    """Bits of one level, one for each of the block's sorted keys."""
    parts = [np.unpackbits(np.frombuffer(data[4:], np.uint8))[: int.from_bytes(data[:4], "little")] for _, data in sorted((rng, data) for at, rng, data in answers if at == level)]
    found = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(found) != len(block.keys):
        raise RuntimeError(f"{len(found)} answers to {len(block.keys)} keys")
    return found


def _ask(lengths: list[int], level: int, bits: int, ranges: int):
    last = level == len(lengths) - 1
    shift = (64 if last else bits) - (ranges.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload, answers in one_by_one(batch):
                block = Block(payload, last)
                _replay(block, [(a["level"], a["rng"], a["bits"]) for a in answers or ()], lengths, bits, level)
                edges = np.searchsorted(block.keys, np.arange(ranges + 1, dtype=U64)[:-1] << U64(shift))
                edges = np.append(edges, len(block.keys))
                doc = np.searchsorted(block.first, block.at[block.lead], "right") - 1
                ids = (block.ids[doc].astype(np.int64) ^ np.int64(NULL_ID)).view(U64) if last else None
                full = np.flatnonzero(np.diff(edges))
                slices = [(int(r), int(edges[r]), int(edges[r + 1])) for r in full]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in slices], pa.int32()), pa.array([number] * len(slices), pa.int64()), pa.array([hi - lo for _, lo, hi in slices], pa.int32()), pa.array([pack_sorted(block.keys[lo:hi]) for _, lo, hi in slices], pa.binary()), pa.array([block.checks[lo:hi].tobytes() if last else None for _, lo, hi in slices], pa.binary()), pa.array([pack_numbers(ids[lo:hi] - ids[lo:hi].min()) + int(ids[lo:hi].min()).to_bytes(8, "little") if last else None for _, lo, hi in slices], pa.binary())], names=["rng", "block", "n", "keys", "checks", "ids"])

    return run


def _reply(level: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        rng, blocks, sizes = group.column("rng")[0].as_py(), group.column("block").to_numpy(), group.column("n").to_numpy()
        keys = np.concatenate([unpack_sorted(k, n) for k, n in zip(group.column("keys").to_pylist(), sizes, strict=True)])
        owner = np.repeat(np.arange(len(blocks)), sizes)
        if last:
            ids = np.concatenate([unpack_numbers(d[:-8], n) + U64(int.from_bytes(d[-8:], "little")) for d, n in zip(group.column("ids").to_pylist(), sizes, strict=True)])
            checks = np.frombuffer(b"".join(group.column("checks").to_pylist()), U64)
            order = np.lexsort((blocks[owner], ids, checks, keys))
            lead = np.ones(len(order), bool)
            lead[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
            bit = np.zeros(len(keys), bool)
            bit[order[lead]] = True
        else:
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            twin = np.zeros(len(keys), bool)
            same = ranked[1:] == ranked[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            bit = np.zeros(len(keys), bool)
            bit[order] = twin
        ends = np.cumsum(sizes)
        bits = [int(n).to_bytes(4, "little") + np.packbits(bit[end - n : end]).tobytes() for n, end in zip(sizes, ends, strict=True)]
        n = len(blocks)
        return pa.table({"block": pa.array(blocks, pa.int64()), "level": pa.array([level] * n, pa.int32()), "rng": pa.array([rng] * n, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _remove(lengths: list[int], bits: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(lengths) - 1
        for batch in batches:
            for _, payload, answers in one_by_one(batch):
                answers = [(a["level"], a["rng"], a["bits"]) for a in answers or ()]
                told = any(at == last for at, _, _ in answers)
                block = Block(payload, told)
                gone = np.zeros(block.n, bool)
                if told:
                    _replay(block, answers, lengths, bits, last)
                    starts = np.flatnonzero(block.repeats(_answer(block, answers, last)))
                    change = np.zeros(block.n + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + lengths[last], -1)
                    gone = np.cumsum(change)[:-1] > 0
                first, rows = block.first, []
                for i, text in enumerate(block.texts):
                    words = (text.as_py() or "").encode().split()
                    out = gone[first[i] : first[i + 1]]
                    removed = int(out.sum())
                    kept = b" ".join(compress(words, ~out) if removed else words)
                    doc = int(block.ids[i])
                    rows.append((None if doc == NULL_ID else doc, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                for lo in range(0, len(rows), 1000):
                    a, b, c, d, e = zip(*rows[lo : lo + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, target: int = 20, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """One row for each document: its words, those removed, and what is kept."""
    spark = docs.sparkSession
    ship(spark)
    store, lengths = Scratch(spark, "substring"), _levels(target)
    blocks = store.keep(write_blocks(docs, text, key), "blocks")
    nbytes = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    words = max(1, nbytes // 4)
    bits = min(64, max(32, words.bit_length() + 8))
    ranges = 1 << max(LEAST_RANGES.bit_length() - 1, int(words * 8 // GROUP_BYTES).bit_length())
    answers = None

    def answered() -> DataFrame:
        if answers is None:
            return blocks.select("block", "payload", F.lit(None).cast("array<struct<level:int,rng:int,bits:binary>>").alias("answers"))
        mine = answers.groupBy("block").agg(F.collect_list(F.struct("level", "rng", "bits")).alias("answers"))
        return blocks.select("block", "payload").join(mine, "block", "left").select("block", "payload", "answers")

    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        asked = answered().mapInArrow(_ask(lengths, level, bits, ranges), ASKED)
        said = store.keep(asked.groupBy("rng").applyInArrow(_reply(level, last), ANSWERS), f"answers-{level}", records=4)  # a block is a few megabytes
        if said.isEmpty():
            break
        answers = said if answers is None else answers.unionByName(said)
    return answered().mapInArrow(_remove(lengths, bits, with_text), RESULT)
