"""Near-duplicate detection by fast similarity sketching.

Sketch.  A document's set is its distinct shingles of five words (the whole
sequence if shorter).  Round after round, every shingle is thrown into one of
``t`` bins and a bin keeps its smallest (round, hash); after ``t`` random rounds,
round ``t + i`` throws all shingles into bin ``i``.  So every coordinate fills,
each is a consistent sample of the set, and estimates concentrate as with ``t``
independent MinHashes at the cost of about one.

Banding.  ``bands`` groups of ``rows`` coordinates; documents agreeing on a whole
band share a bucket.  At the defaults (60 x 6) a pair at similarity 0.75 is
missed with probability 8e-6.

Verification.  A link is 100 * |A & B| >= 75 * |A | B| on the full sets, taken
again from whole texts.  Documents with equal sets are one class, represented
by their smallest id, so copies never pair up.  Each class first tests the
bucket leader it meets most often.  Classes of buckets that then still span
several components are narrowed by an exact prefix filter: with shingles in one
order, the rarer first, two sets that link share one among the first quarter of
the larger and the first seventh of the smaller.  So documents that only share
a passage, however many, don't meet.  Up to ``SMALL`` classes with such a
shingle are tested in pairs.  More of them are cut, by rank, into blocks that
carry their sets; two blocks meet once, if they share such a shingle and their
sizes allow a link, and a task returns a link for each pair of components it
finds.  So no large bucket is expanded to pairs of rows, none is cut short, and
no task holds more than two blocks.  The number of meetings grows with the
square of a family's blocks where its members differ in a tenth or so of their
shingles and no leader joins them.

Null, empty and wordless texts have an empty set and link with nothing.  To
``classes``, rows sharing an id are one document, and a null id belongs to the
class of its text, or to none; ``deduplicate`` takes every row by itself.  Empty
tables give no rows; extra columns don't matter to ``classes`` and come back from
``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship, unused
from .components import components
from .words import U64, Words, mix, pieces, runs, words_of

SHINGLE, BANDS, ROWS = 5, 60, 6
SMALL, BLOCK, BLOCK_SHINGLES = 64, 256, 250_000
COUNTERS = 18  # bits of a shingle's hash that pick its counter
EMPTY = U64(2**64 - 1)
SETS = "node long, comp long, n int, shingles binary"
PREFIXES = "node long, comp long, n int, hash long, low boolean"
RANKED = "pid int, before long, node long, comp long, n int, shingles binary"
BLOCKS = "block long, least int, most int, nodes array<long>, comps array<long>, sizes array<long>, shingles binary"
SKETCHED = "doc_id long, n_shingles long, setkey binary, bands array<long>"


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a batch."""
    hashes, out = runs(words.hash, k), []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(hashes[lo : hi - k + 1]))
        elif hi > lo:
            out.append(runs(words.hash[lo:hi], int(hi - lo)) + U64(1))
        else:
            out.append(np.zeros(0, U64))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """``len(sets)`` x ``t`` coordinates; rows of empty sets stay ``EMPTY``."""
    n = len(sets)
    out = np.full(n * t, EMPTY, U64)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.zeros(0, U64)
    for turn in range(2 * t):
        if not len(items):
            break
        hashed = mix(items + U64((turn * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % (1 << 64)))
        bins = ((hashed >> U64(32)) * U64(t) >> U64(32)).astype(np.int64) if turn < t else turn - t
        np.minimum.at(out, owner * t + bins, (U64(turn) << U64(32)) | (hashed & U64(0xFFFFFFFF)))
        open_ = (out.reshape(n, t) == EMPTY).any(axis=1)[owner]
        if not open_.all():
            items, owner = items[open_], owner[open_]
    return out.reshape(n, t)


def band_hashes(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    split = coordinates.reshape(len(coordinates), bands, rows)
    total = np.tile(np.arange(1, bands + 1, dtype=U64) * U64(0xD1342543DE82EF95), (len(coordinates), 1))
    for j in range(rows):
        total = mix(total ^ split[:, :, j]) + U64(j)
    return total.view(np.int64)


def sketched(docs: DataFrame, bands: int, rows: int, text: str, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in pieces(batch.column(1)):
                sets = shingle_sets(words_of(part, lower=True))
                found = band_hashes(sketch(sets, bands * rows), bands, rows)
                size = np.array([len(s) for s in sets], np.int64)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((size > 0) * bands)]), pa.int32()), pa.array(found[size > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(size), pa.array(keys, pa.binary()), lists], names=["doc_id", "n_shingles", "setkey", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SKETCHED)


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b, text_a, text_b``, the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            left, right = batch.column(2), batch.column(3)
            for lo, part in pieces(left):
                for sub, other in pieces(right.slice(lo, len(part))):
                    one, two = shingle_sets(words_of(part.slice(sub, len(other)), lower=True)), shingle_sets(words_of(other, lower=True))
                    for i, (x, y) in enumerate(zip(one, two, strict=True)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[lo + sub + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, comp, n, text`` with the set in place of the text."""
    for batch in batches:
        for lo, part in pieces(batch.column(3)):
            sets = [s.tobytes() for s in shingle_sets(words_of(part, lower=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(part)) for i in range(3)), pa.array(sets, pa.binary())], names=["node", "comp", "n", "shingles"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each counter is met in a partition."""
    total = np.zeros(1 << COUNTERS, np.int64)
    for batch in batches:
        at = np.frombuffer(b"".join(batch.column(0).to_pylist()), U64) >> U64(64 - COUNTERS)
        total += np.bincount(at.astype(np.int64), minlength=len(total))
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["counter", "n"])


def prefixes(shared, percent: int):
    """The shingles of each set that a linked set must share one of, rare ones first.

    ``low`` marks those that do if the other set is no smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            found, sizes, lows = [], [], []
            for one in batch.column(3):
                own = np.frombuffer(one.as_buffer(), U64)
                n = len(own)
                first = n + 1 + -n * percent // 100  # n - ceil(percent of n) + 1
                low = n + 1 + -2 * n * percent // (100 + percent)
                order = np.lexsort((own, often[(own >> U64(64 - COUNTERS)).astype(np.int64)]))[:first]
                found.append(own[order])
                sizes.append(len(order))
                lows.append(np.arange(len(order)) < low)
            rows = pa.array(np.repeat(np.arange(len(batch)), np.array(sizes, np.int64)))
            columns = [batch.column(i).take(rows) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.zeros(0, U64), *found]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, bool), *lows]))], names=["node", "comp", "n", "hash", "low"])

    return run


def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands before a class in its partition: its shingles, or a block's share if fewer."""
    pid, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = before + np.cumsum(np.maximum(batch.column(2).to_numpy().astype(np.int64), BLOCK_SHINGLES // BLOCK))
        starts = np.concatenate([[before], ends[:-1]])[: len(ends)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), pid, np.int32)), pa.array(starts), *batch.columns[:4]], names=["pid", "before", "node", "comp", "n", "shingles"])
        before = int(ends[-1]) if len(ends) else before


def build_block(group: pa.Table) -> pa.Table:
    """The classes of one block as one row."""
    group = group.sort_by("node")
    sizes = group["n"].to_numpy()
    values = {"block": [group["block"][0].as_py()], "least": [int(sizes.min())], "most": [int(sizes.max())], "nodes": [group["node"].to_pylist()], "comps": [group["comp"].to_pylist()], "sizes": [sizes.tolist()], "shingles": [b"".join(group["shingles"].to_pylist())]}
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(values.items(), kinds, strict=True)})


def compare_blocks(left: dict, right: dict, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """One link for each pair of components with similar enough sets in two blocks."""
    one, two = (np.frombuffer(side["shingles"], U64) for side in (left, right))
    size = [np.array(side["sizes"], np.int64) for side in (left, right)]
    comp = [np.array(side["comps"], np.int64) for side in (left, right)]
    node = [np.array(side["nodes"], np.int64) for side in (left, right)]
    shared = np.intersect1d(one, two)
    owner = [np.repeat(np.arange(len(n)), n) for n in size]
    place = []
    for values in (one, two):
        at = np.searchsorted(shared, values)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == values[hit]
        place.append((hit, at))
    both = np.zeros((len(size[0]), len(size[1])), np.float32)
    for lo in range(0, len(shared), 8192):  # intersections are whole numbers, exact in float32
        rows = []
        for (hit, at), who, n in zip(place, owner, size, strict=True):
            pick = hit & (at >= lo) & (at < lo + 8192)
            dense = np.zeros((len(n), 8192), np.float32)
            dense[who[pick], at[pick] - lo] = 1
            rows.append(dense)
        both += rows[0] @ rows[1].T
    count = both.astype(np.int64)
    union = size[0][:, None] + size[1][None, :] - count
    good = (count > 0) & (100 * count >= percent * union) & (comp[0][:, None] != comp[1][None, :])
    if same:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    _, lead = np.unique(np.stack([comp[0][i], comp[1][j]], axis=1), axis=0, return_index=True)
    return node[0][i[lead]], node[1][j[lead]]


class Clusters:
    """Candidate buckets, tested pairs and components, all as durable tables."""

    def __init__(self, docs: DataFrame, bands: int, rows: int, percent: int, text: str, key: str):
        self.spark, self.percent = docs.sparkSession, percent
        ship(self.spark)
        self.store = Scratch(self.spark, "minhash")
        self.all = self.store.keep(sketched(docs, bands, rows, text, key), "sketched")
        self.reps = self.store.keep(self.all.filter("setkey is not null").groupBy("setkey").agg(F.min("doc_id").alias("rep")), "reps")
        own = self.reps.select(F.col("rep").alias("doc_id"), "setkey")  # joined by id as well: a set that is common has one row here
        nodes = self.all.join(own, ["doc_id", "setkey"], "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").cast("int").alias("n"), F.explode_outer("bands").alias("hash"))
        leaders = self.store.keep(nodes.groupBy("hash").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("members")).filter("members > 1").select("hash", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n"), "members"), "leaders")
        self.buckets = self.store.keep(nodes.join(leaders, "hash"), "buckets")
        self.store.drop("leaders")
        wanted = self.buckets.select(F.col("node").alias("wanted")).distinct()
        bodies = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
        self.texts = self.store.keep(bodies.join(wanted, F.col("node") == F.col("wanted"), "left_semi"), "texts")
        self.turn, self.tested, self.labels = 0, None, None

    def join_up(self, links: DataFrame, name: str) -> None:
        """Components with these links added."""
        if self.labels is None or not links.isEmpty():
            self.labels = components(self.store, links, name, self.labels)

    def test(self, pairs: DataFrame) -> None:
        """Verify ``a, b`` (with sizes ``n_a, n_b``) and join what they link.

        Sizes that allow no link are left out first, so a leader's text, which
        goes with each of its pairs, is never much longer than the other.
        """
        self.turn += 1
        fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        pairs = pairs.filter(fits).select("a", "b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.store.keep(pairs, f"pairs-{self.turn}")
        with_a = pairs.join(self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        self.join_up(self.store.keep(linked(with_b, self.percent), f"links-{self.turn}"), f"cc-{self.turn}")
        self.tested = pairs

    def open_sets(self) -> DataFrame:
        """``node, comp, n, shingles`` of the classes of buckets that span several components."""
        rows = self.buckets.select("hash", "node", "n").join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rows = self.store.keep(rows, "labelled")
        spread = self.store.keep(rows.groupBy("hash").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("hash"), "spread")
        nodes = rows.join(spread, "hash", "left_semi").select("node", "comp", "n").distinct()
        bodies = nodes.join(self.texts, "node").dropDuplicates(["node"]).select("node", "comp", "n", "text")
        sets = self.store.keep(bodies.mapInArrow(with_sets, SETS), "sets")
        for name in ("labelled", "spread", "buckets"):
            self.store.drop(name)
        return sets

    def prefix_buckets(self, sets: DataFrame) -> DataFrame:
        """Prefix rows of shingles that several components share there, with their number."""
        often = np.zeros(1 << COUNTERS, np.int64)
        met = sets.select("shingles").mapInArrow(counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
        often[met["counter"].to_numpy()] = met["n"].to_numpy()  # at most 2 ** COUNTERS rows, whatever the input
        rows = self.store.keep(sets.mapInArrow(prefixes(self.spark.sparkContext.broadcast(often), self.percent), PREFIXES), "prefixes")
        common = rows.groupBy("hash").agg(F.count("*").alias("members"), F.min("comp").alias("low_comp"), F.max("comp").alias("high_comp")).filter("low_comp <> high_comp").select("hash", "members")
        common = self.store.keep(common, "common")
        found = self.store.keep(rows.join(common, "hash"), "prefix-buckets")
        for name in ("prefixes", "common"):
            self.store.drop(name)
        return found

    def test_small(self, buckets: DataFrame) -> None:
        """All pairs across components of up to ``SMALL`` classes that share a prefix shingle."""
        one = buckets.filter(F.col("members") <= SMALL).select("hash", F.col("node").alias("a"), F.col("n").alias("n_a"), "comp", "low")
        two = one.select("hash", F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("comp").alias("comp_b"), F.col("low").alias("low_b"))
        smaller = (F.col("low") & (F.col("n_a") <= F.col("n_b"))) | (F.col("low_b") & (F.col("n_b") <= F.col("n_a")))
        self.test(one.join(two, "hash").filter("a < b and comp <> comp_b").filter(smaller))

    def test_blocks(self, crowded: DataFrame, sets: DataFrame) -> None:
        """Larger groups, block against block.

        Classes are ranked by the most common prefix shingle they have, and cut
        where a block's worth of shingles ends, wherever partitions do.  A task
        counts the intersections of two blocks as a matrix product and returns
        a link for each pair of components, so no pair of classes becomes a row.
        """
        places = crowded.groupBy("node").agg(F.min(F.struct((-F.col("members")).alias("m"), "hash")).alias("place")).select(F.col("node").alias("own"), "place")
        bodies = sets.join(places, F.col("node") == F.col("own")).select("node", "comp", "n", "shingles", "place")
        order = ["place.m", "place.hash", "n", "node"]
        ranked = self.store.keep(bodies.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(weigh, RANKED), "ranked")
        share = F.greatest(F.col("n").cast("long"), F.lit(BLOCK_SHINGLES // BLOCK))
        totals = ranked.groupBy("pid").agg(F.sum(share).alias("total"))  # a row for each partition
        offsets = totals.select("pid", (F.sum("total").over(Window.orderBy("pid")) - F.col("total")).alias("offset"))
        placed = ranked.join(F.broadcast(offsets), "pid").withColumn("block", F.floor((F.col("offset") + F.col("before")) / BLOCK_SHINGLES))
        placed = self.store.keep(placed.select("block", "node", "comp", "n", "shingles"), "placed")
        blocks = self.store.keep(placed.groupBy("block").applyInArrow(build_block, BLOCKS), "blocks")
        home = placed.select("block", F.col("node").alias("member"))
        met = crowded.join(home, F.col("node") == F.col("member")).groupBy("hash").agg(F.sort_array(F.collect_set("block")).alias("list")).select("list").distinct()
        met = self.store.keep(met, "lists")
        meetings = met.select("list", F.explode_outer("list").alias("a")).select("a", F.explode_outer("list").alias("b")).filter("a <= b").distinct()
        for side in ("a", "b"):
            meetings = meetings.join(blocks.select(F.col("block").alias(side), F.col("least").alias(f"least_{side}"), F.col("most").alias(f"most_{side}"), F.array_min("comps").alias(f"low_{side}"), F.array_max("comps").alias(f"high_{side}")), side)
        sizes = (F.col("most_a") * 100 >= F.col("least_b") * self.percent) & (F.col("most_b") * 100 >= F.col("least_a") * self.percent)
        spread = F.least("low_a", "low_b") < F.greatest("high_a", "high_b")
        meetings = self.store.keep(meetings.filter(sizes & spread).select("a", "b"), "meetings")
        with_a = meetings.join(blocks.select(F.col("block").alias("a"), F.struct("nodes", "comps", "sizes", "shingles").alias("left")), "a")
        with_b = with_a.join(blocks.select(F.col("block").alias("b"), F.struct("nodes", "comps", "sizes", "shingles").alias("right")), "b")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    row = batch.slice(i, 1).to_pylist()[0]
                    a, b = compare_blocks(row["left"], row["right"], row["a"] == row["b"], percent)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        self.join_up(self.store.keep(with_b.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"), "links-blocks"), "cc-blocks")
        for name in ("ranked", "placed", "blocks", "lists", "meetings"):
            self.store.drop(name)

    def run(self) -> DataFrame:
        """``node, comp`` of every class that has a link."""
        met = self.buckets.filter("leader < node").groupBy("node", "n", "leader", "leader_n").agg(F.count("*").alias("times"))
        first = met.groupBy("node", "n").agg(F.max_by(F.struct("leader", "leader_n"), F.struct("times", -F.col("leader"))).alias("lead"))
        self.test(first.select(F.col("lead.leader").alias("a"), F.col("node").alias("b"), F.col("lead.leader_n").alias("n_a"), F.col("n").alias("n_b")))
        sets = self.open_sets()
        buckets = self.prefix_buckets(sets)
        self.test_small(buckets)
        crowded = buckets.filter(F.col("members") > SMALL)
        if not crowded.isEmpty():
            self.test_blocks(crowded, sets)
        for name in ("texts", "sets", "prefix-buckets", "pairs-1", "pairs-2", "links-1", "links-2", "links-blocks"):
            self.store.drop(name)
        return self.labels


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: set size, component and whether it stays."""
    work = Clusters(docs, bands, rows, percent, text, key)
    labels = work.run()
    joined = work.all.select("doc_id", "n_shingles", "setkey").join(work.reps, "setkey", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; rows without an id come last.

    Rows are numbered in the order of their ids, so rows that share an id, or
    have none, are told apart.
    """
    order = [F.col(key).asc_nulls_last(), F.xxhash64(text)]
    row, gone_row = unused(docs.columns, "__row", "__gone")
    numbered = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    numbered = Scratch(docs.sparkSession, "minhash-rows").keep(numbered, "numbered")
    found = classes(numbered, text=text, key=row, **options)
    gone = found.filter("not kept").select(F.col("doc_id").alias(gone_row))
    return numbered.join(gone, F.col(row) == F.col(gone_row), "left_anti").select(*docs.columns)
