"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where a rolling fingerprint of its last bytes hits
a pattern, so equal stretches give equal chunks wherever they stand.  Chunks
become 128-bit identifiers; a document is then its recipe, the ordered list of
those identifiers, and recipes are what is shuffled and compared.

Identifiers are verified: the first pass also gives each chunk a second, 256-bit
digest by another function, and where a recipe occurs more than once the digests
of each identifier are compared.  An identifier found with two digests stands for
two contents, and recipes are then extended by the digest of their whole text.
No text is ever shuffled; a chunk moves as 48 bytes, and only in such recipes.

Copies meet as partial counts, a row for each map task, and only repeated recipes
are joined back, in a table of their own, so a recipe that a third of all rows
have is either broadcast or split by the skew join.

A null text counts as empty, and all empty texts are one group.  Rows with the
same id and text are both kept when that id is the largest.  A null id ranks
below every other and is kept only in a group of null ids.  An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .words import pieces

RECIPES = "doc_id long, text_sha256 string, recipe array<binary>, proofs array<binary>"
LEAST, MOST, MASK = 512, 8192, np.uint64((1 << 10) - 1)

_state = 0x2545F4914F6CDD1D
_gear = []
for _ in range(256):
    _state = (_state * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
    _gear.append(_state ^ (_state >> 29))
GEAR = np.array(_gear, np.uint64)
WINDOW = 16


def boundaries(data: bytes) -> list[int]:
    """Ends of chunks of 512 to 8192 bytes, decided by the bytes around them."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    gear = GEAR[np.frombuffer(data, np.uint8)]
    rolling = gear.copy()
    step = 1
    while step < WINDOW:  # sum of the last 16 gears, each shifted by its age
        rolling[step:] += rolling[:-step] << np.uint64(step)
        step *= 2
    hits = np.flatnonzero((rolling >> np.uint64(40)) & MASK == 0) + 1
    ends, last, at = [], 0, 0
    while n - last > LEAST:
        at = int(np.searchsorted(hits, last + LEAST))
        cut = int(hits[at]) if at < len(hits) else n
        last = min(cut, last + MOST, n)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    last, out = 0, []
    for end in boundaries(data):
        out.append(data[last:end])
        last = end
    return out


def normalise(text: str | None) -> bytes:
    """Lower-case A-Z only, as bytes."""
    return (text or "").encode().lower()


def identify(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def prove(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def recipes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's chunk identifiers in order, with a digest for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in pieces(batch.column(1), 8 << 20):
                data = [normalise(t) for t in part.to_pylist()]
                cut = [chunks(d) for d in data]
                whole = [hashlib.sha256(d) for d in data]
                proofs = [[w.digest()] if len(c) == 1 else [prove(x) for x in c] for c, w in zip(cut, whole, strict=True)]
                columns = [pa.array([w.hexdigest() for w in whole]), pa.array([[identify(x) for x in c] for c in cut], pa.list_(pa.binary())), pa.array(proofs, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), *columns], names=["doc_id", "text_sha256", "recipe", "proofs"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, RECIPES)


def grouped(store: Scratch, made: DataFrame, name: str) -> DataFrame:
    """``recipe, keep_id, group_size`` of recipes that occur more than once."""
    counts = made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return store.keep(counts.filter("group_size > 1"), name)


def verified(store: Scratch, made: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and groups whose identifiers stand for one content each.

    Recipes that occur once need no check: equal texts have equal recipes.
    """
    suspects = made.join(groups.select("recipe"), "recipe", "left_semi")
    pairs = suspects.select(F.explode_outer(F.arrays_zip(F.col("recipe").alias("chunk"), F.col("proofs").alias("proof"))).alias("pair")).select("pair.*")
    collided = store.keep(pairs.groupBy("chunk").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).filter("low <> high").select("chunk"), "collided")
    if collided.isEmpty():
        return made, groups
    made = made.withColumn("recipe", F.concat("recipe", F.array(F.unhex("text_sha256"))))
    return made, grouped(store, made, "groups-verified")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: its group's survivor, size and digest."""
    spark = docs.sparkSession
    ship(spark)
    store = Scratch(spark, "exact-dedup")
    made = store.keep(recipes(docs, text, key), "recipes")
    made, groups = verified(store, made, grouped(store, made, "groups"))
    joined = made.select("doc_id", "recipe", "text_sha256").join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
