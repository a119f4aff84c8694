"""Connected components on DataFrames; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(store: Scratch, edges: DataFrame, name: str = "cc", seed: DataFrame | None = None) -> DataFrame:
    """``node, comp`` for every node with an edge; ``comp`` is the least node reached.

    ``edges`` has ``a, b``.  ``seed`` may give labels found earlier, as ``node,
    comp``; its nodes are all returned.  Each round takes the least label among
    neighbours, hooks the label it replaces onto it, and follows labels' own
    labels; every round is a durable table, so a lost executor costs one round.
    """
    both = store.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-edges")
    start = both.select(F.col("a").alias("node")).distinct()
    if seed is None:
        labels = start.select("node", F.col("node").alias("comp"))
    else:
        fresh = start.join(seed.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
        labels = seed.select("node", "comp").unionByName(fresh)
    labels, turn = store.keep(labels, f"{name}-0"), 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b").withColumnRenamed("comp", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        seen = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "comp", F.least("comp", F.coalesce("c", "comp")).alias("c"))
        seen = store.keep(seen, f"{name}-{turn}-seen")
        if not seen.filter("c < comp").limit(1).count():
            for old in (f"{name}-edges", f"{name}-{turn}-seen"):
                store.drop(old)
            return labels
        hooks = seen.filter("c < comp").groupBy(F.col("comp").alias("from")).agg(F.min("c").alias("to"))
        hooks = store.keep(_shortcut(store, hooks, f"{name}-{turn}"), f"{name}-{turn}-hooks")
        moved = seen.join(hooks, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = store.keep(moved, f"{name}-{turn}")
        for old in (f"{name}-{turn - 1}", f"{name}-{turn}-seen", f"{name}-{turn}-hooks"):
            store.drop(old)


def _shortcut(store: Scratch, hooks: DataFrame, name: str) -> DataFrame:
    """``from, to`` with every chain of hooks followed to its end.

    Labels only ever hook onto smaller ones, so chains end; doubling follows a
    chain of any length in as many steps as its length has bits.
    """
    step = 0
    hooks = store.keep(hooks, f"{name}-hook-0")
    while True:
        step += 1
        further = hooks.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        joined = hooks.join(further, F.col("to") == F.col("mid"), "left")
        if not joined.filter(F.col("end").isNotNull()).limit(1).count():
            return hooks
        hooks = store.keep(joined.select("from", F.coalesce("end", "to").alias("to")), f"{name}-hook-{step}")
        store.drop(f"{name}-hook-{step - 1}")
