"""Benchmark decontamination by winnowed fingerprints.

Words of both sides are hashed in runs of ``GRAM``; every ``SPAN`` consecutive
hashes contribute their minimum.  A shared run of ``GRAM + SPAN - 1`` = 10
words holds a full span on both sides, so it always shares a fingerprint.
Hits are extended on whole words: where a document's span has a benchmark
fingerprint, the window that starts there is cut from the text, in the pass that
hashed it, and compared with the benchmark's windows.

Items of fewer words than a window are one window as they stand.  Winnowing
can't promise such short runs, so theirs start from the item's longest word: each
place that holds it gives the run that would be the item.

Only built-in expressions run, and every text is read and split once.  That pass
broadcasts the sought hashes, which are counted first; beyond ``BROADCAST_ROWS``
documents with one are found by a shuffle, and all their windows are compared.
Smaller tables are broadcast below a counted number of rows and of bytes.

Null and wordless texts have no words and no hits, and wordless items no
windows; a null item id makes hits but is not listed.  Repeated rows of
documents are judged one by one, repeated items and ties between items are
listed once an id.  Empty tables on either side work.  Extra columns of the
documents don't matter to ``report`` and come back from ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, unused

WINDOW, GRAM, SPAN = 10, 5, 6
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Fixed value: everything that is not part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same, from the other side and before lower-casing, to count words without making them.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def _least(hashes: Column) -> Column:
    return F.transform(hashes, lambda g, i: F.least(g, *[F.get(hashes, i + j) for j in range(1, SPAN)]))


def with_fingerprints(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__words``, ``__codes``, ``__grams`` and ``__prints`` step by step, each computed once.

    A word is hashed once, and a gram is a hash of its words' hashes.
    """
    code = F.col("__codes")
    hashed = df.withColumn("__words", words(F.col(text))).withColumn("__codes", F.transform("__words", lambda w: F.xxhash64(w)))
    hashed = hashed.withColumn("__grams", F.transform(code, lambda c, i: F.xxhash64(c, *[F.get(code, i + j) for j in range(1, GRAM)])))
    return hashed.withColumn("__prints", _least(F.col("__grams")))


def windows(word: Column, length: Column | int) -> Column:
    """Texts of all runs of ``length`` words, in order."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.when(F.size(word) >= length, F.sequence(F.lit(1), F.size(word) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(word, i, length)))


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows and their bytes, both counted, are few."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n_rows, n_bytes = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES else df


def spans_in_place(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Runs of words that start where a sought key says they do, cut from the text in the pass that hashes it.

    ``keys`` is broadcast and holds ``__key``, the run's ``__length`` and ``__shift``,
    how far before the key it starts.  Every row also gives one run of length 0,
    at the place behind all its hashes.
    """
    count, place = F.col("n_words"), F.col("__pos")
    hashed = with_fingerprints(rows, "__text").withColumn("n_words", F.size("__words"))
    unfolded = hashed.select("__id", "__hash", "n_words", "__words", F.posexplode(F.concat(*columns, F.array(F.lit(0).cast("long")))).alias("__pos", "__key"))
    marks = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("__key"), F.lit(0).alias("__length"), F.lit(0).alias("__shift"))
    last = place == count * len(columns)
    start = F.when(place >= count, place - count).otherwise(place) - F.col("__shift")
    met = unfolded.join(F.broadcast(keys.unionByName(marks)), "__key").filter(last == (F.col("__length") == 0))
    met = met.withColumn("__at", F.when(last, F.lit(0)).otherwise(start)).filter((F.col("__at") >= 0) & (F.col("__at") + F.col("__length") <= count))
    return met.select("__id", "__hash", "n_words", "__at", "__length", F.when(~last, F.concat_ws(" ", F.slice("__words", F.col("__at") + 1, F.col("__length")))).alias("__window"))


def spans_of_candidates(rows: DataFrame, keys: DataFrame, columns: list[str], lengths: list[int], store: Scratch) -> DataFrame:
    """The same for more keys than can be broadcast: all runs of the rows that hold a key, found by a shuffle."""
    hashed = with_fingerprints(rows, "__text").select("__id", "__hash", F.explode_outer(F.array_distinct(F.concat(*columns))).alias("__key"))
    holders = hashed.join(keys.select("__key").distinct(), "__key", "left_semi").select(F.col("__id").alias("__cid"), F.col("__hash").alias("__chash"))
    candidates = _few(store.keep(holders.distinct(), "candidates"))
    same = F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__hash") == F.col("__chash"))
    worded = rows.join(candidates, same, "left_semi").withColumn("__words", words(F.col("__text")))
    spans = counted(rows)
    for n in lengths:
        runs = worded.select("__id", "__hash", F.size("__words").alias("n_words"), F.posexplode(windows(F.col("__words"), n)).alias("__at", "__window"))
        spans = spans.unionByName(runs.withColumn("__length", F.lit(n)))
    return spans


def counted(rows: DataFrame) -> DataFrame:
    """The run of length 0 of every row."""
    n_words = F.coalesce(F.regexp_count(F.col("__text"), F.lit(WORD)), F.lit(0))
    return rows.select("__id", "__hash", n_words.alias("n_words"), F.lit(0).alias("__at"), F.lit(0).alias("__length"), F.lit(None).cast("string").alias("__window"))


def hits(docs: DataFrame, benchmark: DataFrame, store: Scratch, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``__id, __hash, n_words`` of every row, and ``__id, __hash, n_hit, items`` of those that hold a benchmark window.

    ``__hash`` tells apart rows that share an id but not a text.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("__text"))
    items = with_fingerprints(items, "__text").filter(F.size("__words") > 0).withColumn("__length", F.least(F.size("__words"), F.lit(WINDOW)))
    items = store.keep(items.drop("__text", "__codes", "__grams"), "items")
    wanted = store.keep(items.select("item", "__length", F.explode(windows(F.col("__words"), F.col("__length"))).alias("__window")).distinct(), "windows")
    lengths = sorted(r[0] for r in wanted.select("__length").distinct().collect())  # at most ten values
    rows = docs.select(F.col(key).alias("__id"), F.xxhash64(F.col(text)).alias("__hash"), F.col(text).alias("__text"))

    sought = {}
    if WINDOW in lengths:
        full = F.explode(F.slice("__prints", F.lit(1), F.size("__words") - WINDOW + 1)).alias("__key")
        sought["__prints"] = items.filter(F.col("__length") == WINDOW).select(full, "__length", F.lit(0).alias("__shift"))
    if any(n < WINDOW for n in lengths):
        longest = F.element_at(F.array_sort(F.transform("__words", lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), 1)
        sought["__codes"] = items.filter(F.col("__length") < WINDOW).select(longest.alias("__a"), "__length").select(F.xxhash64("__a.w").alias("__key"), "__length", F.col("__a.i").alias("__shift"))
    spans = counted(rows)
    if sought:
        keys = None
        for part in sought.values():
            keys = part if keys is None else keys.unionByName(part)
        keys = store.keep(keys.distinct(), "keys")
        if keys.count() <= BROADCAST_ROWS:
            spans = spans_in_place(rows, keys, list(sought))
        else:
            spans = spans_of_candidates(rows, keys, list(sought), lengths, store)
    spans = store.keep(spans, "spans")
    texts = _few(store.keep(wanted.select("__window").distinct().withColumn("__wid", F.xxhash64("__window")), "texts"))
    ends = F.col("__at") + F.col("__length")
    # a repeated row hits where its twin does
    matched = store.keep(spans.filter("__length > 0").join(texts, "__window").select("__id", "__hash", "__at", ends.alias("__end"), "__wid"), "matched")

    def cover(acc: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["__end"] - F.greatest(span["__at"], acc["end"]))
        return F.struct(F.greatest(acc["end"], span["__end"]).alias("end"), (acc["n"] + fresh).cast("long").alias("n"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = matched.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set(F.struct("__at", "__end"))).alias("s")).select("__id", "__hash", F.aggregate("s", zero, cover, lambda acc: acc["n"]).alias("n_hit"))
    owners = wanted.select(F.xxhash64("__window").alias("__wid"), "item").distinct()
    listed = matched.select("__id", "__hash", "__wid").distinct().join(owners, "__wid").groupBy("__id", "__hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("__id").alias("__lid"), F.col("__hash").alias("__lhash"), "items")
    found = covered.join(listed, F.col("__id").eqNullSafe(F.col("__lid")) & (F.col("__hash") == F.col("__lhash")), "left")
    found = store.keep(found.select("__id", "__hash", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "hits")
    return spans.filter("__length = 0").select("__id", "__hash", "n_words"), found


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: words, words hit, items found, verdict."""
    store = Scratch(docs.sparkSession, "decontam")
    rows, found = hits(docs, benchmark, store, text, key, item, item_text)
    rows = rows.select(F.col("__id").alias(key), F.col("__hash").alias("__dhash"), F.col("n_words").cast("long").alias("n_words"))
    found = _few(found)
    joined = rows.join(found, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__dhash") == F.col("__hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(key, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    store = Scratch(docs.sparkSession, "decontam")
    own, hashed = unused(docs.columns, "__id", "__hash")
    found = _few(hits(docs, benchmark, store, text, key)[1].select(F.col("__id").alias(own), F.col("__hash").alias(hashed)))
    return docs.join(found, F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(hashed)), "left_anti")
