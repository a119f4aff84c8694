"""Removal of lines that are boilerplate of their site.

Documents are grouped by site.  A line's frequency is the number of the site's
documents that contain it over all the site's documents; lines above
``max_ratio`` are dropped from every document of that site.  ``min_pages``
keeps lines that too few documents share to say anything, as on tiny sites.
With ``small_ratio`` it gives way on sites of fewer than ``min_pages / max_ratio``
documents: there lines above that ratio go too, if three documents have them.

With ``per_text`` a site's documents are its distinct texts, so a group of copies
counts as one page and doesn't make its own lines boilerplate.

Lines are compared after trimming blanks, tabs and carriage returns; lines
that are then empty are never boilerplate.  A null site is a site of its own,
a null text stays null, repeated rows count one by one, an empty table gives
no rows, and all columns of the input come back.

Only built-in expressions run.  Lines travel as 128-bit hashes, pre-aggregated
before the shuffle, so a hot site or line costs a row for each map task.  The
boilerplate of a site is at most (mean lines a document) / ``max_ratio`` lines;
it is broadcast below a checked number and joined by a skew-safe shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused

BROADCAST_LINES = 200_000
LEAST_PAGES = 3


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, to group pages by where documents have a site."""
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(" \t\r"))
    return F.when(F.length(trimmed) > 0, F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b")))


def line_counts(docs: DataFrame, site: str = "source", text: str = "text", per_text: bool = False) -> DataFrame:
    """``site, key, pages, site_pages`` for every line of every site."""
    split = F.split(F.col(text), "\n")
    keys = F.array_distinct(F.filter(F.transform(split, line_key), lambda k: k.isNotNull()))
    pages = docs.select(F.col(site).alias("__site"))
    lines = docs.select(F.col(site).alias("__site"), F.explode(keys).alias("__key"))
    if per_text:
        hashed = docs.select(F.col(site).alias("__site"), F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), F.col(text)).alias("__b"), keys.alias("__keys"))
        pages = hashed.groupBy("__site", "__a", "__b").agg(F.first("__keys").alias("__keys"))
        lines = pages.select("__site", F.explode("__keys").alias("__key"))
    lines = lines.groupBy("__site", "__key").agg(F.count("*").alias("__pages"))
    sites = pages.groupBy(F.col("__site").alias("__of")).agg(F.count("*").alias("__site_pages"))
    return lines.join(sites, F.col("__site").eqNullSafe(F.col("__of"))).drop("__of")


def boilerplate(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 10, site: str = "source", text: str = "text", small_ratio: float | None = None, per_text: bool = False) -> DataFrame:
    """``__site, __key`` of lines whose site-relative frequency exceeds the ratio."""
    pages, site_pages = F.col("__pages"), F.col("__site_pages")
    common = (pages >= min_pages) & (pages > site_pages * max_ratio)
    if small_ratio is not None:
        common |= (site_pages * max_ratio < min_pages) & (pages >= LEAST_PAGES) & (pages > site_pages * small_ratio)
    return line_counts(docs, site, text, per_text).filter(common).select("__site", "__key")


def line_dedup(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 10, site: str = "source", text: str = "text", small_ratio: float | None = None, per_text: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out, plus ``n_lines`` and ``n_dropped``."""
    store = Scratch(docs.sparkSession, "line-dedup")
    drop = store.keep(boilerplate(docs, max_ratio, min_pages, site, text, small_ratio, per_text), "boilerplate")
    of, listed, left = unused(docs.columns, "__of", "__drop", "__kept")
    by_site = drop.groupBy(F.col("__site").alias(of)).agg(F.collect_list("__key").alias(listed))
    if drop.count() <= BROADCAST_LINES:
        by_site = F.broadcast(by_site)
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(F.col(listed), line_key(line)), F.lit(False)))
    joined = docs.join(by_site, F.col(site).eqNullSafe(F.col(of)), "left")
    cleaned = joined.withColumn(left, F.when(F.col(listed).isNull(), lines).otherwise(kept))
    n_lines, n_kept = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(left), F.lit(0))
    n_lines, n_kept = F.greatest(n_lines, F.lit(0)), F.greatest(n_kept, F.lit(0))
    made = {text: F.array_join(left, "\n"), "n_lines": n_lines.cast("long"), "n_dropped": (n_lines - n_kept).cast("long")}
    return cleaned.select(*[made[c].alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], made["n_lines"].alias("n_lines"), made["n_dropped"].alias("n_dropped"))
