"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is the sum of three rows of one embedding table, picked by the hashes of
the whole word and of its first four and six bytes, so inflected and compounded
forms share weight.  Filters of one, two and three words slide over the whole
text, each is max-pooled, and a logistic layer reads the maxima.  Training is
plain numpy on the driver, on at most ``max_rows`` labelled rows, of which four
bytes a bucket are kept; its first embedding dimension starts at each bucket's association with the label.
Scores are Platt-scaled on labelled rows held back from fitting, and a decision
threshold is calibrated on those rows for each language.

Only the text enters a score.  Language is used afterwards, to pick the
threshold for ``rejected``.  For scoring, convolutions are folded into the
table, so a word costs a few row sums.

Null, empty and wordless texts get the score of maxima of zero.  Repeated
documents get equal scores; a document labelled twice counts as toxic if either
label is.  Null labels are ignored; with no labels, or labels of one class, all
scores are the base rate (0 without any).  Empty tables give no rows.  Extra
columns don't matter to ``score`` and come back from ``keep_clean``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import LETTERS, U64, pieces, words_of

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
PREFIXES = (4, 6)
MAX_ROWS = 8000
THRESHOLD = 0.7


SPAN_WORDS = 1 << 16


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's range of words, and the words' buckets, [word, 1 + prefixes].

    Taken a piece at a time: what stays is four bytes a bucket.
    """
    firsts, buckets = [np.zeros(1, np.int64)], [np.zeros((0, 1 + len(PREFIXES)), np.int32)]
    for _, part in pieces(column):
        words = words_of(part, LETTERS, lower=True, prefixes=PREFIXES)
        out = np.empty((len(words.hash), 1 + len(PREFIXES)), np.int32)
        out[:, 0] = words.hash >> U64(48)
        out[:, 1:] = words.prefix >> U64(48)
        firsts.append(words.first[1:] + firsts[-1][-1])
        buckets.append(out)
    return np.concatenate(firsts), np.concatenate(buckets)


def spans_of(first: np.ndarray, most: int = SPAN_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about ``most`` words, as owner, begin and end of spans.

    A longer text gives several spans, overlapping by all but one word of the
    widest filter; no window is lost, and the maximum of the spans' is the text's.
    """
    lap, lo, n = max(WIDTHS) - 1, 0, len(first) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most, "right")) - 1)
        if first[hi] - first[lo] <= most:
            yield np.arange(lo, hi), first[lo:hi], first[lo + 1 : hi + 1]
        else:
            for at in range(int(first[lo]), int(first[hi]), most):
                yield np.array([lo]), np.array([at]), np.array([min(at + most + lap, first[hi])])
        lo = hi


@dataclass
class Model:
    """Folded tables: ``tables[i]`` maps a bucket to its part of every filter."""

    tables: list[np.ndarray] = field(default_factory=list)  # for each width, [bucket, offset * filter]
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    intercept: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    base: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, column: pa.Array) -> np.ndarray:
        return self.score_buckets(*features(column))

    def score_buckets(self, first: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.full(len(first) - 1, self.base)
        active = np.zeros((len(first) - 1, len(self.dense)), np.float32)
        for owner, lo, hi in spans_of(first):
            own = buckets[lo[0] : hi[-1]]
            pooled = pool(np.append(lo, hi[-1]) - lo[0], [sum(t[own[:, j]] for j in range(own.shape[1])) for t in self.tables], self.bias)[0]
            active[owner] = np.maximum(active[owner], pooled)
        logit = active.astype(np.float64) @ self.dense + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def pool(first: np.ndarray, parts: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max over each text of every filter, and the word at which it stands.

    A window that would run past its text's end is left out; a text with no
    window for a width has maximum 0 and place -1.
    """
    n = len(first) - 1
    best, place = [], []
    for width, part in zip(WIDTHS, parts, strict=True):
        total = part[:, :FILTERS].copy()
        for j in range(1, width):
            total[:-j] += part[j:, j * FILTERS : (j + 1) * FILTERS]
        hi = np.zeros((n, FILTERS), np.float32)
        at = np.full((n, FILTERS), -1, np.int64)
        some = np.flatnonzero(np.diff(first) >= width)
        if len(some):
            last = np.zeros(len(total) + 1, bool)  # starts too near a text's end
            for j in range(1, width):
                ends = first[1:] - j
                last[ends[(ends >= first[:-1])]] = True
            total[last[:-1]] = -np.inf
            hi[some] = np.maximum.reduceat(total, first[some], axis=0) if len(some) == n else np.stack([total[first[i] : first[i + 1]].max(axis=0) for i in some])
            hi[some] += bias[len(best) * FILTERS : (len(best) + 1) * FILTERS]
        best.append(hi)
        place.append((some, total))
    return np.concatenate(best, axis=1), place


def train(texts: pa.Array, labels: np.ndarray, langs: list[str | None], seed: int = 7, epochs: int = 6, rate: float = 0.02) -> Model:
    """Fit on four fifths of the rows, calibrate on the rest."""
    labels = np.asarray(labels, np.float32)
    base = float(labels.mean()) if len(labels) else 0.0
    if len(labels) < 20 or base in (0.0, 1.0):
        return Model(base=base)
    first, buckets = features(texts)
    n = len(texts)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(n)
    held, fit = fold[: n // 5], fold[n // 5 :]
    if len(np.unique(labels[fit])) < 2 or len(np.unique(labels[held])) < 2:
        held = fit = fold

    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in fit:
        own = np.unique(buckets[first[i] : first[i + 1]])
        seen[own] += 1
        toxic[own] += labels[i]
    rate_fit = labels[fit].mean()
    table[:, 0] = np.clip((toxic - seen * rate_fit) / np.sqrt(seen * rate_fit * (1 - rate_fit) + 1), -2, 8) / 8
    kernels = [rng.normal(0, 0.3, (DIM, w * FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[0] = np.abs(kernel[0]) + 0.3
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    dense = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
    intercept = np.array([np.log(rate_fit / (1 - rate_fit))], np.float32)
    params = [*kernels, bias, dense, intercept]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    square = np.full(BUCKETS, 1e-3, np.float32)
    weight = np.where(labels > 0, 0.5 / rate_fit, 0.5 / (1 - rate_fit)).astype(np.float32)
    steps = 0
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            spans = [np.arange(first[i], first[i + 1]) for i in chunk]
            rows = np.concatenate(spans)
            if not len(rows):
                continue
            own_first = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            ids = buckets[rows]
            x = table[ids].sum(axis=1)
            pooled, places = pool(own_first, [np.einsum("nd,df->nf", x, k) for k in kernels], bias)
            active = np.maximum(pooled, 0)
            guess = 1 / (1 + np.exp(-np.clip(active @ dense + intercept[0], -30, 30)))
            delta = weight[chunk] * (guess - labels[chunk]) / len(chunk)
            grad = [np.zeros_like(p) for p in params]
            grad[-2][:] = active.T @ delta
            grad[-1][0] = delta.sum()
            back = np.outer(delta, dense) * (pooled > 0)
            grad[-3][:] = back.sum(axis=0)
            dx = np.zeros_like(x)
            for w, (width, (some, total)) in enumerate(zip(WIDTHS, places, strict=True)):
                mine = back[:, w * FILTERS : (w + 1) * FILTERS]
                for i in some:
                    if not mine[i].any():
                        continue
                    at = own_first[i] + total[own_first[i] : own_first[i + 1]].argmax(axis=0)
                    for j in range(width):
                        columns = np.arange(j * FILTERS, (j + 1) * FILTERS)
                        grad[w][:, columns] += x[at + j].T * mine[i]
                        np.add.at(dx, at + j, mine[i][:, None] * kernels[w][:, columns].T)
            steps += 1
            for p, g, m in zip(params, grad, moment, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9**steps)) / (np.sqrt(m[1] / (1 - 0.999**steps)) + 1e-7)
            touched = np.flatnonzero(dx.any(axis=1))
            for j in range(ids.shape[1]):
                np.add.at(square, ids[touched, j], (dx[touched] ** 2).mean(axis=1))
                np.add.at(table, ids[touched, j], -rate * dx[touched] / np.sqrt(square[ids[touched, j]])[:, None])
    model = Model([table @ k for k in kernels], bias, dense, float(intercept[0]), base=base)
    _calibrate(model, model.score_buckets(first, buckets)[held], labels[held], [langs[i] for i in held])
    return model


def _calibrate(model: Model, raw: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Platt parameters, and each language's threshold, from uncalibrated scores."""
    logit = np.log(np.clip(raw, 1e-9, 1 - 1e-9) / np.clip(1 - raw, 1e-9, 1))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps on the two Platt parameters, lightly ridged
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        g = np.array([((p - labels) * logit).sum() + 0.1 * (a - 1), (p - labels).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
        if np.abs(move).max() < 1e-8:
            break
    model.scale, model.shift = max(float(a), 0.05), float(b)
    scores = 1 / (1 + np.exp(-np.clip(model.scale * logit + model.shift, -30, 30)))
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        s, y = scores[own], labels[own]
        if y.sum() < 10 or (1 - y).sum() < 10:
            continue
        grid = np.unique(np.append(np.round(np.linspace(0.3, 0.95, 66), 2), THRESHOLD))
        f1 = np.array([2 * (y[s >= t]).sum() / max(1, (s >= t).sum() + y.sum()) for t in grid])
        best = grid[f1 >= f1.max() - 1e-9]
        model.thresholds[lang] = float(best[np.abs(best - THRESHOLD).argmin()])


def hash_of(text: pa.Scalar) -> int:
    """Puts rows that share an id in one order."""
    return zlib.crc32((text.as_py() or "").encode())


def remainder(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", key: str = "doc_id", lang: str = "lang") -> Model:
    """Train on labelled rows outside the held-out third, ``max_rows`` at most.

    The sample is the rows whose ids hash lowest, so it is the same each time.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key)) != 1)).groupBy(F.col(key).alias("__id")).agg(F.max("toxic").alias("__toxic"))
    sample = usable.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)  # bounded by max_rows, so broadcast
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang")).join(F.broadcast(sample), "__id").toArrow()
    order = sorted(range(len(rows)), key=list(zip(rows["__id"].to_pylist(), (hash_of(t) for t in rows["__text"]), strict=True)).__getitem__)
    rows = rows.take(pa.array(order, pa.int64())).combine_chunks()
    texts = rows["__text"].cast(pa.large_string()).combine_chunks()
    return train(texts, rows["__toxic"].to_numpy().astype(np.float32), rows["__lang"].to_pylist())


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, rejected`` of every text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.score(batch.column(3))
            level = np.array([own.thresholds.get(x, THRESHOLD) for x in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(level), pa.array(scores >= level)], names=["doc_id", "held_out", "score", "predicted", "threshold", "rejected"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(key)) == 1, F.lit(False)).alias("held_out"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.score(batch.column(at_text))
            level = np.array([own.thresholds.get(x, THRESHOLD) for x in batch.column(at_lang).to_pylist()], np.float64)
            yield batch.filter(pa.array(scores < level))

    return docs.mapInArrow(run, docs.schema)
