"""Vectorised words and word hashes of whole texts, over Arrow buffers.

A word's 64-bit hash is a polynomial over scrambled bytes taken from prefix
sums, so a batch of texts costs a few array passes and no Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SCRAMBLE = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
_SECOND = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        found = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n if n > 1 << 21 else 1 << max(16, (n - 1).bit_length()), factor, U64)
            steps[0] = 1
            found.append(np.multiply.accumulate(steps))
        if n > 1 << 21:  # a word of megabytes: not kept
            return found[0], found[1]
        _POWERS[base] = found[0], found[1]
    return _POWERS[base]


def table_of(predicate) -> np.ndarray:
    return np.array([predicate(b) for b in range(256)], bool)


#: Everything but space and the controls from tab to carriage return.
NOT_SPACE = table_of(lambda b: b != 0x20 and not 9 <= b <= 13)
#: ASCII letters, digits and every byte of a non-ASCII character.
LETTERS = table_of(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of a batch: byte spans, hashes, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # text i has words first[i] .. first[i + 1]
    prefix: np.ndarray  # hashes of prefixes, then the second hash of the word, [word, which]

    def text(self, i: int) -> np.ndarray:
        return np.arange(self.first[i], self.first[i + 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end and their offsets; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def segments(data: np.ndarray, inside: np.ndarray, nbytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``nbytes`` that end outside words, so that byte-wide arrays stay small."""
    lo = 0
    while lo < len(data):
        hi = min(lo + nbytes, len(data))
        while hi < len(data):  # on to the next byte that is in no word
            ahead = np.flatnonzero(~inside[data[hi : hi + 65536]])
            hi = min(hi + 65536, len(data)) if not len(ahead) else hi + int(ahead[0])
            if len(ahead):
                break
        yield lo, hi
        lo = hi


def words_of(column: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False, prefixes: tuple[int, ...] = (), check: bool = False) -> Words:
    """Words of a batch of texts.

    ``prefixes`` also hashes the first so many bytes of each word, ``check`` the
    word once more, by a function that shares nothing with the first.
    """
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 1 + len(prefixes) + check), U64)]
    for lo, hi in segments(data, inside):
        part, n = data[lo:hi], hi - lo
        word = np.zeros(n + 2, bool)
        word[1:-1] = inside[part]
        opens, closes = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        cuts = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo  # a text's end also ends a word
        opens[cuts] = word[1:-1][cuts]
        closes[cuts - 1] = word[1:-1][cuts - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_SCRAMBLE[part] * up[:n], out=sums[1:])
        found = np.empty((len(start), 1 + len(prefixes) + check), U64)
        found[:, 0] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
        for j, size in enumerate(prefixes, 1):
            found[:, j] = mix((sums[np.minimum(end, start + size)] - sums[start]) * down[start] + U64(0x51ED270B * j))
        if check:
            up, down = _powers(n + 1, _OTHER)
            np.cumsum(_SECOND[part] * up[:n], out=sums[1:])
            found[:, -1] = mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(U64))
        starts.append(start + lo)
        ends.append(end + lo)
        hashes.append(found)
    start, every = np.concatenate(starts), np.concatenate(hashes)
    return Words(data, start, np.concatenate(ends), np.ascontiguousarray(every[:, 0]), np.searchsorted(start, offsets), every[:, 1:])


def runs(hashes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every ``k`` consecutive words; the caller heeds text ends."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    factor = 1
    for j in range(k):
        factor = (factor * base) % (1 << 64)
        total += hashes[j : j + n] * U64(factor)
    return mix(total)


def pieces(column: pa.Array, nbytes: int = 1 << 20):
    """Slices of a column holding about ``nbytes`` each, at least one text."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + nbytes, "right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi
