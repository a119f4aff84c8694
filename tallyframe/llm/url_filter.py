"""URL filtering with a bit-parallel wildcard automaton.

Every rule is a glob over a canonical URL.  All globs are packed side by side
into 64-bit words and simulated together by extended Shift-And: per byte of
input one shift, one AND with the byte's transition mask and one OR with its
self-loop mask advance every pattern at once.

Glob syntax: ``**`` matches any run of bytes, ``*`` any run without ``/``,
everything else itself.

Null, empty and malformed URLs have empty host and path; they match no host
rule.  Repeated rows are judged one by one; ties between rules of equal length
go to the rule listed first.  Extra columns are carried through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

STAR, DEEP = 256, 257
FEW = 8


@dataclass(frozen=True)
class Rule:
    """``verdict`` is ``allow`` or ``block``; ``label`` is reported on a match."""

    glob: str
    verdict: str
    label: str | None = None
    weight: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule on a host, all its subdomains and every path with this prefix.

    Canonical URLs start with a dot, so ``*.host`` covers the host itself, and
    ``*`` can't cross the slash where the path begins.
    """
    return Rule(f"*.{host}{path}**", verdict, host + path, len(host + path))


def glob_rule(glob: str, verdict: str) -> Rule:
    return Rule(glob, verdict)


class ShiftAnd:
    """Multiword Shift-And simulation of many globs at once."""

    def __init__(self, globs: Sequence[str]):
        states: list[tuple[int, set[int]]] = []  # symbol entering the state (-1: start), loops
        finals = []
        for glob in globs:
            states.append((-1, set()))
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i] == 0x2A:
                    deep = data[i : i + 2] == b"**"
                    states[-1][1].add(DEEP if deep else STAR)
                    i += 1 + deep
                else:
                    states.append((data[i], set()))
                    i += 1
            finals.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for at, (symbol, loops) in enumerate(states):
            word, bit = at >> 6, np.uint64(1 << (at & 63))
            if symbol < 0:
                self.start[word] |= bit
            else:
                self.step[symbol, word] |= bit
            if loops:
                self.loop[:, word] |= bit
                if DEEP not in loops:
                    self.loop[0x2F, word] &= ~bit
        self.finals = np.array(finals, np.int64)
        self.wide: list[tuple[int, int]] | None = None

    def run_on(self, state: int, data: bytes) -> int:
        """The automaton over one text from a state on, as one number of all words."""
        if self.wide is None:
            self.wide = [(int.from_bytes(self.step[b].tobytes(), "little"), int.from_bytes(self.loop[b].tobytes(), "little")) for b in range(256)]
        wide = self.wide
        for byte in data:
            step, loop = wide[byte]
            state = ((state << 1) & step) | (state & loop)
        return state

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix, texts x globs.  Lanes leave as their text ends."""
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])[order] if n else size
        size = size[order]
        state = np.tile(self.start, (n, 1))
        live, few = n, []
        carry = np.zeros((n, self.words), np.uint64)
        for at in range(int(size[0]) if n else 0):
            while live and size[live - 1] <= at:
                live -= 1
            if live <= FEW:
                few = list(range(live))
                break
            now = state[:live]
            byte = data[begin[:live] + at]
            moved = carry[:live]
            np.left_shift(now, np.uint64(1), out=moved)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.step[byte]
            now &= self.loop[byte]
            now |= moved
        for lane in few:  # the rest of the longest texts, a whole state at a time
            rest = data[begin[lane] + at : begin[lane] + size[lane]].tobytes()
            state[lane] = np.frombuffer(self.run_on(int.from_bytes(state[lane].tobytes(), "little"), rest).to_bytes(8 * self.words, "little"), np.uint64)
        bits = (state[:, self.finals >> 6] >> (self.finals & 63).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, len(self.finals)), bool)
        out[order] = bits.astype(bool)
        return out


def judge(df: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` and ``verdict`` to ``df``.

    Labelled rules decide first, the heaviest one winning; then unlabelled
    globs, block before allow; then ``default``.
    """
    ship(df.sparkSession)
    labelled = sorted((r for r in rules if r.label is not None), key=lambda r: -r.weight)
    plain = [r for r in rules if r.label is None]
    ordered = labelled + [r for r in plain if r.verdict == "block"] + [r for r in plain if r.verdict != "block"]
    labels = [r.label for r in ordered] + [None]
    verdicts = [r.verdict for r in ordered] + [default]
    machine = ShiftAnd([r.glob for r in ordered])

    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url))))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    added = {"host": host, "path": path}
    framed = df.select(*[c for c in df.columns if c not in {"host", "path", "rule", "verdict"}], *[c.alias(n) for n, c in added.items()])
    schema = T.StructType([*framed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            hits = machine.match([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            hits = np.concatenate([hits, np.ones((len(hosts), 1), bool)], axis=1)
            first = hits.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([labels[i] for i in first], pa.string()), pa.array([verdicts[i] for i in first], pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return framed.mapInArrow(run, schema)
