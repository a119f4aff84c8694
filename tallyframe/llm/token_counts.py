"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers run one after the other over whole texts.

* The splitter has ten states over twelve character classes.  A transition is
  annotated with the pre-tokens it begins: at the character read, or, where the
  pattern looks ahead, at the one before.  Texts stand on end with an end mark
  between them and are cut into equal chunks; every chunk's map from entry state
  to exit state is computed for all states at once, maps compose by a parallel
  prefix scan, and a second pass emits with each chunk's entry state known.
* The counter spells pre-tokens over bytes from one root.  Its states are
  prefixes, created when first met; the boundary transition of a state is
  annotated with the number of tokens the tokenizer's model emits for the
  pre-token spelled, asked once.  All pre-tokens of a batch step together.
  The table is bounded: when full it is dropped and grows anew, and
  pre-tokens that overflow an empty table are counted in halves.

Special strings split a text first and count one each, as the library has it.
A character's class is asked of the library's own split when first met, so no
Unicode version is assumed and texts in every script take this path.  Texts with
the unassigned U+0590, and vocabularies of other kinds, are counted by their
library whole.

Null and empty texts count 0 tokens in 0 bytes.  Rows are counted one by one,
repeated or not; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder
from .common import ship
from .words import U64, mix, pieces

L, N, SP, WS, O, AP, ONE, R, V, LL, E, END = range(12)
FRESH, IN_L, IN_N, IN_O, IN_SP, IN_WS, IN_AP, AP_R, AP_V, AP_L = range(10)
STATES, CLASSES = 10, 12
HERE, BEFORE = 1, 2
LANES = 4096
LONGEST = 256


def _compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions of the splitter, [class, state]."""
    step = np.zeros((CLASSES, STATES), np.uint8)
    emit = np.zeros((CLASSES, STATES), np.uint8)
    letters, inside = (L, ONE, R, V, LL, E), {L: IN_L, N: IN_N, O: IN_O}

    def simple(kind: int, state: int) -> tuple[int, int]:
        plain = L if kind in letters else kind
        if kind == END:
            return FRESH, HERE
        if kind in (SP, WS):
            return (IN_SP if kind == SP else IN_WS), (0 if state in (IN_SP, IN_WS) else HERE)
        if state == IN_SP:  # the space belongs to what follows it
            return (IN_O if kind == AP else inside[plain]), BEFORE
        late = BEFORE if state == IN_WS else 0
        if kind == AP:
            return (IN_O, 0) if state in (IN_O, IN_AP) else (IN_AP, HERE | late)
        if state == IN_AP:
            ends = {ONE: FRESH, R: AP_R, V: AP_V, LL: AP_L}
            if kind in ends:
                return ends[kind], 0
            return inside[plain], (0 if kind == O else HERE)
        return inside[plain], (0 if inside[plain] == state else HERE) | late

    for kind in range(CLASSES):
        for state in range(STATES):
            if state in (AP_R, AP_V, AP_L):
                if kind == (LL if state == AP_L else E):
                    step[kind, state], emit[kind, state] = FRESH, 0
                else:  # no contraction: the letter began a pre-token
                    to, out = simple(kind, IN_L)
                    step[kind, state], emit[kind, state] = to, out | BEFORE
            else:
                step[kind, state], emit[kind, state] = simple(kind, state)
    return step, emit


def ask_classes(tokenizer, codes: np.ndarray) -> np.ndarray:
    """Classes of characters: which of a letter, a digit and a sign the library's own split lets them follow."""
    out = np.full(len(codes), WS, np.uint8)
    for lead, kind in (("a", L), ("1", N), ("!", O)):
        probe = "".join(f"{lead}{chr(c)}\n" for c in codes.tolist())
        cut = np.zeros(len(probe) + 1, bool)
        cut[[lo for _, (lo, _) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]] = True
        out[~cut[1::3][: len(codes)]] = kind
    return out


class Classes:
    """Class of every character, asked of the library when a character is first met."""

    def __init__(self, enc: Encoder):
        self.tokenizer, self.of = enc.tokenizer, np.full(0x110000, UNKNOWN, np.uint8)
        self.of[MARK] = END
        self(np.delete(np.arange(0x250, dtype=np.uint32), ord(" ")))
        for kind, members in ((SP, " "), (AP, "'"), (ONE, "stmd"), (R, "r"), (V, "v"), (LL, "l"), (E, "e")):
            for c in members:
                self.of[ord(c)] = kind

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.of[codes]
        if kinds.max() == UNKNOWN:
            fresh = np.unique(codes[kinds == UNKNOWN])
            self.of[fresh] = ask_classes(self.tokenizer, fresh)
            kinds = self.of[codes]
        return kinds


STEP, EMIT = _compile_splitter()
#: Unassigned, and of two bytes; a text that holds it is counted by the library.
MARK, UNKNOWN = 0x590, 255


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of chunk maps, [chunk, state], in log steps."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return maps


def split(kinds: np.ndarray) -> np.ndarray:
    """Flags of the positions at which a pre-token begins."""
    n = len(kinds)
    width = max(1, -(-n // LANES))
    lanes = -(-n // width)
    grid = np.full(lanes * width, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T).astype(np.intp) * STATES
    flat_step, flat_emit = STEP.ravel(), EMIT.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for column in grid:
        maps = flat_step[column[:, None] + maps]
    state = np.concatenate([[FRESH], compose_scan(maps)[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((width, lanes), np.uint8)
    for at, column in enumerate(grid):
        cell = column + state
        out[at] = flat_emit[cell]
        state = flat_step[cell]
    emitted = np.ascontiguousarray(out.T).ravel()
    begins = (emitted & HERE) > 0
    begins[:-1] |= (emitted[1:] & BEFORE) > 0
    return begins[:n]


class Counter:
    """The lazily built transducer from pre-tokens to numbers of tokens."""

    SLOTS, MOST = 1 << 22, 2_400_000

    def __init__(self, enc: Encoder):
        self.model, self.letters, self.classes = enc.table.model, enc.table.letters, Classes(enc)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.child = np.zeros(self.SLOTS, np.uint32)
        self.tokens = np.full(self.MOST + 1, -1, np.int32)
        self.size = 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> U64(42)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Child for each key, 0 where the transition doesn't exist yet."""
        slot, found = self._slot(key), np.zeros(len(key), np.uint32)
        todo = np.arange(len(key))
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            found[todo[hit]] = self.child[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
            slot[todo] = (slot[todo] + 1) & (self.SLOTS - 1)
        return found

    def _add(self, key: np.ndarray, child: np.ndarray) -> None:
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = key[todo[free]]
            won = self.keys[slot[todo]] == key[todo]
            self.child[slot[todo[won]]] = child[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (self.SLOTS - 1)

    def ask(self, spelled: bytes) -> int:
        return len(self.model.tokenize(spelled.decode("latin-1").translate(self.letters)))

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of every pre-token ``data[start : start + size]``."""
        out = np.zeros(len(start), np.int64)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        far = int(np.searchsorted(-size, -LONGEST))
        counts = np.zeros(len(start), np.int64)
        for i in range(far):
            counts[i] = self.ask(data[start[i] : start[i] + size[i]].tobytes())
        begin, length = start[far:], size[far:]
        if len(begin):
            counts[far:] = self._lockstep(data, begin, length)
        out[order] = counts
        return out

    def _lockstep(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        state = np.ones(len(begin), np.uint64)
        live, empty = len(begin), self.size == 1
        for at in range(int(length[0])):
            live = int(np.searchsorted(-length, -at - 1, "right"))
            key = (state[:live] << U64(8)) | data[begin[:live] + at].astype(U64)
            found = self._find(key)
            if (found == 0).any():
                fresh = np.unique(key[found == 0])
                if self.size + len(fresh) >= self.MOST:
                    self.reset()
                    if not empty:
                        return self._lockstep(data, begin, length)
                    if len(begin) == 1:
                        return np.array([self.ask(data[begin[0] : begin[0] + length[0]].tobytes())])
                    half = len(begin) // 2
                    return np.concatenate([self._lockstep(data, begin[:half], length[:half]), self._lockstep(data, begin[half:], length[half:])])
                self._add(fresh, np.arange(self.size + 1, self.size + 1 + len(fresh), dtype=np.uint32))
                self.size += len(fresh)
                found = self._find(key)
            state[:live] = found
        state = state.astype(np.int64)
        unknown, lane = np.unique(state[self.tokens[state] < 0], return_index=True)
        where = np.flatnonzero(self.tokens[state] < 0)[lane]
        for node, i in zip(unknown.tolist(), where.tolist(), strict=True):
            self.tokens[node] = self.ask(data[begin[i] : begin[i] + length[i]].tobytes())
        return self.tokens[state]


def count_texts(enc: Encoder, counter: Counter, texts: list[str]) -> np.ndarray:
    """Numbers of tokens of whole texts."""
    total = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        if chr(MARK) in text:
            total[i] = len(enc.tokenizer.encode(text, add_special_tokens=False).ids)
            continue
        spans = [text]
        for special in enc.special:
            spans = [x for span in spans for x in span.split(special)]
        total[i] += len(spans) - 1
        parts += [s for s in spans if s]
        owner += [i] * sum(1 for s in spans if s)
    if not parts:
        return total
    joined = chr(MARK).join(parts) + chr(MARK)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begins = split(counter.classes(codes))
    marks = codes == MARK
    begins |= marks
    width = 1 + (codes >= 0x80).astype(np.int64)
    if codes.max() >= 0x800:
        width += (codes >= 0x800).astype(np.int64) + (codes >= 0x10000)
    bytes_before = np.concatenate([[0], np.cumsum(width)])
    heads = np.flatnonzero(begins)
    start = bytes_before[heads]
    size = np.diff(np.append(start, bytes_before[-1]))
    real = ~marks[heads]
    data = np.frombuffer(joined.encode(), np.uint8)
    counts = counter.count(data, start[real], size[real])
    of = np.cumsum(marks)[heads[real]]
    total += np.bincount(np.array(owner)[of], counts, len(texts)).astype(np.int64)
    return total


_COUNTERS: dict[str, Counter] = {}


def _count_fst(tokenizer: str, column: pa.Array) -> np.ndarray:
    enc = encoder(tokenizer)
    counter = _COUNTERS.setdefault(tokenizer, Counter(enc))
    return np.concatenate([np.zeros(0, np.int64), *(count_texts(enc, counter, part.to_pylist()) for _, part in pieces(column))])


def _count_library(tokenizer: str, column: pa.Array) -> np.ndarray:
    texts = column.fill_null("").to_pylist()
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64)
    return np.array([len(e.ids) for e in encoder(tokenizer).tokenizer.encode_batch(texts, add_special_tokens=False)], np.int64)


def compiles(tokenizer: str) -> bool:
    """Whether a vocabulary is of the kind the transducers are built for."""
    if not tokenizer.endswith(".json"):
        return False
    import json

    with open(tokenizer) as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    return spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text."""
    ship(docs.sparkSession)
    count = _count_fst if compiles(tokenizer) else _count_library

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = count(tokenizer, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(F.col(key).cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
