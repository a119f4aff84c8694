"""Token ids of whole texts, exactly as the tokenizers library gives them.

A byte-level BPE never merges across pre-token boundaries, so a text's ids are
the ids of its pre-tokens one after another.  Pre-tokens repeat, so each worker
keeps a bounded table from pre-token to packed ids and asks the library's
model only for those not in it.  Texts outside the range where pre-token rules are beyond
doubt (special strings, rare controls, scripts past U+058E) go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import regex

#: Fixed value: the byte-level pre-token pattern of the 50k vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unassigned characters are left out: what they count as depends on the library's Unicode version.
UNSURE = "".join(chr(c) for c in range(0x58F) if unicodedata.category(chr(c)) == "Cn")
PLAIN_ONLY = re.compile(f"[^\x00-\x1b\x20-\x84\x86-\u058e]|[{UNSURE}]")
TABLE_LIMIT = 800_000
#: Of pre-tokens at up to two bytes a character and their ids; those of ordinary prose stay far below.
TABLE_BYTES = 64 << 20


def plain_pattern() -> str:
    """``PATTERN`` with its classes spelled out as ranges up to U+058E, for the standard library's faster matcher."""
    found = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\s\L\N]").replace(r"\p{L}", r"[\L]").replace(r"\p{N}", r"[\N]")
    for name in "LN":
        members = [c for c in range(0x58F) if regex.match(rf"\p{{{name}}}", chr(c))]
        starts = [c for c in members if c - 1 not in members]
        ends = [c for c in members if c + 1 not in members]
        found = found.replace(rf"\{name}", "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip(starts, ends, strict=True)))
    return found


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class PieceTable(dict):
    """Packed ids of pre-tokens; the library's model is asked on first sight."""

    def __init__(self, model, pack):
        super().__init__()
        self.model, self.pack, self.letters, self.held = model, pack, byte_alphabet(), 0

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        found = self.pack([t.id for t in self.model.tokenize(spelled)])
        size = 2 * len(piece) + len(found)
        if len(self) >= TABLE_LIMIT or self.held + size > TABLE_BYTES:
            self.clear()
            self.held = 0
        if size <= TABLE_BYTES:
            self[piece] = found
            self.held += size
        return found


class Encoder:
    """Ids as little-endian bytes, two bytes an id where the vocabulary allows."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = re.compile(plain_pattern()).findall
        self.table = PieceTable(self.tokenizer.model, self.pack)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes() if len(ids) > 8 else b"".join([i.to_bytes(self.width, "little") for i in ids])

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null counts as empty."""
        out: list[bytes] = []
        ids_of = self.table.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif PLAIN_ONLY.search(text) or any(s in text for s in self.special):
                out.append(self.whole(text))
            else:
                out.append(b"".join(map(ids_of, self.find(text))))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
