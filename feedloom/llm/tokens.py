"""Token ids by the tokenizers library, with a memory of short pieces.

A byte-level BPE tokenizer never merges across the boundary between a
character that isn't white space and white space that follows it, nor between a
run of letters and another kind of character.  A text is cut at such
boundaries; each distinct short piece is encoded by the library once and its ids
are remembered, within a bound of bytes, so frequent words cost a look-up.  The
ids equal those of encoding the text as a whole (tested).
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode's White_Space, which the tokenizer's pattern calls \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ž"
#: A run of letters ends for the tokenizer where another kind of character follows.
pieces = re.compile(rf"[{SPACE}]*[{LETTERS}]+(?=[\x00-\x40\x5b-\x60\x7b-\x7f{SPACE}]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
#: Pieces that are one word to the tokenizer's pattern and go straight to its model.
plain = re.compile(f" ?[{LETTERS}]+").fullmatch
#: Longer pieces (scripts without spaces, encoded data) aren't remembered, and the memory is dropped beyond its bytes.
LONGEST, MEMORY_BYTES, ENTRY_BYTES = 32, 160 << 20, 220


def byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes whole texts to little-endian 16- or 32-bit ids."""

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memory: dict[str, bytes] = {}
        self.held, self.memory_bytes = 0, memory_bytes
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def _ids(self, piece: str) -> list[int]:
        if plain(piece):
            return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if self.held > self.memory_bytes:
                self.memory.clear()
                self.held = 0
            memory, cut = self.memory, pieces(text or "")
            ids = list(map(memory.get, cut))
            if None in ids:
                for i, known in enumerate(ids):
                    if known is None:
                        p = cut[i]
                        found = memory.get(p)
                        if found is None:
                            found = np.array(self._ids(p), self.dtype).tobytes()
                            if len(p) <= LONGEST:
                                memory[p] = found
                                self.held += ENTRY_BYTES + 4 * len(p) + len(found)
                        ids[i] = found
            out.append(b"".join(ids))
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, memory_bytes: int = MEMORY_BYTES) -> PieceEncoder:
    """This worker's encoder, which lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, memory_bytes)
    _encoders[path].memory_bytes = memory_bytes
    return _encoders[path]


def long_crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
