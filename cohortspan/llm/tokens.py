"""Token ids of whole texts through a public tokenizer file, with a bounded cache of pieces.

A text is cut at ASCII white space and each chunk is encoded once, as long as the
cache holds it. That gives the ids of the whole text, because the tokenizer's
normalizer and splitter never look across white space. ``tests/llm`` hold it
against the tokenizer's own ids.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: Id that ends each document, a fixed value of the contracts.
END_ID = 1
#: Chunks and pieces kept in each of the two generations of their caches, about
#: 200 bytes each. Pieces repeat more and cost more to encode, so more of them stay.
CHUNKS, PIECES = 150_000, 500_000
#: What the quick way handles: ASCII and the letters of Latin-1. Lower-cased, such a
#: chunk falls into the pieces of the tokenizer's splitter; no piece depends on others.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache:
    """A dictionary of two generations: the older one goes when the newer one is full."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def add(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.add(key, value)
        return value


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, chunks: int = CHUNKS, pieces: int = PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.pieces = _Cache(chunks), _Cache(pieces)
        self.letters = _byte_letters()
        layout = self.tokenizer.to_str()
        kinds = re.findall(r'"type"\s*:\s*"(\w+)"', layout[: layout.find('"vocab"')])
        #: Chunks only for the layout they were made for; with any other file texts are encoded whole.
        self.quick = kinds[:7] == ["Sequence", "NFC", "Replace", "Lowercase", "Sequence", "Split", "ByteLevel"]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces.add(piece, array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes())
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self._piece(chunk.lower().decode())
            elif chunk[-1] in b".,;:!?" and chunk[:-1].isalpha():
                ids = self._piece(chunk[:-1].lower().decode()) + self._piece(chr(chunk[-1]))
            elif _PLAIN(text := chunk.decode("utf-8", "replace")) and "<|" not in text:
                ids = b"".join(map(self._piece, _PIECES(text.lower())))
            else:
                ids = self._whole(text)
            self.chunks.add(chunk, ids)
        return ids

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a UTF-8 text (null: empty) and the end id."""
        if not text:
            ids = b""
        elif self.quick:
            chunks = text.split()
            found = list(map(self.chunks.new.get, chunks))
            for i in [i for i, f in enumerate(found) if f is None]:
                found[i] = self._chunk(chunks[i])
            ids = b"".join(found)
        else:
            ids = self._whole(text.decode("utf-8", "replace"))
        return ids + END_ID.to_bytes(4, "little")


@lru_cache(maxsize=1)
def encoder(path: str, chunks: int = CHUNKS, pieces: int = PIECES) -> Encoder:
    """One encoder per Python worker, of the file and sizes asked for last."""
    return Encoder(path, chunks, pieces)


def tokenizer_path() -> str:
    """Default tokenizer file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
