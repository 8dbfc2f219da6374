"""Whole texts to token ids with the tokenizers library, through two caches.

The vocabularies used here split a text before they merge and never merge across a change from non-space to space. So
a text falls into chunks that encode alike wherever they stand. A chunk met before is looked up. A new one is split
into the vocabulary's pieces, and pieces not met before go to the library's merge model; a chunk with characters
outside the plain set, whose classes this module does not decide itself, goes through the library's whole chain. Ids
are kept as little-endian unsigned 32-bit bytes. Texts for which chunks do not hold (special-token strings, control
separators that Python and the library class differently) go through the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from palate.llm.common import in_process

END = (0).to_bytes(4, "little")
#: Letters of the plain set; digits and other ASCII make up its rest.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\x20-\x7e\n{LETTERS}]*")
ODD = re.compile(r"[\x1c-\x1f]")
#: Pieces of plain text: byte-level vocabularies keep a blank with what follows it, word vocabularies drop it.
BYTE_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s")
WORD_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: A word with at most one blank before it; white space up to its last character; that last character.
BYTE_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: A chunk of a text whose white space is single blanks and single line breaks between words.
EVEN = re.compile(r"\n?\S+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Uneven(Exception):
    """A text has other white space than single blanks and line breaks between words."""


class Chunks(dict):
    """Ids of chunks. In texts of a vocabulary that keeps blanks, a chunk stands for a blank and itself, or for
    itself where it begins with a line break; others never get in."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        """Forget what was not asked for since the last call."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, chunk: str) -> bytes:
        encoder = self.encoder
        if (out := self.older.get(chunk)) is not None:
            pass
        elif encoder.keep_blanks:
            if not EVEN.fullmatch(chunk):
                raise Uneven
            out = encoder.chunk(chunk if chunk[0] == "\n" else " " + chunk)
        else:
            out = encoder.chunk(chunk)
        self[chunk] = out
        return out


class Encoder:
    """``encode(text)`` gives the ids of a whole text as bytes; null and empty texts have none."""

    def __init__(self, path: str, keep_blanks: bool, most: int = 350_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.keep_blanks = keep_blanks
        self.pieces = BYTE_PIECES if keep_blanks else WORD_PIECES
        self.letters = byte_letters()
        self.most = most
        self.chunks = Chunks(self)
        self.piece_ids: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        out = self.piece_ids.get(piece)
        if out is None:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
            self.piece_ids[piece] = out
        return out

    def chunk(self, chunk: str) -> bytes:
        if not PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        return b"".join(map(self._piece, self.pieces.findall(chunk if self.keep_blanks else chunk.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.chunks) > self.most:
            self.chunks.age()
        if len(self.piece_ids) > 3 * self.most:
            self.piece_ids.clear()
        if "<|" in text:
            return self.whole(text)
        if not self.keep_blanks:
            return self.whole(text) if ODD.search(text) else b"".join(map(self.chunks.__getitem__, text.split()))
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if not EVEN.fullmatch(first) or first[0] == "\n":
                raise Uneven
            return self.chunk(first) + b"".join(map(self.chunks.__getitem__, rest))
        except Uneven:
            return self.whole(text) if ODD.search(text) else b"".join(map(self.chunk, BYTE_CHUNKS.findall(text)))


def byte_encoder(path: str) -> Encoder:
    """For byte-level vocabularies that keep a blank with the word after it."""
    return in_process(("byte", path), lambda: Encoder(path, True))


def word_encoder(path: str) -> Encoder:
    """For lower-casing vocabularies that drop white space."""
    return in_process(("word", path), lambda: Encoder(path, False, 180_000))
