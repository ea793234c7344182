"""Words, memoised public tokenizers and batching by bytes, for code that runs in Python workers."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries that a worker's memo may hold before it is emptied: bounds its memory, changes no result.
MEMO_ENTRIES = 150_000
#: Entries in each of the two generations of a tokenizer's memo, byte-level and word-level: bounds its memory, changes no result.
GENERATIONS = (400_000, 200_000)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of bytes other than space and 0x09-0x0D (what bytes.split() cuts at)."""
    return text.lower().split()


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of one binary or string column; a longer value is a slice of its own."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Memo(dict):
    """A mapping that computes what it lacks and is emptied when it holds MEMO_ENTRIES."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        out = self[key] = self.compute(key)
        return out


def tokenizer(path: str):
    """The public tokenizer at path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# A space after a character that is not white space always begins a pre-token of the byte-level pattern,
# and no pre-token reaches past such a space: texts can be encoded in pieces cut there.
#: UTF-8 of white space other than the space and the line feed, or how it begins.
_OTHER_BLANKS = (b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")


def byte_level_pieces(raw: bytes) -> tuple[str, list[str]]:
    """(first piece, the others without the space that each begins with): what a byte-level BPE encodes independently."""
    text = raw.decode()
    head, *rest = text.split(" ")
    if head and "  " not in text and "\n " not in text and not any(x in raw for x in _OTHER_BLANKS):
        return head, rest
    pieces, piece = [], head
    for part in rest:
        if piece and not piece[-1].isspace():
            pieces.append(piece)
            piece = " " + part
        else:
            piece += " " + part
    first, *rest = [*pieces, piece]
    return first, [p[1:] for p in rest]


class Generations(dict):
    """A mapping that computes what it lacks. Its memory is bounded by two generations of ``most`` entries:

    what is in use moves to the younger one, and the elder is dropped when the younger is full.
    """

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.elder = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.elder = dict(self)
            self.clear()
        if (out := self.elder.get(key)) is None:
            out = self.compute(key)
        self[key] = out
        return out


def _byte_letters() -> dict[int, str]:
    """Bytes as a byte-level vocabulary writes them: printable Latin-1 characters as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


# The two vocabularies' own pre-token patterns.
_BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Latin letters, digits and signs that normalisation leaves alone and whose classes no Unicode version disputes.
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\u012f\u0132-\u024f]*")


# Signs that are pre-tokens of their own after a letter.
_STOPS = (".", ",", "!", "?", ";", ":")


class PieceEncoder:
    """Encodes texts piece by piece through a memo; ids are those of tokenizer.encode(text, add_special_tokens=False).

    A piece of plain Latin characters is cut into pre-tokens by the vocabulary's pattern, and each is given to the
    tokenizer's model, once. Any other piece is given to the tokenizer whole, and so is a text that may hold the
    string of a special token.
    """

    def __init__(self, path: str, byte_level: bool, dtype: str = "<u2"):
        self.tok = tokenizer(path)
        if self.tok.get_vocab_size() > np.iinfo(np.dtype(dtype)).max + 1:
            raise ValueError(f"ids of {path} don't fit {dtype}")
        self.dtype, self.byte_level, self.model = np.dtype(dtype), byte_level, self.tok.model
        self.cut = regex.compile(_BYTE_LEVEL_PATTERN if byte_level else _WORD_LEVEL_PATTERN).findall
        self.letters = _byte_letters()
        # what the strings of all special tokens begin with: a text without it holds none
        special = list(self.tok.get_added_tokens_decoder().values())
        self.has_special = bool(special)
        self.special = b"" if any(t.normalized for t in special) else os.path.commonprefix([t.content for t in special]).encode()
        most = GENERATIONS[0 if byte_level else 1]
        self.memo, self.pre_tokens = Generations(self._after_space if byte_level else self._word, most), Generations(self._pre_token, most)
        # a byte-level token is written with one character for each of its bytes
        self.widths = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():
            self.widths[i] = len(token)

    def _pre_token(self, text: str) -> bytes:
        as_bytes = text.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()

    def _piece(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.pre_tokens.__getitem__, self.cut(text if self.byte_level else text.lower())))

    def _after_space(self, piece: str) -> bytes:
        if piece.isalpha() and max(piece) < "\u0130":
            return self._pre_token(" " + piece)
        if piece[-1:] in _STOPS and piece[:-1].isalpha():
            return self.memo[piece[:-1]] + self.pre_tokens[piece[-1]]
        return self._piece(" " + piece)

    def _word(self, piece: bytes) -> bytes:
        text = piece.decode()
        if text.isalpha() and max(text) < "\u0130":
            return self._pre_token(text.lower())
        if text[-1:] in _STOPS and text[:-1].isalpha():
            return self.memo[piece[:-1]] + self.pre_tokens[text[-1]]
        return self._piece(text)

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian bytes of the encoder's dtype."""
        if self.has_special and self.special in text:
            return np.asarray(self.tok.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        if not self.byte_level:
            return b"".join(map(self.memo.__getitem__, text.split()))
        head, rest = byte_level_pieces(text)
        return self._piece(head) + b"".join(map(self.memo.__getitem__, rest))


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, byte_level: bool) -> PieceEncoder:
    """One encoder for each worker process and vocabulary; its memo lives as long as the worker."""
    key = (path, byte_level)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, byte_level)
    return _encoders[key]


def release() -> None:
    """Gives back the memory of encoders that earlier tasks of this worker have left."""
    _encoders.clear()


def public_vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
