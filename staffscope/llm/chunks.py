"""Texts cut at white space where no tokenizer of this library can look across, and a bounded memory of encoded pieces.

A cut is made only between a character that is no white space under any Unicode table and an ASCII white-space
character. No pre-tokenizer pattern in use matches across such a place, none looks behind it, and a run of white space
stays whole at the head of its piece, so encoding the pieces and joining the ids gives exactly the ids of the text.
Natural texts repeat their words: each distinct piece goes through the tokenizers library once per worker.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Pieces a worker remembers, and the longest piece worth remembering; beyond them pieces are encoded again.
REMEMBERED, LONGEST = 500_000, 64
#: Characters of text cut together.
AT_ONCE = 2_000_000
#: Marks that may stand behind a word; no apostrophe, which can belong to a contraction.
_MARKS = "!#$%&*+,-./:;?@\\^_`|~=)]}"

_PLAIN = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_RARE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
_ANY_CUT = re.compile(r"(?<=\S)(?=[\t-\r ])")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """The text in pieces: white space with the word after it. Joined they are the text."""
    if _RARE_SPACE.search(text):
        return _ANY_CUT.split(text)
    return _PLAIN.findall(text)


def words(text: str) -> list[str]:
    """Like `pieces`, for tokenizers that drop white space themselves."""
    if _SEPARATORS.search(text):  # white space to Python, characters to the library
        return pieces(text)
    return text.split()


def lower_words(text: str) -> list[str]:
    """`words` for tokenizers that make letters small themselves; done here for ASCII, fewer words are different."""
    return words(text.lower() if text.isascii() else text)


@lru_cache(maxsize=None)
def library_tokenizer(name: str):
    """A tokenizer of the tokenizers library by its file name among the public tokenizers, or by a path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path(name))


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return name if os.path.isabs(name) else public_tokenizers.path(name)


class _Bytes(dict):
    """Code point -> the characters that stand for its UTF-8 bytes, made when first asked for."""

    def __missing__(self, point: int) -> str:
        self[point] = "".join(BYTE_CHARS[byte] for byte in chr(point).encode("utf-8", "surrogatepass"))
        return self[point]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 itself, the others in order from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(byte if byte in kept else next(others)) for byte in range(256)]


BYTE_CHARS = byte_chars()
_BY_POINT = _Bytes()


def spaced_letters(piece: str) -> str:
    """A piece that is one match of a byte-level pattern (letters, one space before them allowed) as its byte
    characters; empty for any other piece, which goes through the whole pipeline of its tokenizer."""
    word = piece[1:] if piece[:1] == " " else piece
    return piece.translate(_BY_POINT) if word.isalpha() else ""


def lower_letters(piece: str) -> str:
    """The same for a tokenizer that composes, lower-cases and drops white space."""
    if piece.isascii():
        return piece.lower() if piece.isalpha() else ""
    if not piece.isalpha() or "\u03a3" in piece or "\u0130" in piece:  # lower case of these depends on more than the letter
        return ""
    return unicodedata.normalize("NFC", piece).lower().translate(_BY_POINT)


class Memory:
    """Encodes texts piece by piece; `keep` turns the ids of a piece into what is stored for it, values that add up.

    Marks after a word are a match of their own under the pre-tokenizers in use, so an unknown `word,` is put together
    from `word` and `,`, which are pieces like others; only what is still unknown goes to the library.
    """

    def __init__(self, tokenizer, keep: Callable[[list[int]], object], cut: Callable[[str], list[str]] = pieces,
                 letters: Callable[[str], str] = spaced_letters, remembered: int | None = None):
        self._tokenizer, self._keep, self._cut, self._letters, self._remembered = tokenizer, keep, cut, letters, remembered
        self._known: dict[str, object] = {}

    def encode(self, texts: list[str]) -> Iterator[list]:
        """Per text what is kept of each of its pieces, in order. Texts are taken together up to `AT_ONCE` characters."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[list]:
        cuts = [self._cut(text) for text in texts]
        known = self.encode_pieces(set().union(*cuts))
        for cut in cuts:
            yield list(map(known.__getitem__, cut))

    def encode_pieces(self, wanted: set[str]) -> dict[str, object]:
        """A dictionary that has what is kept of each of these pieces, until the next call."""
        known = self._known
        if len(known) > (self._remembered or REMEMBERED):  # what is asked now is what is asked often: it need not be learned again
            kept = {piece: known[piece] for piece in wanted if piece in known}
            known.clear()
            known.update(kept)
        for piece in self._passing:
            known.pop(piece, None)
        self._passing = self._learn(wanted.difference(known))
        return known

    #: Pieces too long to be remembered beyond a call.
    _passing: list[str] = []

    def _learn(self, new: set[str]) -> list[str]:
        known, tokenize, letters, keep = self._known, self._tokenizer.model.tokenize, self._letters, self._keep
        split, plain = [], set()
        for piece in new:
            stem = piece.rstrip(_MARKS)
            if len(stem) < len(piece) and stem and stem[-1].isalpha() and stem[-1].lower()[-1].isalpha():
                tail = piece[len(stem):]
                split.append((piece, stem, tail))
                if stem not in known:
                    plain.add(stem)
                if tail not in known:
                    plain.add(tail)
            else:
                plain.add(piece)
        whole = []
        for piece in plain:
            mapped = letters(piece)
            if mapped:
                known[piece] = keep([token.id for token in tokenize(mapped)])
            else:
                whole.append(piece)
        codes = self._tokenizer.encode_batch_fast(whole, add_special_tokens=False)
        known.update((piece, keep(code.ids)) for piece, code in zip(whole, codes))
        for piece, stem, tail in split:
            known[piece] = known[stem] + known[tail]
        return [piece for piece in plain if len(piece) > LONGEST] + [piece for piece, _, _ in split if len(piece) > LONGEST]


@lru_cache(maxsize=None)
def counting_memory(name: str) -> Memory:
    """The worker's memory of numbers of tokens, kept from task to task."""
    return Memory(library_tokenizer(name), len)


@lru_cache(maxsize=None)
def lower_word_memory(name: str) -> Memory:
    """The worker's memory of ids, as little-endian unsigned 32-bit integers, of a tokenizer that drops white space."""
    return Memory(library_tokenizer(name), packed, lower_words, lower_letters)


def slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of a text column; a row that is longer is a part of its own."""
    import pyarrow.compute as pc
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, until - at)
        at = until


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()
