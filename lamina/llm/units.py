"""Exact, cached tokenization: texts are cut where the tokenizer cuts anyway.

Both vocabularies pre-tokenize with a pattern whose pieces never run from a
letter into a non-letter, nor from a non-space into a space.  A text may
therefore be cut at those places and each unit encoded on its own; equal units
have equal ids.  A unit of letters is a single piece, so it goes straight to the
tokenizer's merge model; all others go through the whole tokenizer.

The cut is found for all characters of many texts at once, by NumPy, and Arrow
tells the distinct units and joins their ids, so Python meets a unit once in
such a slice, not as often as it occurs.

Units met before are remembered in two generations of bounded size, so a
worker's memory stays the same however many texts it encodes.  Tests compare
whole texts with the library's own result.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: White space to ``str`` but not to the tokenizers, or the other way round.
SEPARATORS = "\x1c\x1d\x1e\x1f\u180e"
#: Characters that leave a text uncut where it is put in lower case: separators, and the one letter that becomes two.
APART = SEPARATORS + "İ"


@lru_cache(maxsize=1)
def unlike() -> frozenset:
    """Characters which ``re`` and the tokenizers' patterns class differently.

    Numbers other than decimal digits (letters to ``re``) and ``SEPARATORS``.
    """
    numbers = (c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and unicodedata.category(c) in ("No", "Nl"))
    return frozenset(numbers) | frozenset(SEPARATORS)


#: Classes of characters, as ``re`` has them.
OTHER, APOSTROPHE, LETTER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    found = np.full(len(every), OTHER, np.uint8)
    found[ord("'")] = APOSTROPHE
    for pattern, kind in ((r"[^\W\d_]+", LETTER), (r"\s+", SPACE)):
        for run in re.finditer(pattern, every):
            found[run.start() : run.end()] = kind
    return found


def _rule(bare: bool) -> np.ndarray:
    """Whether a text is cut between two characters, by the class of the first times four and the second's.

    White space goes with what follows it, or stands alone if ``bare``; letters go
    with an apostrophe before them ("'s" is one piece).
    """
    cut = np.zeros((4, 4), bool)
    cut[:SPACE, SPACE] = cut[OTHER, LETTER] = True
    cut[LETTER, :LETTER] = True
    cut[SPACE, :SPACE] = bare
    return cut.reshape(-1)


def cut_units(texts: list[str], rule: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts one after the other, and where each text's begin (one more: the end)."""
    joined, bounds = "".join(texts), np.cumsum([0, *map(len, texts)])
    data = joined.encode()
    points = np.frombuffer(data, np.uint8) if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kinds = classes()[points]
    first = np.zeros(len(points) + 1, bool)
    first[1:-1] = rule[kinds[:-1] * 4 + kinds[1:]]
    first[bounds] = True  # the end too
    starts = np.flatnonzero(first)
    ends = starts
    if len(data) > len(joined):
        width = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(width, starts[:-1], dtype=np.int64))])
    units = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return units, np.searchsorted(starts, bounds)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from code point 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def slices(texts: list[str], chars: int = 1 << 22) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together, one at least."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def lowered(text: str) -> str:
    """Lower case letter by letter, as the tokenizer has it: no rule for a last sigma."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    #: Units of a generation (about 30 MB); the one before the last is forgotten.
    LIMIT = 150_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = "Lowercase" in str(self.tokenizer.normalizer)  # composed, lower case, white space dropped
        self.model = self.tokenizer.model
        self.rule = _rule(bare=self.words)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _normal(self, text: str) -> str:
        return lowered(text if text.isascii() else unicodedata.normalize("NFC", text)) if self.words else text

    def _store(self, units: list[str]) -> None:
        known, tokenize, letters, space, others = self.known, self.model.tokenize, byte_letters(), byte_letters()[32], []
        for u in units:
            if u.isalpha():
                piece = u
            elif u[0] == " " and u[1:].isalpha():
                piece = space + u[1:]
            else:
                others.append(u)
                continue
            if not u.isascii():
                piece = u.encode().decode("latin-1").translate(letters)
            known[u] = array("I", [t.id for t in tokenize(piece)]).tobytes()
        known.update(zip(others, self._whole(others), strict=True))

    def _found(self, units: list[str]) -> list[bytes | None]:
        """Ids of each unit; none for one with unlike characters, whose texts are encoded whole."""
        known, older, odd, new = self.known, self.older, unlike(), []
        ids = list(map(known.get, units))
        missing = [i for i, x in enumerate(ids) if x is None]
        for i in missing:
            u = units[i]
            if u in older:
                known[u] = older[u]
            elif self.words and u.isspace():
                known[u] = b""
            elif u.isascii() and u.isprintable() or odd.isdisjoint(u):
                new.append(u)
        self._store(new)
        for i in missing:
            ids[i] = known.get(units[i])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; equal texts are encoded once, those with unlike characters whole."""
        if len(self.known) > self.LIMIT:
            self.known, self.older = {}, self.known
        each = list(dict.fromkeys(texts))
        units, bounds = cut_units([self._normal(t) for t in each], self.rule)
        units = units.dictionary_encode()
        ids = self._found(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        whole = {i for i, t in enumerate(each) if any(c in t for c in APART)} if self.words else set()
        odd = np.array([x is None for x in ids], bool)
        if odd.any():
            places = np.flatnonzero(odd[units.indices.to_numpy()])
            whole.update((np.searchsorted(bounds, places, "right") - 1).tolist())
        joined = pa.array(ids, pa.large_binary()).take(units.indices)
        cut = np.frombuffer(joined.buffers()[1], "<i8")[bounds].tolist() if len(joined) else [0] * len(bounds)
        data = memoryview(joined.buffers()[2] or b"")
        rows = dict(zip(each, (bytes(data[a:b]) for a, b in zip(cut, cut[1:], strict=False)), strict=True))
        rest = [each[i] for i in sorted(whole)]
        rows.update(zip(rest, self._whole(rest), strict=True))
        return [rows[t] for t in texts]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for this vocabulary file; it outlives a task, within its bound."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
