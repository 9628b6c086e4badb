"""Pieces of text that byte-level BPE encodes one by one, and a bounded table of their ids.

``split`` cuts a text into the matches of ``public_tokenizers.PATTERN``. Texts
of plain characters (ASCII, Latin letters) go through the standard ``re``
module, whose classes agree with the pattern's there; all others through
``regex``, which reads the pattern itself.

A plain text whose white space always stands alone needs no pattern per
occurrence: it falls into words at spaces and line ends, each the same pieces
wherever it stands. Words are found and told apart by numpy over many texts at
once (by their bytes, eight at a time), and only distinct ones are looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat
from typing import Protocol

import numpy as np
import pandas as pd
import public_tokenizers
import regex

#: Any character for which ``re``'s classes might differ from the pattern's.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_FULL = regex.compile(public_tokenizers.PATTERN)
LONG = 1 << 26  # characters; longer texts are cut lazily
SLICE = 4 << 20  # bytes of texts worked on together

#: What a byte says about its text: 1 unusual, 2 and 3 leads of characters some of which are, 4 white space or a border.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(1, 32), 0x7F, *range(0xCA, 256)]] = 1
_CLASS[[0xC2, 0xC9]] = 2, 3
_CLASS[[0, 9, 10, 13, 32]] = 4
_ODD_C2 = np.zeros(256, bool)  # U+0080-U+00A0 and the digits that aren't decimal
_ODD_C2[[*range(0x80, 0xA1), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True
_BORDER = np.zeros(256, bool)
_BORDER[[0, 10, 32]] = True
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
SHORT = 8 * len(_FACTORS)


def split(text: str) -> Iterable[str]:
    """The pieces of ``text``, in order; joined they are the text."""
    pattern = _FULL if _UNUSUAL.search(text) else _PLAIN
    return pattern.findall(text) if len(text) < LONG else (m.group() for m in pattern.finditer(text))


def ragged(flat: array, start: array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[start[k]:start[k + 1]]`` for each number k in a row, and how long each is."""
    flat, start = np.frombuffer(flat, np.uint32), np.frombuffer(start, np.int64)
    a = start[numbers]
    lens = start[numbers + 1] - a
    ends = np.cumsum(lens)
    at = np.repeat(a - ends + lens, lens)
    at += np.arange(len(at))
    return (flat[at] if len(at) else np.zeros(0, np.uint32)), lens


class Encoder(Protocol):
    special: dict[str, int]  # strings that are tokens wherever they stand, and these tokens' ids

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of these words in a row, and how many each has.

        A word is its bytes after the one that stands before it: a space, a line
        end, or 0 at the text's start; those come last.
        """

    def text(self, text: str) -> np.ndarray:
        """The ids of any text."""


class WordTable(dict):
    """Word -> number; the ids of word k are ``flat[start[k]:start[k + 1]]``.

    The encoder is asked once for each word. Beyond ``limit`` words the table
    starts anew between two slices of text, so its memory is bounded; the
    results don't depend on what it holds.
    """

    def __init__(self, encoder: Encoder, limit: int = 300_000):
        super().__init__()
        self.encoder, self.limit = encoder, limit
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.flat, self.start = array("I"), array("q", [0])

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words."""
        out = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            new.sort(key=lambda i: words[i][0] == 0)
            some = [words[i] for i in new]
            out[new] = np.arange(len(self), len(self) + len(some))
            self.update(zip(some, out[new].tolist(), strict=True))
            ids, lens = self.encoder.words(some)
            self.start.frombytes((len(self.flat) + np.cumsum(lens)).astype(np.int64).tobytes())
            self.flat.frombytes(ids.astype(np.uint32).tobytes())
        return out

    def _words(self, raw: bytes, buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of the words ``raw[begin:begin + size]``."""
        if not len(begin):
            return np.zeros(0, np.int64)
        eights = np.ndarray((len(buf) - 7,), "<u8", raw, strides=(1,))
        key = size.astype(np.uint64) * _FACTORS[-1]
        for j, factor in enumerate(_FACTORS):
            part = np.flatnonzero(size > 8 * j)
            load = eights[begin[part] + 8 * j]
            left = np.minimum(size[part] - 8 * j, 8).astype(np.uint64)
            load &= np.uint64((1 << 64) - 1) >> (np.uint64(64) - np.uint64(8) * left)
            load *= factor
            load ^= load >> np.uint64(32)
            load *= factor
            key[part] = (key[part] << np.uint64(7) | key[part] >> np.uint64(57)) ^ load
        number = np.empty(len(begin), np.int64)
        short = size <= SHORT
        some = np.flatnonzero(short)
        which, _ = pd.factorize(key[some])
        first = some[np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))]  # in order of appearance
        ends = begin + size
        long = np.flatnonzero(~short)
        found = [raw[a:b] for a, b in zip(begin[first].tolist(), ends[first].tolist(), strict=True)]
        others = {raw[a:b]: None for a, b in zip(begin[long].tolist(), ends[long].tolist(), strict=True)}
        numbers = self._numbers(found + list(others))
        number[some] = numbers[: len(first)][which]
        place = dict(zip(others, numbers[len(first) :].tolist(), strict=True))
        number[long] = [place[raw[a:b]] for a, b in zip(begin[long].tolist(), ends[long].tolist(), strict=True)]
        return number

    def _slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        raw = "\0".join(["", *texts, "\0" * 8]).encode()
        buf = np.frombuffer(raw, np.uint8)
        # A text that holds \0 itself would shift the borders: it is unusual.
        borders = np.flatnonzero(buf == 0)[:-8]
        if len(borders) != len(texts) + 1:
            for t in texts:  # rare: each such text by itself
                yield from [self.encoder.text(t)] if "\0" in t else self._slice([t])
            return
        kind = _CLASS[buf]
        odd = np.flatnonzero((kind > 0) & (kind < 4))
        what, after = kind[odd], buf[np.minimum(odd + 1, len(buf) - 1)]
        odd = odd[(what == 1) | (what == 2) & _ODD_C2[after] | (what == 3) & (after > 0x8F)]
        space = kind == 4
        beside = np.flatnonzero(space[:-1] & space[1:])
        held = np.array([m.start() for s in self.encoder.special for m in re.finditer(re.escape(s.encode()), raw)], np.int64)
        owner = np.searchsorted(borders, np.concatenate([odd, beside, held]), side="right") - 1
        slow = np.zeros(len(texts) + 1, bool)
        slow[np.minimum(owner, len(texts))] = True
        slow[:-1] &= np.diff(borders) > 1  # an empty text isn't ragged
        end = int(borders[-1])
        cuts = np.flatnonzero(_BORDER[buf[: end + 1]])
        begin, size = cuts[:-1], np.diff(cuts)
        of = np.searchsorted(borders, begin, side="right") - 1
        fast = ~slow[of]
        ids, lens = ragged(self.flat, self.start, self._words(raw, buf, begin[fast], size[fast]))
        per = np.bincount(of[fast], weights=lens, minlength=len(texts)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(per)])
        for i, t in enumerate(texts):
            yield self.encoder.text(t) if slow[i] else ids[at[i] : at[i + 1]]

    def _check(self) -> None:
        if len(self) > self.limit:
            self._begin()

    def encode_texts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text (uint32), in order."""
        held: list[str] = []
        n = 0
        for text in texts:
            if len(text) > LONG:
                yield from self._slice(held)
                held, n = [], 0
                yield self.encoder.text(text)
                continue
            held.append(text)
            n += len(text) + 1
            if n >= SLICE:
                yield from self._slice(held)
                self._check()
                held, n = [], 0
        yield from self._slice(held)
        self._check()


class PieceEncoder(dict):
    """Words and texts piece by piece: piece -> number. ``encode`` is asked once for each piece met, up to a bounded
    number kept. Strings of ``special`` are cut out of texts first and are one id each; the longest goes first."""

    def __init__(self, encode: Callable[[str], Iterable[int]], limit: int = 600_000, special: dict[str, int] | None = None):
        super().__init__()
        self.encode, self.limit, self.special = encode, limit, special or {}
        some = sorted(self.special, key=len, reverse=True)
        self.cuts = re.compile("|".join(map(re.escape, some))) if some else None
        self.flat, self.start = array("I"), array("q", [0])

    def make_room(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.flat, self.start = array("I"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.flat.extend(self.encode(piece))
        self.start.append(len(self.flat))
        return k

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.make_room()
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        return ragged(self.flat, self.start, numbers)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # All words behind a space or line end are one text: their borders are borders of pieces.
        first = next((i for i, w in enumerate(words) if w[0] == 0), len(words))
        pieces = _PLAIN.findall(b"".join(words[:first]).decode())
        size = [len(w.decode()) for w in words[:first]]
        for w in words[first:]:
            text = w[1:].decode()
            pieces += _PLAIN.findall(text)
            size.append(len(text))
        ids, lens = self._ids(pieces)
        until = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(size), side="right")
        return ids, np.diff(np.concatenate([[0], np.cumsum(lens)])[until], prepend=0)

    def text(self, text: str) -> np.ndarray:
        at, parts = 0, [np.zeros(0, np.uint32)]
        for m in self.cuts.finditer(text) if self.cuts else ():
            parts += [*self._pieces(text[at : m.start()]), np.array([self.special[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, *self._pieces(text[at:])])

    def _pieces(self, text: str) -> Iterator[np.ndarray]:
        found = iter(split(text))
        while some := list(islice(found, 1 << 16)):
            yield self._ids(some)[0]
