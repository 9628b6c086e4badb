"""Sets of word shingles as 64-bit hashes, over many texts at once.

Words are the runs of bytes other than ASCII white space, A-Z lower-cased. A
text's set holds each run of ``WORDS`` words in a row; a shorter text's only
element is its whole sequence; a text without words has none. Elements are
64-bit hashes, so unequal ones coincide with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from ranktide.llm.common import kept

WORDS = 5
SLICE = 512 << 10  # bytes worked on together
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(5)
_LETTER = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x09-\x0d\x20]")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; a worker keeps them until another operator's work begins."""

    def make() -> list[np.ndarray]:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        return tables

    return kept(("powers", n), make)


def _words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes begin, and their hashes. Both ends are white space."""
    buf = np.frombuffer(raw, np.uint8)
    space = _SPACE[buf]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _power_tables(1 << max(len(buf), SLICE).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[buf] * power[: len(buf)])])
    return begin, _mixed((total[end] - total[begin]) * inverse[begin])


def _runs(word: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of ``words`` words."""
    runs = word[: max(0, len(word) - words + 1)] * _FACTOR[0]
    for j in range(1, words):
        runs += word[j : j + len(runs)] * _FACTOR[j]
    return _mixed(runs)


def _few(word: np.ndarray) -> np.ndarray:
    """The only element of a text of so few words."""
    if not len(word):
        return np.zeros(0, np.uint64)
    whole = (word * _FACTOR[: len(word)]).sum(dtype=np.uint64, keepdims=True)  # arrays wrap around silently
    return _mixed(whole + _FACTOR[63 - len(word)])


def _slice_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    begin, word = _words_of(b" ".join([b"", *texts, b""]).lower())
    edge = np.cumsum([0, *[len(t) + 1 for t in texts]])
    of = np.searchsorted(begin, edge).tolist()  # words before each text
    runs = _runs(word, words)
    return [
        np.unique(runs[a : b - words + 1]) if b - a >= words else _few(word[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)
    ]


def _long_set(text: bytes, words: int) -> np.ndarray:
    """The set of a text longer than a slice: its words are hashed a slice at a time, cut at white space."""
    parts, at = [], 0
    while at < len(text):
        cut = _BLANK.search(text, at + SLICE)
        to = cut.start() if cut else len(text)
        parts.append(_words_of(b" " + text[at:to].lower() + b" ")[1])
        at = to
    word = np.concatenate(parts)
    return np.unique(_runs(word, words)) if len(word) >= words else _few(word)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each text: distinct hashes, ascending."""
    held, n = [], 0
    for t in texts:
        raw = t.encode() if t else b""
        if len(raw) > SLICE:
            yield from _slice_sets(held, words)
            yield _long_set(raw, words)
            held, n = [], 0
            continue
        held.append(raw)
        n += len(raw) + 1
        if n >= SLICE:
            yield from _slice_sets(held, words)
            held, n = [], 0
    if held:
        yield from _slice_sets(held, words)
