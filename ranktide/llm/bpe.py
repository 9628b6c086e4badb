"""Byte-level BPE as a transducer, and streaming decoding.

Encoding: a valid tokenization is the only one all of whose neighbours would
stay apart if merged on their own, so the tokenization of every prefix is the
prefix's last token after that of a shorter prefix. The transducer reads bytes.
Its state is the last token that is certain and the bytes after it; an edge
appends a byte, finds the last token of the longer prefix, and emits the tokens
that all prefixes from which a token could still grow have in common. No token
is longer than the longest of the vocabulary, so the lookahead is bounded.
States and edges are made when needed a second time and kept: later bytes follow
them by a dictionary lookup. The rest of a piece beyond the automaton is worked
out by the same rule without making states.

Decoding: ids become bytes by a table, and an incremental UTF-8 state machine
holds back the bytes of an unfinished character between chunks.

Defined results: a null text is empty; special tokens' strings are ordinary
text; bytes that are no UTF-8 decode to U+FFFD in text output and stay as they
are in byte output. Memory: the automaton grows to ``STATES``; long pieces may take
it to twice that, where it starts anew.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, kept
from ranktide.llm.pieces import PieceEncoder, WordTable

STATES = 100_000
TAIL = 4  # last bytes by which the tokens that may end there are listed
SHORT = 32  # bytes beyond the automaton that are worked out without it


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {r: t for t, r in ranks.items()}
        #: Bytes -> 2 * rank (-2: no token) + whether they are a proper prefix of a token.
        self.kind = {t: 2 * r for t, r in ranks.items()}
        for t in ranks:
            for k in range(1, len(t)):
                self.kind[t[:k]] = self.kind.get(t[:k], -2) | 1
        self.longest = max(map(len, ranks))
        self.apart: dict[int, bool] = {}
        self.ending: dict[bytes, tuple] = {}
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > TAIL:
                lengths.setdefault(t[-TAIL:], set()).add(len(t))
        self.longer = {tail: tuple(sorted(found, reverse=True)) for tail, found in lengths.items()}
        self.made_of: dict[bytes, tuple[bytes, bytes]] = {}
        self.parts_of: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}
        self._begin()

    def _begin(self) -> None:
        self.number: dict[tuple[int, bytes], int] = {}
        self.state: list[tuple[tuple[int, bytes], tuple]] = []  # key; tokens of each prefix of the pending bytes, or None
        self.goto: dict[int, int] = {}  # state * 256 + byte -> 2 * state + whether the edge emits
        self.emits: dict[int, tuple[int, ...]] = {}
        self.asked: set[int] = set()  # edges needed once
        if len(self.ending) > 4 * self.limit:
            self.ending.clear()
        self._at(-1, b"", ((),))

    def _at(self, before: int, pending: bytes, paths: tuple) -> int:
        key = (before, pending)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.state)
            self.state.append((key, paths))
        return found

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token`` (None for a byte)."""
        if len(token) == 1:
            return None
        if token not in self.made_of:
            parts, top = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], top))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.made_of[token] = (parts[0], parts[1])
        return self.made_of[token]

    def _edge_parts(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The tokens that are in turn the last (side 1) or first (side 0) part of ``token`` while it is merged:
        each with the rank of the merge that makes it and of the one that ends it."""
        key = (token, side)
        if key not in self.parts_of:
            out, ends = [], 1 << 60
            while True:
                halves = self._halves(token)
                out.append((token, self.ranks[token] if halves else -1, ends))
                if halves is None:
                    break
                ends = self.ranks[token]
                token = halves[side]
            self.parts_of[key] = out
        return self.parts_of[key]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b side by side are their own tokenization: no merge across their border
        comes before the merges that hide its two parts (at equal rank the left one goes first)."""
        key = a << 20 | b
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 8 * self.limit:
                self.apart.clear()
            ranks, found = self.ranks, True
            right = self._edge_parts(self.bytes_of[b], 0)
            for x, x_made, x_ends in self._edge_parts(self.bytes_of[a], 1):
                for y, y_made, y_ends in right:
                    if x_made < y_ends and y_made < x_ends:
                        across = ranks.get(x + y)
                        if across is not None and across < x_ends and across <= y_ends:
                            found = False
            self.apart[key] = found
        return found

    def _step(self, at: int, byte: int) -> int:
        (before, pending), paths = self.state[at]
        pending += bytes((byte,))
        n = len(pending)
        kind, new, live = self.kind.get, None, []
        for i in range(max(0, n - self.longest), n):
            path = paths[i]
            if path is None:
                continue
            what = kind(pending[i:])
            if what is None:
                continue
            if new is None and what >= 0:
                token, left = what >> 1, path[-1] if path else before
                if left == -1 or self.stay_apart(left, token):
                    new = (*path, token)
            if what & 1:  # a token may have begun here that is not over yet
                live.append(path)
        sure = new
        for path in live:
            k = 0
            for x, y in zip(sure, path, strict=False):
                if x != y:
                    break
                k += 1
            sure = sure[:k]
        if sure:
            done = sum(len(self.bytes_of[t]) for t in sure)
            k = len(sure)
            rest = (None if p is None or p[:k] != sure else p[k:] for p in (*paths[done:], new))
            to = self._at(sure[-1], pending[done:], tuple(rest))
            self.emits[at << 8 | byte] = sure
        else:
            to = self._at(before, pending, (*paths, new))
        edge = self.goto[at << 8 | byte] = to << 1 | bool(sure)
        return edge

    def _ends(self, tail: bytes) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
        """What tokens can end in these last bytes: lengths beyond them that occur, and (length, token) within them."""
        found = tuple((k, r) for k in range(len(tail), 0, -1) if (r := self.ranks.get(tail[-k:])) is not None)
        ends = self.ending[tail] = (self.longer.get(tail, ()), found)
        return ends

    def _finish(self, at: int, rest: bytes) -> list[int]:
        """Tokens of a state's pending bytes and ``rest``, without making states."""
        (before, data), paths = self.state[at]
        known, data = len(data), data + rest
        last = [p[-1] if p else (None if p is None else before) for p in paths]
        ending, apart, ranks = self.ending, self.apart, self.ranks
        for n in range(known + 1, len(data) + 1):
            tail = data[n - TAIL : n] if n > TAIL else data[:n]
            longer, within = ending.get(tail) or self._ends(tail)
            found = None
            for k in longer:
                if k <= n and (left := last[n - k]) is not None and (token := ranks.get(data[n - k : n])) is not None:
                    fits = True if left < 0 else apart.get(left << 20 | token)
                    if fits or fits is None and self.stay_apart(left, token):
                        found = token
                        break
            else:
                for k, token in within:
                    if (left := last[n - k]) is not None:
                        fits = True if left < 0 else apart.get(left << 20 | token)
                        if fits or fits is None and self.stay_apart(left, token):
                            found = token
                            break
            last.append(found)
        out, n, bytes_of = [], len(data), self.bytes_of
        while n:
            out.append(last[n])
            n -= len(bytes_of[last[n]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        at, out, goto, asked = 0, [], self.goto, self.asked
        for n, byte in enumerate(piece, 1):
            key = at << 8 | byte
            edge = goto.get(key)
            if edge is None:
                # An edge is made when it is needed again, while there is room; most are needed once.
                if len(piece) - n < SHORT:
                    if len(self.state) >= self.limit:
                        return out + self._finish(at, piece[n - 1 :])
                    if key not in asked:
                        if len(asked) > 8 * self.limit:
                            asked.clear()
                        asked.add(key)
                        return out + self._finish(at, piece[n - 1 :])
                elif len(self.state) >= 2 * self.limit:  # long pieces go on from state to state: the last one starts a new table
                    (before, pending), paths = self.state[at]
                    self._begin()
                    goto, asked = self.goto, self.asked
                    at = self._at(before, pending, paths)
                    key = at << 8 | byte
                edge = self._step(at, byte)
            if edge & 1:
                out += self.emits[key]
            at = edge >> 1
        out += self.state[at][1][-1]
        return out


class Utf8Stream:
    """Chunks of bytes in, text of whole characters out."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(chunk: bytes) -> int:
        """How many last bytes begin a character that isn't over."""
        for back in range(1, min(4, len(chunk) + 1)):
            b = chunk[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:  # a lead byte says how long its character is
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 1
                return back if need > back else 0
        return 0

    def feed(self, chunk: bytes) -> str:
        chunk = self.held + chunk
        keep = len(chunk) - self.unfinished(chunk)
        self.held = chunk[keep:]
        return chunk[:keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes by table lookup, many at once; to text as a stream."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for t, r in ranks.items():
            tokens[r] = t
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def to_bytes(self, ids: np.ndarray) -> bytes:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        at = np.repeat(self.start[ids] - ends + lens, lens)
        at += np.arange(len(at))
        return self.flat[at].tobytes()

    def to_text(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        stream = Utf8Stream()
        for ids in chunks:
            yield stream.feed(self.to_bytes(ids))
        yield stream.end()


CHUNK = 1 << 16  # ids decoded at once


def codec(path: str) -> tuple[WordTable, Decoder]:
    """One encoder and decoder a Python worker and file."""

    def make() -> tuple[WordTable, Decoder]:
        gc.set_threshold(200_000, 20, 100)  # tables of strings and numbers: nothing there to collect
        ranks = read_ranks(path)
        transducer = Transducer(ranks)
        return WordTable(PieceEncoder(lambda piece: transducer.encode(piece.encode()), 700_000), 300_000), Decoder(ranks)

    return kept(("bpe", path), make)


def encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(ranks_path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for a in range(0, len(texts), 256):
                got = [x.astype("<u4") for x in encoder.encode_texts(t or "" for t in texts[a : a + 256])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(a, 256),
                    "ids": pa.array([x.tobytes() for x in got], pa.binary()),
                    "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                    "decoded": pa.array(["".join(decoder.to_text(x[k : k + CHUNK] for k in range(0, len(x), CHUNK))) for x in got], pa.string()),
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests stand for ids and text."""
    done = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return done.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
