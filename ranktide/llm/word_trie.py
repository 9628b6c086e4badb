"""BPE by a depth-first walk over a trie of distinct words.

Every prefix of a word has one tokenization, and it is the last token of that
prefix behind the tokenization of what stands before that token. So one number
a trie node, its last token, says all that the words below the node need, and it
depends on the path to the node alone: however many words share a prefix, its
nodes are worked out once.

The distinct words of many texts, sorted, are their trie in preorder: the
common prefix of a word with the one before it is the path that the two share.
The walk keeps the nodes of the current path only; going to the next word drops
those below the shared path and adds the new ones, each from its parent:

1. An automaton over the vocabulary (Aho and Corasick's) lists the tokens that
   end at the node, longest first.
2. The last token is the first of these that stays apart from the last token
   of the node where it begins: undoing the two tokens' merges, latest first, no
   merge across their border comes before the one undone.

A word's ids are read off its path from the end. Words' ids are kept in a
bounded table; it decides what is worked out again, not the results.

Encoding follows the tokenizers library with its file's own settings: the file's
added tokens are cut out first wherever their strings stand, and what is left
between them falls into pieces. Decoding looks ids up as bytes and reads these
as UTF-8.

Defined results: a null or empty text has no ids and decodes to the empty text;
a text without a single known word is bytes, which are all tokens; repeated rows
are rows; an empty table gives no rows. A piece of any length takes eight bytes a
byte. Columns kept go by any name: those of the result come after them.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.bpe import CHUNK, Decoder
from ranktide.llm.common import documents, kept, schema_of
from ranktide.llm.hf import byte_letters, plain_added_tokens
from ranktide.llm.pieces import PieceEncoder, WordTable, ragged

PAIRS = 300_000  # verdicts on pairs of tokens kept
PIECES = 400_000  # pieces whose ids are kept
TEXTS = 256  # texts encoded together
_SHIFT = 20


class Merges:
    """A vocabulary with its merges: what each token is made of, and which pairs merge when."""

    def __init__(self, vocabulary: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        top = max(vocabulary.values()) + 1
        self.size = [0] * top
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        self.made = [-1] * top  # the merge's number; -1: a byte
        self.left, self.right = [-1] * top, [-1] * top
        self.number: dict[int, int] = {}
        for n, (a, b) in enumerate(merges):
            x, y, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.made[whole] >= 0 or len(a) > 1 and self.made[x] < 0 or len(b) > 1 and self.made[y] < 0:
                raise ValueError(f"merge {n} comes before those of its parts, or makes a token again")
            self.number[x << _SHIFT | y] = n
            self.made[whole], self.left[whole], self.right[whole] = n, x, y
        self.known: dict[int, bool] = {}
        #: Whether a token is what the merges make of its bytes; the others never come up.
        self.reached = [False] * top
        for token, i in sorted(vocabulary.items(), key=lambda t: self.made[t[1]]):
            x, y, n = self.left[i], self.right[i], self.made[i]
            self.reached[i] = self.reached[x] and self.reached[y] and self._apart(x, y, n) if n >= 0 else len(token) == 1

    def apart(self, x: int, y: int) -> bool:
        """Whether tokens x and y side by side are what the merges make of their bytes."""
        key = x << _SHIFT | y
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[key] = self._apart(x, y)
        return found

    def _apart(self, x: int, y: int, limit: int = 1 << 60) -> bool:
        """``apart`` as far as the merges before ``limit`` go."""
        made, number = self.made, self.number
        while True:
            across = number.get(x << _SHIFT | y)
            if across is not None and across < limit:
                return False
            if made[x] > made[y]:  # equal merges run from the left: x's comes before one at the border
                limit, x = made[x], self.right[x]
            elif made[y] >= 0:  # and one at the border before y's
                limit, y = made[y] + 1, self.left[y]
            else:
                return True


class Automaton:
    """Which tokens end at each place of a string, longest first."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.edge: dict[int, int] = {}  # node << 8 | byte -> node
        token, parent, last = [-1], [0], [0]
        for t, i in vocabulary.items():
            at = 0
            for byte in t:
                key = at << 8 | byte
                at = self.edge.get(key, -1)
                if at < 0:
                    at = self.edge[key] = len(token)
                    token.append(-1)
                    parent.append(key >> 8)
                    last.append(byte)
            token[at] = i
        depth = [0] * len(token)
        for n in range(1, len(token)):  # a node is younger than its parent
            depth[n] = depth[parent[n]] + 1
        self.fail = [0] * len(token)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(token)
        for n in sorted(range(1, len(token)), key=depth.__getitem__):
            if depth[n] > 1:
                self.fail[n] = self.go(self.fail[parent[n]], last[n])
            shorter = self.ends[self.fail[n]]
            self.ends[n] = ((token[n], depth[n]), *shorter) if token[n] >= 0 else shorter

    def go(self, at: int, byte: int) -> int:
        edge, fail = self.edge, self.fail
        to = edge.get(at << 8 | byte)
        while to is None and at:
            at = fail[at]
            to = edge.get(at << 8 | byte)
        return to or 0


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0  # a[:low] == b[:low]
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


class Walk:
    """The walk over the trie of sorted words."""

    def __init__(self, vocabulary: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        missing = [b for b in range(256) if bytes((b,)) not in vocabulary]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.merges = Merges(vocabulary, merges)
        self.automaton = Automaton({t: i for t, i in vocabulary.items() if self.merges.reached[i]})
        self.nodes = 0  # trie nodes worked out so far

    def ids(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of each of the words, which are sorted and distinct."""
        go, ends = self.automaton.go, self.automaton.ends
        edge, known, apart, size = self.automaton.edge, self.merges.known, self.merges.apart, self.merges.size
        node, last, before = array("i", [0]), array("i", [-1]), b""  # of each node on the path, the root first
        for word in words:
            depth = shared_prefix(before, word)
            del node[depth + 1 :], last[depth + 1 :]
            self.nodes += len(word) - depth
            at, before = node[depth], word
            for n in range(depth, len(word)):
                byte = word[n]
                to = edge.get(at << 8 | byte)
                at = go(at, byte) if to is None else to
                for token, length in ends[at]:
                    x = last[n + 1 - length]
                    if x < 0:
                        break
                    fits = known.get(x << _SHIFT | token)
                    if fits or fits is None and apart(x, token):
                        break
                node.append(at)
                last.append(token)
            out, n = [], len(word)
            while n:
                out.append(last[n])
                n -= size[last[n]]
            yield out[::-1]


class TrieEncoder(PieceEncoder):
    """Pieces' ids, worked out for all new pieces of a batch in one walk."""

    def __init__(self, walk: Walk, special: dict[str, int], limit: int = PIECES):
        super().__init__(None, limit, special)
        self.walk = walk

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.make_room()
        new = sorted({p.encode() for p in pieces if p not in self})
        for word, ids in zip(new, self.walk.ids(new), strict=True):
            self[word.decode()] = len(self)
            self.flat.extend(ids)
            self.start.append(len(self.flat))
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        return ragged(self.flat, self.start, numbers)


def read_file(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Token bytes -> id, the merges in order, and the added tokens' strings -> ids, of a tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    raw = lambda s: bytes(byte_of[c] for c in s)
    added = plain_added_tokens(file)
    vocabulary = {raw(t): i for t, i in file["model"]["vocab"].items() if t not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    return vocabulary, [(raw(a), raw(b)) for a, b in merges], added


def codec(path: str) -> tuple[WordTable, Decoder]:
    """One encoder and decoder a Python worker and file."""

    def make() -> tuple[WordTable, Decoder]:
        vocabulary, merges, added = read_file(path)
        table = WordTable(TrieEncoder(Walk(vocabulary, merges), added))
        return table, Decoder(vocabulary | {s.encode(): i for s, i in added.items()})

    return kept(("trie", path), make)


def encode_decode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The ``keep`` columns of every row with n_tokens, ids (little-endian unsigned 32-bit) and decoded."""
    names = [f"_keep{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path)
        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS):
                b = whole.slice(a, TEXTS)
                got = [x.astype("<u4") for x in encoder.encode_texts(t or "" for t in b.column("_text").to_pylist())]
                texts = ["".join(decoder.to_text(x[k : k + CHUNK] for k in range(0, len(x), CHUNK))) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        *b.columns[: len(names)], pa.array([len(x) for x in got], pa.int64()),
                        pa.array([x.tobytes() for x in got], pa.binary()), pa.array(texts, pa.string()),
                    ],
                    names=[*names, "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col("text").alias("_text"))
    out = rows.mapInArrow(run, schema_of(rows, names, "n_tokens long, ids binary, decoded string"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "n_tokens", "ids", "decoded")


def op12_word_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests stand for ids and text."""
    done = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "doc_id")
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
