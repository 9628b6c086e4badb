"""Scoring texts by prediction by partial matching over byte contexts.

A text is a sequence of symbols: its UTF-8 bytes and an end. Training counts
which symbol follows each context of ``ORDER`` symbols (before its start a text
has start symbols); the counts of all shorter contexts are sums of these. A
symbol is predicted from the longest context seen in training. If it never
followed that context, the model escapes to the next shorter one with
probability U / 2T, T being the context's count and U its distinct symbols (a
seen symbol has (2n - 1) / 2T); symbols of the longer context are excluded
there, from T and U alike. Below the empty
context all symbols not yet excluded are alike. So every text has a
probability, and a document's score is its logarithm, end included.

How it is spread: the texts lie in chunks. A chunk sends its distinct
sequences of ORDER + 1 symbols, and its distinct words, with their training
counts to buckets by hash; buckets add them up. The trie's contexts that end
in the same two symbols meet in one group, where all their predictions are
worked out; the counts of the empty and one-symbol contexts (at most 257 * 257
numbers) go to all. Every chunk gets back the values of just the sequences and
words it sent, and looks its texts up in them. No table grows with the corpus
in one place, and nothing is pruned.

The base score is a smoothed unigram model of words, as a yardstick.

Defined results: a null text is empty: its only token is the end; without any
training text all symbols and tokens are unknown (probabilities 1/257 and 1);
copies are texts of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, groups_for, let_go, staged

ORDER = 5
SYMBOLS = 257  # 0: the end, and the start symbol in contexts; byte b is b + 1
WIDTH = 9  # bits of a symbol
CHUNK_BYTES = 16 << 20
SLICE = 4 << 20  # symbols worked on together
TEXTS = 1 << 10  # texts worked on together
_MASK = [(1 << WIDTH * k) - 1 for k in range(ORDER + 2)]


def sequences(texts: list[bytes]) -> np.ndarray:
    """For each symbol of each text (its end last): the ORDER symbols before it and the symbol, as one number."""
    flat = np.zeros(sum(map(len, texts)) + (ORDER + 1) * len(texts) + ORDER, np.uint64)
    keep = np.ones(len(flat) - ORDER, bool)  # a place for each symbol, once the start symbols are dropped
    at = 0
    for t in texts:
        at += ORDER
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        flat[at : at + len(t)] += np.uint64(1)
        at += len(t)
        at += 1  # the end
    out = flat[: len(flat) - ORDER].copy()
    for k in range(1, ORDER + 1):
        out <<= np.uint64(WIDTH)
        out |= flat[k : len(flat) - ORDER + k]
    # A window is kept if its last symbol is a text's own: those at start symbols aren't.
    at = 0
    for t in texts:
        keep[at + len(t) + 1 : at + len(t) + 1 + ORDER] = False
        at += ORDER + len(t) + 1
    return out[keep[: len(out)]]


def slices(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t) + 1
        if n >= SLICE or len(held) == TEXTS:
            yield held
            held, n = [], 0
    if held:
        yield held


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the first three symbols, so that a bucket's sequences lie close together and pack well."""
    mixed = (keys >> np.uint64(WIDTH * (ORDER - 2))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(8)) % np.uint64(buckets)


def _planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, and so on: the high ones, mostly zeros, compress to nothing."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their steps."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob, np.uint64), dtype=np.uint64)


def _text_bytes(text: object) -> bytes:
    return text.encode() if isinstance(text, str) else b""


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and the six ASCII white-space characters


def _gather(buckets: int):
    """A chunk's distinct sequences and words with their training counts, by bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        chunk = pdf["chunk"].iloc[0]
        rows = []
        seen, trained = [], []
        vocabulary, known = set(), Counter()
        for train, part in pdf.groupby("train"):
            texts = [_text_bytes(t) for t in part["text"]]
            for some in slices(texts):
                keys, n = np.unique(sequences(some), return_counts=True)
                seen.append(keys)
                trained.append(n if train else np.zeros(len(n), np.int64))
            for t in texts:
                if train:
                    known.update(words(t))
                else:
                    vocabulary.update(words(t))
        keys, counts = add_up(np.concatenate(seen), np.concatenate(trained))
        to = _bucket(keys, buckets)
        order = np.argsort(to, kind="stable")
        keys, counts, to = keys[order], counts[order], to[order]
        cut = np.searchsorted(to, np.arange(buckets + 1))
        for b in range(buckets):
            if cut[b] < cut[b + 1]:
                some = slice(cut[b], cut[b + 1])
                rows.append((chunk, b, "seq", pack_keys(keys[some]), _planes(counts[some].astype(np.uint32))))
        by_bucket: dict[int, list[bytes]] = {}
        for w in known.keys() | vocabulary:
            by_bucket.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for b, found in by_bucket.items():
            rows.append((chunk, b, "word", b" ".join(found), np.array([known[w] for w in found], np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "kind", "keys", "counts"])

    return run


def _sum_sequences(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, counts = add_up(
        np.concatenate([unpack_keys(k) for k in pdf["keys"]]),
        np.concatenate([_unplanes(c, np.uint32) for c in pdf["counts"]]).astype(np.int64),
    )
    return pd.DataFrame({"bucket": np.full(len(keys), pdf["bucket"].iloc[0]), "seq": keys.astype(np.int64), "n": counts})


def _sum_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each chunk's words again, with their counts in all training texts; and a row of totals (chunk -1)."""
    total: Counter = Counter()
    lists = [k.split(b" ") for k in pdf["keys"]]
    for found, counts in zip(lists, pdf["counts"], strict=True):
        for w, n in zip(found, np.frombuffer(counts, np.int64).tolist(), strict=True):
            if n:
                total[w] += n
    rows = [
        (chunk, k, np.array([total.get(w, 0) for w in found], np.int64).tobytes(), 0, 0)
        for chunk, k, found in zip(pdf["chunk"], pdf["keys"], lists, strict=True)
    ]
    rows.append((-1, b"", b"", len(total), sum(total.values())))
    return pd.DataFrame(rows, columns=["chunk", "keys", "vals", "distinct", "total"])


class Level:
    """The contexts of one order: their counts, distinct symbols, and what they exclude from the next shorter order."""

    def __init__(self, seqs: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.keys, self.n = add_up(seqs & np.uint64(_MASK[order + 1]), counts)
        ctx = self.keys >> np.uint64(WIDTH)
        self.first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
        self.contexts = ctx[self.first]
        self.total = np.add.reduceat(self.n, self.first) if len(ctx) else np.zeros(0, np.int64)
        self.distinct = np.diff(np.append(self.first, len(ctx)))

    def excludes(self, shorter_counts: np.ndarray) -> None:
        """``shorter_counts``: of each key in the next shorter order."""
        self.excluded = np.add.reduceat(shorter_counts, self.first) if len(self.keys) else shorter_counts

    def count(self, seqs: np.ndarray) -> np.ndarray:
        return _look_up(self.keys, self.n, seqs & np.uint64(_MASK[self.order + 1]))

    def place(self, seqs: np.ndarray) -> np.ndarray:
        """Of each sequence's context, or -1."""
        ctx = (seqs >> np.uint64(WIDTH)) & np.uint64(_MASK[self.order])
        return _look_up(self.contexts, np.arange(len(self.contexts)), ctx, -1)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, none: int = 0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), none, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], none)


def predictions(seqs: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of each sequence's last symbol's probability after the others.

    ``seqs`` are distinct and hold all sequences whose contexts share their last
    two symbols with any of them; ``counts``: in training. ``pairs[a, s]``: how
    often s follows a in training.
    """
    seen = counts > 0
    levels = {k: Level(seqs[seen], counts[seen], k) for k in range(2, ORDER + 1)}
    for k in range(3, ORDER + 1):
        levels[k].excludes(levels[k - 1].count(levels[k].keys))
    two = levels[2].keys
    levels[2].excludes(pairs[(two >> np.uint64(WIDTH)) & np.uint64(_MASK[1]), two & np.uint64(_MASK[1])])
    out = np.zeros(len(seqs))
    open_ = np.ones(len(seqs), bool)  # not yet predicted
    less_n, less_u = np.zeros(len(seqs), np.int64), np.zeros(len(seqs), np.int64)  # excluded counts and symbols

    def step(n: np.ndarray, total: np.ndarray, distinct: np.ndarray, excluded: np.ndarray) -> None:
        nonlocal less_n, less_u
        free = distinct - less_u
        twice = 2 * (total - less_n)
        hit = open_ & (n > 0)
        out[hit] += np.log10((2 * n[hit] - 1) / twice[hit])
        miss = open_ & (n == 0) & (free > 0)
        out[miss] += np.log10(free[miss] / twice[miss])
        open_[hit] = False
        there = total > 0
        less_n, less_u = np.where(there, excluded, less_n), np.where(there, distinct, less_u)

    for k in range(ORDER, 1, -1):
        lv = levels[k]
        at = lv.place(seqs)
        known = at >= 0
        pick = lambda v: np.where(known, v[at], 0) if len(v) else np.zeros(len(seqs), np.int64)  # noqa: E731,B023
        step(lv.count(seqs), pick(lv.total), pick(lv.distinct), pick(lv.excluded))
    last, before = (seqs & np.uint64(_MASK[1])).astype(np.int64), ((seqs >> np.uint64(WIDTH)) & np.uint64(_MASK[1])).astype(np.int64)
    single = pairs.sum(0)
    follows = (pairs > 0)
    step(pairs[before, last], pairs.sum(1)[before], follows.sum(1)[before], (follows * single).sum(1)[before])
    ones = np.ones(len(seqs), np.int64)
    step(single[last], single.sum() * ones, (single > 0).sum() * ones, 0 * ones)
    left = SYMBOLS - int((single > 0).sum())
    out[open_] -= math.log10(max(1, left))
    return out


def _predict(pairs: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs = pdf["seq"].to_numpy().astype(np.uint64)
        order = np.argsort(seqs)
        value = np.empty(len(seqs))
        value[order] = predictions(seqs[order], pdf["n"].to_numpy()[order], pairs)
        return pd.DataFrame({"bucket": pdf["bucket"], "seq": pdf["seq"], "value": value})

    return run


def _send_back(sent: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Each chunk's sequences of a bucket with their predictions."""
    keys, values = model["seq"].to_numpy().astype(np.uint64), model["value"].to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    vals = [values[np.searchsorted(keys, unpack_keys(k))].astype(np.float32).tobytes() for k in sent["keys"]]
    return pd.DataFrame({"chunk": sent["chunk"], "kind": "seq", "keys": sent["keys"], "vals": vals})


def _score(docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    """Every document of a chunk, by the values that the chunk got back."""
    columns = ["doc_id", "named", "held_out", "n_tokens", "n_known", "base", "score"]
    if not len(docs):
        return pd.DataFrame(columns=columns)
    mine = got[got["kind"] == "seq"]
    keys = np.concatenate([unpack_keys(k) for k in mine["keys"]])
    values = np.frombuffer(b"".join(mine["vals"]), np.float32)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    count: dict[bytes, int] = {}
    mine = got[got["kind"] == "word"]
    for k, v in zip(mine["keys"], mine["vals"], strict=True):
        count.update(zip(k.split(b" "), np.frombuffer(v, np.int64).tolist(), strict=True))
    number = {w: i for i, w in enumerate(count)}
    logs = np.log10(np.array(list(count.values()), np.float64) + 0.1)
    known = np.array(list(count.values()), np.int64) > 0
    texts = [_text_bytes(t) for t in docs["text"]]
    score: list[float] = []
    n_tokens, n_known, base = [], [], []
    for some in slices(texts):
        # Sequences in order, each with its text: one look-up for each distinct one.
        of = np.repeat(np.arange(len(some), dtype=np.uint64), [len(t) + 1 for t in some])
        both = np.sort(sequences(some) * np.uint64(TEXTS) + of)
        seq = both // np.uint64(TEXTS)
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        value = values[np.searchsorted(keys, seq[first])]
        value = np.repeat(value, np.diff(np.append(first, len(seq))))
        score += np.bincount((both % np.uint64(TEXTS)).astype(np.int64), weights=value, minlength=len(some)).tolist()
        for t in some:
            found = words(t)
            at = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
            n_tokens.append(len(found) + 1)
            n_known.append(int(known[at].sum()))
            base.append(float(logs[at].sum()))
    return pd.DataFrame({
        "doc_id": docs["doc_id"], "named": docs["named"], "held_out": docs["held_out"], "n_tokens": n_tokens, "n_known": n_known,
        "base": base, "score": score,
    })


def score_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, held_out) scored by models of those not held out.

    One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    n = groups_for(docs, "text", chunk_bytes)
    rows = docs.select(
        # An id of null would make pandas read all ids as floats: they travel as 0 with a flag.
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"),
        "text", "held_out", (~F.col("held_out")).alias("train"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"),
    )
    sent = staged(
        rows.groupBy("chunk").applyInPandas(
            _gather(n), "chunk int, bucket int, kind string, keys binary, counts binary"
        ),
        "ppm-sent",
    )
    seqs = sent.where("kind = 'seq'")
    sums = staged(seqs.groupBy("bucket").applyInPandas(_sum_sequences, "bucket int, seq long, n long"), "ppm-counts")
    one = F.lit(_MASK[1])
    pair = sums.where("n > 0").groupBy(
        F.shiftright("seq", WIDTH).bitwiseAND(one).alias("a"), F.col("seq").bitwiseAND(one).alias("s")
    ).agg(F.sum("n").alias("n"))
    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for r in pair.collect():  # at most 257 * 257
        pairs[r["a"], r["s"]] = r["n"]
    near = F.shiftright("seq", WIDTH).bitwiseAND(F.lit(_MASK[2]))
    model = sums.groupBy(near.alias("near")).applyInPandas(_predict(pairs), "bucket int, seq long, value double")
    back = seqs.select("chunk", "bucket", "keys").groupBy("bucket").cogroup(model.groupBy("bucket")).applyInPandas(
        _send_back, "chunk int, kind string, keys binary, vals binary"
    )
    counted = staged(
        sent.where("kind = 'word'").groupBy("bucket").applyInPandas(
            _sum_words, "chunk int, keys binary, vals binary, distinct long, total long"
        ),
        "ppm-words",
    )
    totals = counted.where("chunk = -1").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    ends = docs.where(~F.col("held_out")).count()
    distinct, total = (totals["v"] or 0) + (ends > 0), (totals["n"] or 0) + ends
    got = back.unionByName(counted.where("chunk >= 0").select("chunk", F.lit("word").alias("kind"), "keys", "vals"))
    scored = rows.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInPandas(
        _score, "doc_id long, named boolean, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    whole = math.log10(total + 0.1 * (distinct + 1))
    return scored.select(
        F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, learning from nine tenths of them."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return score_texts(documents(spark, sf_dir).select("doc_id", "text", out.alias("held_out")))
