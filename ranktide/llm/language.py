"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text accepts exactly that
text's substrings. A document is parsed against it into phrases: each is the
longest match from where the last one ended (or one unknown symbol). Phrases
times the logarithm of the longest sample's length, per symbol, estimate the
cross-entropy; the language that needs fewest such normalised phrases wins.
A phrase costs the same in every language, so a short sample has no advantage.

The automata are compiled into one table of (state, symbol) -> next state and
whether a phrase ends. Documents are cut into segments of ``SEGMENT`` bytes
that are all stepped through the tables together, a byte at a time.

The classifier is fitted on a bounded sample: for each language excerpts of
``EXCERPT`` characters from the middle of ``ROWS`` distinct texts, those whose
hashes are the least of all labelled texts; in all at most ``SAMPLE`` bytes,
shared by the languages. The tables therefore don't grow with the data.
Excerpts without letters are left out, and languages whose excerpts have fewer
than ``LEAST`` bytes aren't learned.

Text is lower-cased; ASCII characters other than letters separate words.

Defined results: ``und`` with score 0 where the text is null or has no letter;
ties go to the smaller language value; with one learned language the score is
1, with none every document is ``und``. Otherwise the score is 1 - (fewest
normalised phrases) / (second fewest). Repeated rows are rows like any other;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.llm.common import documents, let_go, schema_of

ROWS = 64
EXCERPT = 512
SAMPLE = 1 << 18
LEAST = 8
SEGMENT = 1024
SLICE = 4 << 20  # bytes stepped through together

_WORDS = bytes(b if chr(b).isalpha() or b > 0x7F else 0x20 for b in range(256))


def normalized(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_WORDS).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class SuffixAutomaton:
    """The least automaton of all substrings of a text."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            here = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = here
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[here] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[here] = copy
            last = here


class Classifier:
    """Parses texts against every language's automaton."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        used = sorted({*b"".join(samples.values())} - {0})
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that no sample has
        self.symbol[used] = np.arange(1, len(used) + 1)
        wide = len(used) + 1
        self.bits = math.log2(max([2, *map(len, samples.values())]))
        self.learned: list[int] = []  # hashes of the texts that the samples are from
        self.tables = []
        for k in self.langs:
            automaton = SuffixAutomaton(samples[k])
            # After its last state stands one for "no phrase open": there, and where no edge fits, a phrase begins.
            # An unknown symbol is a phrase by itself.
            closed = len(automaton.next)
            start = np.full(wide, closed * wide << 1 | 1, np.int32)
            for c, to in automaton.next[0].items():
                if c:
                    start[self.symbol[c]] = to * wide << 1 | 1
            table = np.tile(start, (closed + 1, 1))
            for s, edges in enumerate(automaton.next):
                for c, to in edges.items():
                    if c:
                        table[s, self.symbol[c]] = to * wide << 1
            self.tables.append((table.reshape(-1), closed * wide << 1))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns); segments are parsed on their own."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        out = np.zeros((len(texts), len(self.langs)))
        if not len(owner):
            return out
        steps = int(size[0])
        grid = np.empty((steps, len(owner)), np.int32)  # a row for each step, so that steps read in a row
        for a in range(0, len(owner), 1024):
            at = begin[a : a + 1024, None] + np.arange(steps)
            grid[:, a : a + 1024] = flat[np.minimum(at, len(flat) - 1)].T
        active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
        at, bit = np.empty(len(owner), np.int32), np.empty(len(owner), np.int32)
        for j, (table, closed) in enumerate(self.tables):
            state, count = np.full(len(owner), closed, np.int32), np.zeros(len(owner), np.int32)
            for i in range(steps):
                n = active[i]
                s, a = state[:n], at[:n]
                np.right_shift(s, 1, out=a)
                a += grid[i, :n]
                np.take(table, a, out=s, mode="clip")
                count[:n] += np.bitwise_and(s, 1, out=bit[:n])
            out[:, j] = np.bincount(owner, weights=count, minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """For each text its language, the score, and the fewest normalised phrases (bits a symbol; none for ``und``)."""
        langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if not self.langs:
            return langs, scores, rates
        waiting: list[tuple[int, bytes]] = []
        held = 0

        def done() -> None:
            rate = self.phrases([t for _, t in waiting]) * self.bits
            rate /= np.array([max(1, len(t)) for _, t in waiting])[:, None]
            for (i, _), row in zip(waiting, rate, strict=True):
                best = int(np.argmin(row))
                other = np.delete(row, best)
                langs[i], rates[i] = self.langs[best], float(row[best])
                scores[i] = float(1 - row[best] / other.min()) if len(other) else 1.0
            waiting.clear()

        for i, text in enumerate(texts):
            if text and has_letter(text):
                waiting.append((i, normalized(text)))
                held += len(waiting[-1][1])
                if held >= SLICE:
                    done()
                    held = 0
        if waiting:
            done()
        return langs, scores, rates


def fit(labelled: DataFrame, rows: int = ROWS, excerpt: int = EXCERPT, sample: int = SAMPLE) -> Classifier:
    """A classifier from ``text`` and ``lang`` (rows without either are left out)."""
    # Texts without letters would only take the places of others.
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("text", "lang").withColumn("h", F.xxhash64("text"))
    # The least hash of each of some buckets: copies of a text count once, and little leaves a map task.
    least = known.groupBy("lang", F.pmod("h", F.lit(16 * rows)).alias("bucket")).agg(F.min("h").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = least.withColumn("nth", nth).where(F.col("nth") <= rows).select("lang", "h").collect()
    if not picked:
        return Classifier({})
    middle = F.greatest(F.lit(1), F.floor((F.char_length("text") - excerpt) / 2).cast("int") + 1)
    texts = (
        known.where(F.col("h").isin([r["h"] for r in picked]))
        .groupBy("lang", "h").agg(F.min(F.substring(F.col("text"), middle, F.lit(excerpt))).alias("text"))
        .collect()
    )
    wanted = {(r["lang"], r["h"]) for r in picked}
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in texts:
        if (r["lang"], r["h"]) in wanted and has_letter(r["text"]):
            parts.setdefault(r["lang"], []).append((r["h"], normalized(r["text"])))
    parts = {k: v for k, v in parts.items() if sum(len(t) for _, t in v) >= LEAST}
    most = max(1, sample // max(1, len(parts)))
    model = Classifier({k: b"\0".join(t for _, t in sorted(v))[:most] for k, v in parts.items()})
    model.learned = sorted({r["h"] for r in picked})
    return model


def identify(docs: DataFrame, classifier: Classifier, *keep: str) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``lang_pred``, ``score`` and ``rate`` (the fewest normalised phrases, bits a
    symbol; null for ``und``); only ``text`` is an input. Columns kept go by any name: those of the result come after them."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # its size is bounded by SAMPLE
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            langs, scores, rates = model.value.predict(b.column("_text").to_pylist())
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *found], names=[*names, *out])

    out = ["lang_pred", "score", "rate"]
    found = rows.mapInArrow(run, schema_of(rows, names, "lang_pred string, score double, rate double"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], *out)


def held_out() -> Column:
    """The documents never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, fit(docs.where(~F.col("held_out"))), "doc_id", "held_out")
