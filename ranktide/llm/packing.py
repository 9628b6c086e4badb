"""Packing documents into sequences: first-fit decreasing by a tournament tree, in randomised groups.

Documents are dealt at random (by a hash of id and text) into groups. A group
is packed by itself: a document gives as many whole sequences as its ids fill,
and its remainder is a piece. Pieces go, longest first, to the first open
sequence that has room; a tournament tree over the sequences' free space finds
it in logarithmic time. Sequences that stay emptiest are then dissolved and
their pieces, cut where needed, poured into the others' gaps, so a group pads
less than one sequence in all.

Groups never exchange anything, so the work is one shuffle and is repeated
safely when an executor is lost. Memory: the ids of one group (about
``GROUP_BYTES`` of text) or the longest document.

Defined results: a null text is empty; each document ends with ``end_id``, so
an empty one is one piece of one id; repeated rows are documents of their own
(their pieces lie in the same group); an empty table gives no rows. A sequence
of at most ``size`` ids is padded to ``size`` unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm import hf
from ranktide.llm.common import documents, groups_for

SIZE = 1024
GROUP_BYTES = 32 << 20


class RoomTree:
    """Tournament tree: each inner node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """Take ``need`` from the first bin that has it; its number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        found = at - self.leaves
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def pack_lengths(lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, first id, ids) that together hold every id of every document once."""
    bins: list[list[tuple[int, int, int]]] = []
    pieces = []
    for doc, n in enumerate(lengths):
        whole = n // size * size
        bins.extend([(doc, a, size)] for a in range(0, whole, size))
        if n > whole:
            pieces.append((doc, whole, n - whole))
    pieces.sort(key=lambda p: (-p[2], p[0]))
    open_: list[list[tuple[int, int, int]]] = []
    tree = RoomTree(len(pieces), size)
    for p in pieces:
        b = tree.first_fit(p[2])
        if b == len(open_):
            open_.append([])
        open_[b].append(p)
    load = [sum(p[2] for p in b) for b in open_]
    order = sorted(range(len(open_)), key=lambda b: -load[b])  # the emptiest last
    spare = len(open_) * size - sum(load)
    while order and spare - (size - load[order[-1]]) >= load[order[-1]]:  # the others' gaps hold it
        gone = order.pop()
        spare -= size
        gaps = (b for b in order if load[b] < size)
        into = next(gaps, None)
        for doc, a, n in open_[gone]:
            while n:
                if load[into] == size:
                    into = next(gaps)
                k = min(n, size - load[into])
                open_[into].append((doc, a, k))
                load[into] += k
                a, n = a + k, n - k
    return bins + [open_[b] for b in order]


def _pack(path: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        docs: list[tuple] = []  # sorted below: the order in which rows arrive doesn't matter
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for name, got in zip(names, hf.encode_texts(path, texts), strict=True):
                docs.append((name is not None, name or 0, np.concatenate([got, end]).astype("<u4").tobytes()))
        docs.sort()
        seqs = pack_lengths([len(d[2]) // 4 for d in docs], size)
        base = TaskContext.get().partitionId() << 32
        cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}

        def out() -> pa.RecordBatch:
            kinds = {"ids": pa.binary()}
            got = pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()})
            for v in cols.values():
                v.clear()
            return got if with_ids else got.select([k for k in cols if k != "ids"])

        for s, pieces in enumerate(seqs):
            offset = 0
            for doc, a, n in pieces:
                known, name, ids = docs[doc]
                cut = ids[4 * a : 4 * (a + n)]
                row = (name if known else None, a, n, zlib.crc32(cut), len(ids) // 4, base + s, offset, cut if with_ids else None)
                for v, x in zip(cols.values(), row, strict=True):
                    v.append(x)
                offset += n
            if len(cols["ids"]) >= 10_000:
                yield out()
        yield out()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, with_ids: bool = True,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves
    (``ids``, little-endian unsigned 32-bit; left out on request)."""
    docs = docs.select("doc_id", "text")
    n = groups_for(docs, "text", group_bytes)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return (
        docs.repartition(n, F.xxhash64("doc_id", "text"))
        .mapInArrow(_pack(tokenizer, end_id, size, with_ids), schema + (", ids binary" if with_ids else ""))
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, ended by id 0, in sequences of at most 1024 ids."""
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
