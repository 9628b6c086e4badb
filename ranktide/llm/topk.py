"""Exact top-k inner-product search by vector-approximation files.

Vectors are kept in blocks. Beside its exact vectors a block has an
approximation file: each component's cell on a grid of 2**BITS cells between
the block's least and greatest value of that component. Cell borders bound any
inner product from both sides: both bounds are the product with the cells' left
borders and a constant of the query and the block. So a query first scans the
cells alone. Vectors whose upper bound is below the k-th best score that the
query has so far (before that, the k-th greatest lower bound) are out; the rest
are read exactly.

Blocks are dealt out to tasks in groups of about GROUP_BYTES, each block to one.
A task holds its group, and all queries come past it, one small row each, so no
block is copied, no query block is collected, and a task's memory is that of its
group and of QUERIES queries at a time. It carries each query's best k from block
to block and gives k rows a query at most; the best k of all groups are the
answer. So what moves is each vector once, each query once a group (there are no
more groups than the bytes or the cores ask for), and k rows a query and group.
The products themselves are as many as there are queries times vectors.

Components are compared as floor(scale * x). Defined results: vectors that are
null or hold null or non-finite components, and rows without an id, take no
part; only vectors of one length are compared; ties go to the smaller id;
repeated rows are rows of their own, and a query leaves out its own row only;
an empty table gives no rows. Scores beyond 64 bits are held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.llm.common import staged

BLOCK = 2048
QUERIES = 1024
BITS = 6
GROUP_BYTES = 32 << 20
EXACT = float(1 << 53)  # whole numbers below this are exact in float64
_LIMIT = (1 << 63) - 1
_TOP = float(1 << 63)
_ASKED = pa.struct([("query_id", pa.int64()), ("place", pa.int32()), ("vector", pa.binary())])


def usable(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(F.col(vector), finite)


def _narrow(exact: np.ndarray) -> str:
    """The smallest type that holds these whole numbers."""
    for kind in ("<i2", "<i4"):
        if not exact.size or np.abs(exact).max() <= np.iinfo(kind).max:
            return kind
    return "<f8"


def _blocks(scale: float, every: int):
    """(id, vector) rows -> blocks: ids, exact components, cells as bytes, the grid, and which of the vectors are queries."""

    def block(ids: list, vectors: list[np.ndarray], seq: int) -> pa.RecordBatch:
        exact = np.floor(scale * np.array(vectors, np.float64).reshape(len(ids), -1))
        low = exact.min(0) if exact.size else np.zeros(exact.shape[1])
        width = np.ceil((exact.max(0) - low + 1) / (1 << BITS)) if exact.size else low
        cells = ((exact - low) // np.maximum(width, 1)).astype(np.uint8)
        kind = _narrow(exact)
        exact = exact.astype(kind)
        asked = [{"query_id": ids[p], "place": int(p), "vector": exact[p].tobytes()} for p in np.flatnonzero(np.array(ids) % every == 0)]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([TaskContext.get().partitionId() << 32 | seq], pa.int64()),
            "dim": pa.array([exact.shape[1]], pa.int32()),
            "kind": pa.array([kind]),
            "bytes": pa.array([exact.nbytes + cells.nbytes + 8 * len(ids)], pa.int64()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "exact": pa.array([exact.tobytes()], pa.binary()),
            "cells": pa.array([cells.tobytes()], pa.binary()),
            "grid": pa.array([np.stack([low, width]).tobytes()], pa.binary()),
            "asked": pa.array([asked], pa.list_(_ASKED)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}  # by length
        seq = 0
        for b in batches:
            column = b.column("vector")
            flat, at = column.flatten().to_numpy(zero_copy_only=False), 0
            for name, n in zip(b.column("id").to_pylist(), column.value_lengths().to_pylist(), strict=True):
                ids, vectors = open_.setdefault(n, ([], []))
                ids.append(name)
                vectors.append(flat[at : at + n].astype(np.float64))
                at += n
                if len(ids) == BLOCK:
                    yield block(ids, vectors, seq)
                    seq += 1
                    del open_[n]
        for ids, vectors in open_.values():
            yield block(ids, vectors, seq)
            seq += 1

    return run


class Best:
    """The best k (score, id) that each of some queries has so far, in order: greater scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, np.zeros(queries, np.int64)
        self.score, self.id = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def least(self) -> np.ndarray:
        """What a score has to reach; no limit for queries with fewer than k."""
        return np.where(self.n == self.k, self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        last, last_id = self.score[at, -1], self.id[at, -1]
        better = (self.n[at] < self.k) | (score > last) | ((score == last) & (name < last_id))
        at, score, name = at[better], score[better], name[better]
        if not len(at):
            return
        some = np.unique(at)
        row, col = np.nonzero(np.arange(self.k) < self.n[some, None])
        at = np.concatenate([some[row], at])
        score, name = np.concatenate([self.score[some[row], col], score]), np.concatenate([self.id[some[row], col], name])
        order = np.lexsort((name, ~score, at))  # ~ turns the order of whole numbers round and can't overflow
        at, score, name = at[order], score[order], name[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        first = rank < self.k
        self.score[at[first], rank[first]], self.id[at[first], rank[first]] = score[first], name[first]
        self.n[some] = np.minimum(np.bincount(at, minlength=len(self.n))[some], self.k)


def search_block(query: np.ndarray, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray,
                 width: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Add to ``best`` the block's vectors that are among the best k of each query (row); ``own``: its place here, or -1."""
    dim, n, k = query.shape[1], len(ids), best.k
    most = np.maximum(np.abs(low), np.abs(low + width * (1 << BITS)))
    size = max(np.abs(query).max(initial=0), 1) * max(most.max(initial=0), 1) * max(1, dim)
    # Beyond 53 bits sums in float64 are rounded: whole numbers of any size are added instead.
    plain = size < EXACT
    kind = np.float32 if plain else np.float64
    left = (low + cells * width).astype(kind)
    bound = query.astype(kind) @ left.T
    span = np.maximum(width, 1) - 1
    slack = (np.abs(query) @ most) * (dim + 16) * np.finfo(kind).eps  # what rounding can make of it
    above, below = np.maximum(query, 0) @ span + slack, np.minimum(query, 0) @ span - slack
    mine = np.flatnonzero(own >= 0)
    bound[mine, own[mine]] = -np.inf
    least = best.least()
    new = np.flatnonzero((best.n < k) & (n - (own >= 0) >= k))
    if len(new):
        kth = np.partition(bound[new], n - k, axis=1)[:, n - k] + below[new]
        least[new] = np.where(np.isnan(kth), -np.inf, kth)
    least = np.where(least <= -_TOP, -np.inf, np.minimum(least, _TOP))  # scores are held at these limits
    reach = least - above
    if plain:
        reach = np.nextafter(reach.astype(kind), kind(-np.inf))
    out = bound < reach[:, None]
    out[mine, own[mine]] = True
    at, place = np.divmod(np.flatnonzero(~out), n)
    whole = query @ exact.T if plain and len(at) > out.size // 8 else None
    step = max(1, (1 << 22) // max(1, dim))
    for a in range(0, len(at), step):
        q, p = at[a : a + step], place[a : a + step]
        if whole is not None:
            score = whole[q, p].astype(np.int64)
        elif plain:
            score = np.einsum("ij,ij->i", query[q], exact[p]).astype(np.int64)
        else:
            dot = lambda x, y: sum(int(u) * int(v) for u, v in zip(x, y, strict=True))
            score = np.array([max(-_LIMIT - 1, min(_LIMIT, dot(query[i], exact[j]))) for i, j in zip(q, p, strict=True)], np.int64)
        best.add(q, score, ids[p])


def _answers(queries: pa.RecordBatch, held: list[dict], k: int) -> Iterator[pa.RecordBatch]:
    """The best k of the held blocks for each of these queries."""
    get = lambda c: queries.column(c).to_pylist()
    names, homes, places = (np.array(get(c), np.int64) for c in ("query_id", "block", "place"))
    vectors = [np.frombuffer(v, kind) for v, kind in zip(get("vector"), get("kind"), strict=True)]
    for a in range(0, len(names), QUERIES):
        query, home, place = np.array(vectors[a : a + QUERIES], np.float64), homes[a : a + QUERIES], places[a : a + QUERIES]
        best = Best(len(query), k)
        for b in held:
            shape = (len(b["ids"]), query.shape[1])
            exact = np.frombuffer(b["exact"], b["kind"]).reshape(shape).astype(np.float64)
            low, width = np.frombuffer(b["grid"]).reshape(2, -1)
            search_block(query, b["ids"], exact, np.frombuffer(b["cells"], np.uint8).reshape(shape), low, width,
                         np.where(home == b["block"], place, -1), best)
        row, col = np.nonzero(np.arange(k) < best.n[:, None])
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(names[a : a + QUERIES][row], pa.int64()),
            "home": pa.array(home[row], pa.int64()),
            "place": pa.array(place[row], pa.int32()),
            "vec_id": pa.array(best.id[row, col], pa.int64()),
            "score": pa.array(best.score[row, col], pa.int64()),
        })


def _search(k: int):
    """Rows in order of group, length and turn: a group's blocks of a length, which are held, and then the queries of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for b in batches:
            turns = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("group", "dim", "turn")], 1)
            starts = [0, *(np.flatnonzero((turns[1:] != turns[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                group, dim, turn = turns[start].tolist()
                part = b.slice(start, end - start)
                if of != (group, dim):
                    held, of = [], (group, dim)
                if not turn:
                    rows = part.select(["block", "kind", "ids", "exact", "cells", "grid"]).to_pylist()
                    held += [r | {"ids": np.array(r["ids"], np.int64)} for r in rows]
                elif held:
                    yield from _answers(part, held, k)

    return run


def top_k(vectors: DataFrame, vec_id: str, vector: str, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the best k other rows of each row whose id is divisible by ``every``."""
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    blocks = staged(
        rows.mapInArrow(
            _blocks(scale, every),
            "block long, dim int, kind string, bytes long, ids array<bigint>, exact binary, cells binary, grid binary, "
            "asked array<struct<query_id: bigint, place: int, vector: binary>>",
        ),
        "vector-blocks",
    )
    size = blocks.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(size["n"], max(-(-(size["bytes"] or 0) // GROUP_BYTES), 2 * cores)))
    held = blocks.select(
        F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), "dim", F.lit(0).alias("turn"), "block", "kind",
        "ids", "exact", "cells", "grid",
    )
    asked = blocks.where(F.size("asked") > 0).select("dim", "block", "kind", F.inline("asked")).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "dim", F.lit(1).alias("turn"), "block", "kind",
        "query_id", "place", "vector",
    )
    met = held.unionByName(asked, allowMissingColumns=True).repartitionById(groups, F.col("group"))
    found = met.sortWithinPartitions("group", "dim", "turn").mapInArrow(
        _search(k), "query_id long, home long, place int, vec_id long, score long"
    )
    nth = F.row_number().over(Window.partitionBy("query_id", "home", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors of every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
