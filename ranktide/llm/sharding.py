"""Uniform shuffle of a table into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in input partitions; every shard has an exact size (counts at most one
apart). How many rows go from partition p to shard s is one entry of a matrix
whose row sums are the partitions' sizes and whose column sums are the shards'.
Under a uniform shuffle that matrix follows the multivariate hypergeometric law,
so it is drawn first; each partition permutes its rows and deals them out by its
own row of the matrix, the rows are exchanged, and each shard permutes again.

The matrix never exists as a whole. A binary tree over the partitions splits the
column sums: the left half of a node draws its share, the right half has the
rest, with a generator seeded by the node. A task walks from the root to its own
partition and so obtains its row from the partitions' counts alone. Shards of
many rows are dealt as several buckets of exact sizes (further columns of the
same matrix), so the second permutation never needs a whole shard in one task.

Defined results: an empty table gives no rows; null values and repeated rows are
rows like any other (equal texts may part); the assignment depends on the
table, its partitioning when it is staged, and the seed. Columns of the input
named as an output column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.llm.common import documents, staged

BUCKET_ROWS = 1 << 18  # the matrix has a column for each so many rows; a task draws one row of it
SAMPLER_LIMIT = 10**9  # numpy's sampler takes populations below this


def _log_factorials(a: int, b: int) -> float:
    """log(a! / b!), without first making two large numbers that nearly cancel."""
    if min(a, b) < 10**6:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    return (a + 0.5) * math.log1p(d / b) + d * (math.log(b) - 1) + (1 / a - 1 / b) / 12  # Stirling's series, term by term


def _ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw by Stadlober's ratio of uniforms; no more good ones than bad, at most half of all drawn."""
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    share = good / total
    spread = math.sqrt(n * share * (1 - share) * (total - n) / (total - 1) + 0.5)
    # The width of a hat that covers every hypergeometric law.
    width = 1.7155277699214135 * spread + 0.8989161620588988
    # End of fixed values.
    high = min(good, n)
    while True:
        u, v = rng.random(), rng.random()
        w = n * share + 0.5 + width * (v - 0.5) / u if u else -1.0
        if not 0 <= w < high + 1:
            continue
        k = int(w)
        ratio = -(
            _log_factorials(k, mode) + _log_factorials(good - k, good - mode)
            + _log_factorials(n - k, n - mode) + _log_factorials(bad - n + k, bad - n + mode)
        )
        if 2 * math.log(u) <= ratio:
            return k


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of ``n`` rows drawn without replacement, how many of the ``good`` ones; the same law at every size."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    if total < SAMPLER_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    if good > bad:  # count the others
        return n - _hypergeometric(rng, bad, good, n)
    if 2 * n > total:  # draw what stays behind
        return good - _hypergeometric(rng, good, bad, total - n)
    return _ratio_of_uniforms(rng, good, bad, n)


def _draw(rng: np.random.Generator, columns: list[int], n: int) -> list[int]:
    """A draw of ``n`` rows from the columns, without replacement."""
    left, out = sum(columns), []
    for size in columns:
        left -= size
        k = _hypergeometric(rng, size, left, n)
        out.append(k)
        n -= k
    return out


def matrix_row(seed: int, starts: list[int], columns: list[int], p: int) -> list[int]:
    """Row ``p`` of the communication matrix; ``starts``: rows before each partition, and at the end all rows."""
    a, b = 0, len(starts) - 1
    while b - a > 1:
        mid = (a + b) // 2
        left = _draw(np.random.default_rng([seed, a, b]), columns, starts[mid] - starts[a])
        if p < mid:
            columns, b = left, mid
        else:
            columns, a = [x - y for x, y in zip(columns, left, strict=True)], mid
    return columns


def shares(total: int, parts: int) -> list[int]:
    """``total`` in ``parts`` whole numbers at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def shard_rows(df: DataFrame, shards: int = 24, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1, counts at most one apart) and ``slot`` (gapless from 0 in its shard)."""
    df = df.select(*[c for c in df.columns if c not in ("shard", "slot")])
    at = F.monotonically_increasing_id()
    # Which partition and place a row has becomes data here: later stages may be planned anew at will.
    rows = staged(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
            F.shiftright(at, 33).cast("int").alias("part"),
            at.bitwiseAND(F.lit((1 << 33) - 1)).alias("idx"),
        ),
        "shard-rows",
    )
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    parts = sorted(counts)
    starts = [0, *np.cumsum([counts[p] for p in parts]).tolist()] if parts else [0]
    total = starts[-1]
    sizes = shares(total, shards)
    per = max(1, -(-total // (shards * bucket_rows)))
    columns = [x for size in sizes for x in shares(size, per)]
    place = {p: i for i, p in enumerate(parts)}
    made: dict[int, np.ndarray] = {}

    def dealt(p: int) -> np.ndarray:
        """The bucket of each row of a partition, after its own permutation."""
        if p not in made:
            made.clear()
            i = place[p]
            to = np.repeat(np.arange(len(columns)), matrix_row(seed, starts, columns, i))
            made[p] = np.random.default_rng([seed, i]).permutation(to)
        return made[p]

    @F.pandas_udf("int")
    def bucket(part: pd.Series, idx: pd.Series) -> pd.Series:
        out = np.zeros(len(part), np.int32)
        parts_, idx_ = part.to_numpy(), idx.to_numpy()
        for p in np.unique(parts_):
            mine = parts_ == p
            out[mine] = dealt(int(p))[idx_[mine]]
        return pd.Series(out)

    again = Window.partitionBy("bucket").orderBy("turn", "part", "idx")
    out = rows.withColumn("bucket", bucket("part", "idx")).withColumn("turn", F.xxhash64(F.lit(seed), "part", "idx"))
    out = out.withColumn("place", F.row_number().over(again) - 1)
    s, r = F.floor(F.col("bucket") / per), (F.col("bucket") % per).cast("long")
    size = F.lit(total // shards) + (s < total % shards).cast("long")
    before = r * F.floor(size / per) + F.least(r, size % per)  # slots of the shard's earlier buckets
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in df.columns],
        F.floor(F.col("bucket") / per).cast("int").alias("shard"),
        (F.col("place") + before).cast("long").alias("slot"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the ``rows`` law; ``size`` is the text's UTF-8 bytes (null: none) plus 8."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_rows(slim, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE_SQL = None  # a random assignment; tests check its laws
