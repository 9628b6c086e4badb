from collections import Counter

import numpy as np
import pytest

from ranktide.llm import sharding


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)


@pytest.mark.parametrize("n,shards,bucket", [(0, 3, 4), (1, 4, 2), (257, 4, 16), (257, 4, 4096), (96, 24, 1)])
def test_sizes_and_slots(spark, n, shards, bucket):
    rows = [(i if i % 7 else None, "same" if i % 3 else None, "clash") for i in range(n)]
    out = sharding.shard_rows(frame(spark, rows), shards, seed=3, bucket_rows=bucket).collect()
    assert len(out) == n
    sizes = Counter(r["shard"] for r in out)
    assert all(sizes[s] in (n // shards, -(-n // shards)) for s in range(shards))
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((a, b) for a, b, _ in rows)


def test_matrix_rows_and_columns():
    starts, columns = [0, 5, 5, 17, 40], [13, 13, 14]
    rows = [sharding.matrix_row(1, starts, columns, p) for p in range(4)]
    assert [sum(r) for r in rows] == np.diff(starts).tolist()
    assert np.array(rows).sum(0).tolist() == columns


def test_matrix_is_hypergeometric():
    draws = [sharding.matrix_row(seed, [0, 10, 20, 30], [15, 15], 1)[0] for seed in range(4000)]
    assert abs(np.mean(draws) - 5) < 0.1
    assert abs(np.var(draws) - 10 * 0.25 * 20 / 29) < 0.15


def test_large_populations_keep_their_sums():
    starts, columns = [0, 4 * 10**9, 9 * 10**9], [3 * 10**9] * 3
    rows = [sharding.matrix_row(0, starts, columns, p) for p in range(2)]
    assert [sum(r) for r in rows] == [4 * 10**9, 5 * 10**9]
    assert [sum(c) for c in zip(*rows, strict=True)] == columns


def test_uniform(spark):
    where = Counter()
    for seed in range(6):
        for r in sharding.shard_rows(spark.range(400).withColumnRenamed("id", "doc_id"), 4, seed).collect():
            where[r["shard"], r["doc_id"] < 100] += 1
    assert all(abs(where[s, True] - 150) < 60 for s in range(4))


@pytest.mark.parametrize("good,bad,n", [
    (4096, 2 * 10**9 - 4096, 400_000), (10, 2 * 10**9, 10**9), (10**6, 10**13, 10**6), (3 * 10**12, 5 * 10**12, 10**9), (7 * 10**9, 10**9, 6 * 10**9),
])
def test_large_populations_follow_the_law(good, bad, n):
    rng, draws, total = np.random.default_rng(1), 6000, good + bad
    got = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(draws)], float)
    mean = n * good / total
    var = mean * (bad / total) * ((total - n) / (total - 1))
    assert got.min() >= max(0, n - bad) and got.max() <= min(good, n)
    assert abs(got.mean() - mean) < 4 * (var / draws) ** 0.5
    assert 0.9 < got.var() / var < 1.1


@pytest.mark.parametrize("good,bad,n", [(30, 50, 20), (5, 900, 200), (400, 600, 500), (1, 3, 2)])
def test_every_probability_is_the_laws(monkeypatch, good, bad, n):
    from math import comb

    monkeypatch.setattr(sharding, "SAMPLER_LIMIT", 0)
    rng, draws = np.random.default_rng(2), 20_000
    seen = Counter(sharding._hypergeometric(rng, good, bad, n) for _ in range(draws))
    for k in range(max(0, n - bad), min(good, n) + 1):
        p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
        assert abs(seen[k] - draws * p) < 5 * (draws * p * (1 - p)) ** 0.5 + 3
