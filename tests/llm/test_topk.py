import math
import random

import numpy as np
import pytest

from ranktide.llm import topk

FIELDS = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every):
    good = [(i, r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows)
            if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, q, v in good:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for j, c, w in good if j != i and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, monkeypatch, seed):
    random.seed(seed)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 5)
    common = [random.uniform(-1, 1) for _ in range(6)]
    rows = []
    for i in range(150):
        v = common if random.random() < 0.3 else [random.choice([0.0, 1.0, random.uniform(-2, 2)]) for _ in range(random.choice([6, 6, 6, 3, 0]))]
        v = random.choice([None, [None, *v[1:]], [math.nan, *v[1:]], [math.inf, *v[1:]]]) if random.random() < 0.1 else v
        rows.append((None if random.random() < 0.05 else random.choice([i, i, 5]), v))
    df = spark.createDataFrame([(*r, "clash") for r in rows], FIELDS).repartition(3)
    got = topk.top_k(df, "vec_id", "embedding", k=4, every=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 5)


def test_large_values(spark):
    rows = [(i, [1e15 * (i + 1), 1.0, 3e18]) for i in range(12)]
    df = spark.createDataFrame([(*r, "") for r in rows], FIELDS)
    got = topk.top_k(df, "vec_id", "embedding", k=3, every=10).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {(1 << 63) - 1}


def test_whole_numbers_beyond_float(spark):
    rows = [(i, [2.0**20 + i / 8, 2.0**19 - i / 16]) for i in range(40)]
    df = spark.createDataFrame([(*r, "") for r in rows], FIELDS)
    assert sorted(map(tuple, topk.top_k(df, "vec_id", "embedding", k=3, every=7).collect())) == brute(rows, 3, 7)


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(100, [1.0], "")], FIELDS)
    assert topk.top_k(df, "vec_id", "embedding").count() == 0
    assert topk.top_k(df.where("false"), "vec_id", "embedding").count() == 0


def test_nothing_is_joined_or_broadcast(spark, monkeypatch):
    """Query blocks copied for a join were taken for small ones and broadcast, which the driver's memory didn't hold."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "GROUP_BYTES", 512, raising=False)
    random.seed(9)
    rows = [(i if i % 9 else 6, [float(random.randint(-3, 3)), random.uniform(-1, 1), 2.0]) for i in range(400)]
    got = topk.top_k(spark.createDataFrame([(*r, "") for r in rows], FIELDS).repartition(2), "vec_id", "embedding", k=3, every=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("top", [1.0, 2.0**24, 2.0**40])
def test_best_are_carried_from_block_to_block(top):
    rng, k = np.random.default_rng(3), 4
    exact = np.floor(rng.normal(size=(90, 5)) * 1024 * top)
    exact[30:60] = exact[0]  # many ties
    ids, query = rng.integers(0, 50, 90), exact[:20]
    best = topk.Best(20, k)
    for a in range(0, 90, 18):
        part = exact[a : a + 18]
        low, width = part.min(0), np.ceil((part.max(0) - part.min(0) + 1) / 64)
        cells, own = ((part - low) // width).astype(np.uint8), np.where((np.arange(20) >= a) & (np.arange(20) < a + 18), np.arange(20) - a, -1)
        topk.search_block(query, ids[a : a + 18], part, cells, low, width, own, best)
    hold = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for i in range(20):
        want = sorted((-hold(sum(int(u) * int(v) for u, v in zip(query[i], exact[j], strict=True))), int(ids[j])) for j in range(90) if j != i)[:k]
        assert [(-int(s), int(n)) for s, n in zip(best.score[i], best.id[i], strict=True)] == want
