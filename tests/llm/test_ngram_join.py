import random

import numpy as np
import pytest

from ranktide.llm import ngram_join as nj
from ranktide.llm.components import components
from ranktide.llm import shingles
from ranktide.llm.shingles import shingle_sets


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                above[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def make_rows(seed, families, size):
    random.seed(seed)
    word = lambda: random.choice("abcdefgh") + random.choice("ijklmnop") + str(random.randint(0, 40))
    common = [word() for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Hello"), (5, "hello"), (6, "a b c"), (7, "A  b\nc"), (None, "x y z"), (None, "x y Z"),
            (8, "é b c d e"), (9, "É b c d e"), (10, "a b c d e"), (10, "a b c d e")]
    n = 100
    for _ in range(families):
        base = [word() for _ in range(random.choice([6, 12, 40, 90]))] + (common if random.random() < 0.4 else [])
        for _ in range(random.randint(1, size)):
            t = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
                t[random.randrange(len(t))] = word()
            if random.random() < 0.3:
                t = t[random.randint(0, 6):]
            n += 1
            rows.append((n, " ".join(t).upper() if random.random() < 0.2 else " ".join(t)))
    random.shuffle(rows)
    return rows


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, cls string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in nj.near_duplicates(df, **how).collect())
    assert got == sorted((d or -1, n, c or -1) for d, n, c in brute(rows))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    check(spark, make_rows(seed, 25, 8), chunk_bytes=1500)


def test_large_families(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 6)
    monkeypatch.setattr(nj, "BIN_BYTES", 2000)
    check(spark, make_rows(11, 6, 60), chunk_bytes=3000)


def check_links(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [grams(t) for _, t in rows]
    want = [
        (d or -1, c or -1, sum(100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets) if a and j != i))
        for i, (a, (d, _, c)) in enumerate(zip(sets, brute(rows), strict=True))
    ]
    found = nj.near_duplicates(df, count_links=True, **how).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_links"]) for r in found) == sorted(want)
    assert max(n for *_, n in want) > 2


def test_every_link_counts(spark):
    check_links(spark, make_rows(4, 25, 8), chunk_bytes=1500)


def test_every_link_of_large_families_counts(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 6)
    monkeypatch.setattr(nj, "BIN_BYTES", 2000)
    check_links(spark, make_rows(11, 6, 60), chunk_bytes=3000)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_duplicates(df).count() == 0


def test_shingles():
    a, b = shingle_sets(["One two three four five six", " one\ttwo\nthree  four five SIX "])
    assert a.tolist() == b.tolist() and len(a) == 2
    assert len(next(shingle_sets(["a " * 3000]))) == 1
    long = "w" * 5000
    assert len({next(shingle_sets([t])).tolist()[0] for t in (long, long + "x", "a b", "b a", "ab")}) == 5


def test_overlaps_and_packing():
    random.seed(1)
    sets = [np.unique(np.array(random.choices(range(40), k=random.randint(0, 20)), np.uint64)) for _ in range(30)]
    got = nj.overlaps(sets[:12], sets)
    for i in range(12):
        for j in range(30):
            assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))
    for keys in ([5], [0, 1, 1 << 39], [3, 4, 1 << 20]):
        assert nj._unpack(nj._pack(np.array(keys, np.uint64))).tolist() == keys


def test_components(spark):
    random.seed(2)
    edges = [(f"n{random.randint(0, 300):03}", f"n{random.randint(0, 300):03}") for _ in range(180)]
    edges += [(f"p{i:03}", f"p{i + 1:03}") for i in range(90)] + [("s000", f"s{i:03}") for i in range(1, 60)]
    above = {x: x for e in edges for x in e}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        above[hi] = lo
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_long_texts_in_slices(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(4000)) + "  \n"
    for t in (text, "one", "two words", "x" * 3000, " " * 3000, "a b c d " + "y" * 900):
        (whole,) = shingles.shingle_sets([t])
        with monkeypatch.context() as m:
            m.setattr(shingles, "SLICE", 100)
            (sliced,) = shingles.shingle_sets([t])
        assert whole.tolist() == sliced.tolist()
