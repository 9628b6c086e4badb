import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ranktide.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, `_node` int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes, fanout):
    """The root of nodes in a row, and each one's siblings (before, after), lowest level first."""
    proofs, level, place = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, p in enumerate(place):
            a = p // fanout * fanout
            proofs[i].append((level[a:p], level[p + 1 : a + fanout]))
        level = [h(level[a : a + fanout]) for a in range(0, len(level), fanout)]
        place = [p // fanout for p in place]
    return (level or [None])[0], proofs


def plain_version(rows, fanout=mm.FANOUT):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order}
    root, upper = tree([trees[g][0] for g in order], fanout)
    out = []
    for g, over in zip(order, upper, strict=True):
        for (_, _, leaf, r), proof in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            cur = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                cur = leaf_of([*r[:4], r[4].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))])
            for before, after in [*proof, *over]:
                cur = h([*before, cur, *after])
            siblings = h(x for before, after in [*proof, *over] for x in [*before, *after])
            out.append((r[0], leaf, trees[g][0], root, siblings, cur, cur == root))
    return out


def rows(n, langs, seed=1):
    random.seed(seed)
    out = []
    for i in range(n):
        text = random.choice([None, "", "Plain", "lower", "日本 Ünï", "long " * 500])
        out.append((random.choice([i, i, None, 7]), random.choice([None, "src"]), random.choice(langs), random.choice([None, len(text or "")]), text, "clash", 1))
    return out + out[: n // 5]


def digests(found):
    found = found.withColumn("f", mm.folded(F.coalesce("changed", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(mm.siblings(), 256), "f", F.col("f") == F.col("root"))


def changed():
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    values = [lower if c == "text" else F.col(c) for c in mm.COLUMNS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, mm.leaf(values)).alias("changed")


@pytest.mark.parametrize("n,langs,fanout,levels", [
    (0, ["x"], 8, 4), (1, [None], 8, 4), (8, ["x"], 8, 4), (9, ["x", None, ""], 8, 4), (300, ["en", "de", None, "é", "z"], 8, 2),
    (700, ["en"] * 9 + ["de", None], 3, 2), (40, [f"l{i}" for i in range(200)], 2, 1), (260, ["one"], 2, 3),
])
def test_as_a_plain_version(spark, n, langs, fanout, levels):
    some = rows(n, langs)
    docs = spark.createDataFrame(some, SCHEMA).repartition(3)
    got = mm.manifest(docs, F.col("doc_id"), changed(), fanout=fanout, levels=levels)
    assert Counter(map(tuple, digests(got).collect())) == Counter(plain_version(some, fanout))


def test_names_that_clash(spark):
    docs = spark.createDataFrame(rows(20, ["a"]), SCHEMA)
    got = mm.manifest(docs, F.col("leaf"), F.col("_node"), F.col("text").alias("root"))
    assert got.columns == ["leaf", "_node", "root", "leaf", "subroot", "root", "witness"]
    assert {r[0] for r in got.collect()} == {"clash"}


@pytest.mark.parametrize("leaves,fanout", [(1, 8), (7, 8), (8, 8), (9, 8), (65, 8), (100, 3), (128, 2)])
def test_appends_extend_earlier_witnesses(leaves, fanout):
    nodes = [h([str(i)]) for i in range(leaves)]
    tree_ = mm.Appender(mm.height(leaves, fanout), fanout)
    found = []
    for i, n in enumerate(nodes):
        found.append(tree_.append(n))
        if found[0] is not None and i < fanout:  # what is there so far is in the first leaf's partial witness
            assert found[0].after[: fanout - 1] == nodes[1 : i + 1]
    root, proofs = tree(nodes, fanout)
    assert tree_.close() == root
    for w, want in zip(found, proofs, strict=True):
        assert list(w.levels() if w else ()) == [("".join(a), "".join(b)) for a, b in want]


def test_too_many_nodes_are_refused():
    tree_ = mm.Appender(1, 2)
    tree_.append("a"), tree_.append("b"), tree_.append("c")
    with pytest.raises(ValueError):
        tree_.append("d")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    mine = mm.op11_manifest(spark, folder)
    got = sorted(map(tuple, mine.collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(mine.columns)} FROM ({mm.ORACLE_SQL})").fetchall())
    docs = [tuple(r[c] for c in mm.COLUMNS) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got == sorted(plain_version(docs))
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
