import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ranktide.llm import middle

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")

TEXTS = [
    None, "", " ", " \t\n ", "word", " word", "word ", "a b c d e", "tail of space \n\n", "nb sp line end 　x",
    "日本 語 𝒳𝒴 é", "has <P> in it", "a <S>", "<M>", "<P", "P> <", "$1 \\2 {3} (4) [5] $", "\0 zero \0", "x\x0b\x0cy\x1cz",
    "lots " * 3000, "\n" * 5000, "wordwithoutend" * 3000,
]


def rows():
    return [(i, t, "clash") for i in range(12) for t in TEXTS] + [(None, "no id at all", "clash"), (7, "twice here", "c"), (7, "twice here", "c")]


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_cuts_as_a_plain_version_does(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, form string")
    out = middle.fill_in_middle(docs, "doc_id", "text").withColumn("back", middle.restored()).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    assert got == Counter(plain_version(d, t) for d, t, _ in rows())
    assert all(r["back"] == (r["text"] or "") for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_a_very_long_text_needs_no_deep_stack(spark):
    long = spark.range(8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab \n"), 1_000_000).alias("text"))
    out = middle.fill_in_middle(long, "doc_id", rate=100).select("n", "prefix_chars", "middle_chars", F.sha2(middle.restored(), 256).alias("d")).collect()
    want = hashlib.sha256(b"ab \n" * 1_000_000).hexdigest()
    assert all(r["n"] == 1_000_001 and r["d"] == want and r["prefix_chars"] >= 0 and r["middle_chars"] >= 0 for r in out)


def test_names_that_clash_and_empty_tables(spark):
    names = ["doc_id", "text", "n", "form", "output", "_text", "_n", "a.b"]
    one = spark.createDataFrame([(3, "some words here", 9, "f", "o", "t", "k", "dot")], ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n') else 'string'}" for c in names))
    out = middle.fill_in_middle(one, *names)
    assert out.columns == [*names, "n", "form", "prefix_chars", "middle_chars", "output"]
    assert [tuple(r)[:8] for r in out.collect()] == [(3, "some words here", 9, "f", "o", "t", "k", "dot")]
    assert middle.fill_in_middle(one.where("false"), "doc_id").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_oracle(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    mine = middle.op13_middle(spark, folder)
    assert sorted(map(tuple, mine.collect())) == sorted(con.execute(f"SELECT {', '.join(mine.columns)} FROM ({middle.ORACLE_SQL})").fetchall())
