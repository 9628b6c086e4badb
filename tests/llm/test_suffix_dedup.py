import hashlib
import os
import random
import time
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from ranktide.llm import suffix_dedup as sd
from ranktide.llm.common import small_batches, staged


def brute(texts, window):
    """Bytes that some window covers which starts anywhere else, too."""
    starts = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if starts[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def texts_of(seed):
    random.seed(seed)
    base = ["".join(random.choice("abc d") for _ in range(120)) for _ in range(4)]
    noise = lambda n: "".join(random.choice("abcé") for _ in range(random.randint(0, n)))
    out = [None, "", "abc", "x" * 70, "x" * 70, "ab" * 50]
    for _ in range(36):
        b = random.choice(base)
        a = random.randint(0, 90)
        out.append(random.choice([
            b, noise(30) + b[a : a + random.randint(5, 60)] + noise(30), b[:a] + "Z" + b[a + 1 :],
            "ab" * random.randint(1, 60), noise(90),
        ]))
    return out


def counted(texts, window, piece):
    """Of each text: the bytes in blocks that stand elsewhere, their runs and the longest; a long text's pieces have blocks
    of their own."""
    found, seen = [], Counter()
    for t in texts:
        own = []
        for at in range(0, len(t) - window + 1, piece):
            part = t[at : at + piece + window - 1] if len(t) > piece else t
            _, s, e, _, _ = sd.blocks([part], window)
            own += [(at + a, at + b + window - 1) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        found.append(own)
        seen.update(t[a:b] for a, b in own)
    out = []
    for t, own in zip(texts, found, strict=True):
        gone = [False] * len(t)
        for a, b in own:
            if seen[t[a:b]] > 1:
                gone[a:b] = [True] * (b - a)
        runs = [len(list(g)) for k, g in groupby(gone) if k]
        out.append((sum(runs), len(runs), max(runs, default=0)))
    return out


@pytest.mark.parametrize("seed,window,short,anchor,shard,piece", [
    (1, 12, 7, 1 << 20, 4 << 20, 1 << 20), (2, 20, None, 30, 300, 64), (3, 16, 12, 60, 200, 50), (4, 40, 13, 100, 4 << 20, 1 << 20), (5, 25, 24, 200, 900, 100),
])
def test_against_brute_force(spark, monkeypatch, seed, window, short, anchor, shard, piece):
    monkeypatch.setattr(sd, "SLICE", piece)
    texts = texts_of(seed)
    rows = [(i, i if i % 5 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row int, doc_id long, text string, spans string").repartition(3)
    out = sd.remove_repeats(df, "row", "doc_id", window=window, short=short, anchor_bytes=anchor, shard_bytes=shard).collect()
    raw = [(t or "").encode() for t in texts]
    want = brute(raw, window)
    assert len(out) == len(texts)
    if short:
        plain = counted(raw, short, piece)
        assert all((r["n_repeated"], r["n_repeats"], r["longest_repeat"]) == plain[r["row"]] for r in out)
        assert any(r["n_repeated"] for r in out)
    for r in out:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["row"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("seed,window,anchor,shard", [(6, 12, 1 << 20, 4 << 20), (7, 20, 30, 300), (8, 16, 60, 200), (9, 30, 100, 900)])
def test_later_copies_against_brute_force(spark, seed, window, anchor, shard):
    texts = texts_of(seed)
    rows = [(i, 1000 - i if i % 5 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row int, doc_id long, text string").repartition(3)
    out = sd.remove_repeats(df, "row", "doc_id", window=window, keep_first=True, anchor_bytes=anchor, shard_bytes=shard).collect()
    raw = [(t or "").encode() for t in texts]
    hashed = {r["row"]: r["h"] for r in df.select("row", sd.text_keys()[1].alias("h")).collect()}
    place = lambda i: (rows[i][1] if rows[i][1] is not None else 1 << 63, hashed[i])
    first = {}
    for i in sorted(range(len(raw)), key=place):
        for a in range(len(raw[i]) - window + 1):
            first.setdefault(raw[i][a : a + window], (place(i), a))
    for r in out:
        t, i = raw[r["row"]], r["row"]
        gone = [False] * len(t)
        for a in range(len(t) - window + 1):
            if first[t[a : a + window]] != (place(i), a):
                gone[a : a + window] = [True] * window
        assert r["kept"] == bytes(b for b, g in zip(t, gone, strict=True) if not g)


def test_suffix_array_and_common_prefixes():
    random.seed(6)
    for _ in range(150):
        t = bytes(random.choice(b"ab\0") for _ in range(random.randint(1, 70)))
        order, rank = sd.suffix_array(t)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want and order[rank].tolist() == list(range(len(t)))
        cut = random.randint(1, len(t))
        begin, size = np.array([0, cut]), np.array([cut, len(t) - cut])
        got = sd.common_prefixes(t, order, rank, begin, size, 10)
        for s in range(1, len(t)):
            a, b = t[want[s - 1] :], t[want[s] :]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert got[s] == min(same, 10)


def test_long_runs_and_empty_tables(spark):
    rows = [(1, "y" * 30000), (2, "q" * 9 + "z" * 5), (2, "q" * 9 + "z" * 5), (None, "unique text of some length")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in sd.remove_repeats(df, "doc_id", window=13).collect()}
    assert got == {(1, 30000): 30000, (2, 14): 14, (None, 26): 0}
    assert sd.remove_repeats(df.where("false"), "doc_id").count() == 0


def test_passages_of_fifty_words_show(spark):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=random.randint(4, 8)))
    passage = " ".join(word() for _ in range(51))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{text(60)} {passage} {text(i)}" if i < 5 else text(150)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sd.remove_repeats(docs, "doc_id", short=150).collect()
    assert len(passage) < sd.WINDOW and all((r["n_repeated"] > 0) == (r["doc_id"] < 5) and not r["n_removed"] for r in found)


def test_the_query_shows_every_passage_of_412_bytes(spark, tmp_path):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=random.randint(4, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(64) for _ in range(12)]
    assert all(412 <= len(p) < 592 for p in passages)
    rows = [(i, f"{text(40)} {passages[i // 2]} {text(i)}" if i < 24 else text(150)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_repeated"] for r in sd.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert sorted(i for i, n in found.items() if n) == list(range(24))


def test_a_written_stage_leaves_no_shuffle_files(spark):
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {n for f in folders for _, _, names in os.walk(f) for n in names if n.startswith("shuffle_")}
    df = spark.range(1000).repartition(3, "id")
    before = held()
    again = staged(df, "test-shuffle")
    end = time.time() + 20
    while held() - before and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert not held() - before
    assert again.count() == df.count() == 1000


def test_few_texts_are_python_objects_at_a_time():
    batch = lambda n: pa.RecordBatch.from_pydict({"text": pa.array([str(i) for i in range(n)], pa.string())})
    got = list(small_batches(iter([batch(2500), batch(0), batch(1024)])))
    assert [b.num_rows for b in got] == [1024, 1024, 452, 0, 1024]
    assert [t for b in got[:3] for t in b.column("text").to_pylist()] == [str(i) for i in range(2500)]
