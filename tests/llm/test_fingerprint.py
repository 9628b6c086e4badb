import hashlib
import re

from pyspark.sql import functions as F

from ranktide.llm import fingerprint as fp


def tree(text: str) -> str:
    """The same tree, plainly."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    leaves = [md5(p) for p in re.findall(r"[^\n.!?]{1,48}[ \t\r\n.!?]*|[ \t\r\n.!?]+", text)]
    sections, now = [], []
    for h in leaves:
        now.append(h)
        if h[-1] in "08":
            sections.append(now)
            now = []
    sections += [now] if now else []
    hashes = [md5(".".join(s)) for s in sections]
    root = hashlib.sha256("".join(hashes).encode()).hexdigest()[:32]
    return root + "|" + ";".join(h[:8] + ":" + ".".join(x[:8] for x in s) for h, s in zip(hashes, sections, strict=True))


TEXTS = ["", None, "One.", "One. Two!\nThree? Four", "a" * 500, "é日本🙂 \n\n" * 30, " . ", "x\n" * 400, "One. Two!\nThree? Four"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, next_text string")


def test_tree(spark):
    df = frame(spark, list(enumerate(TEXTS)))
    for r in df.select("text", fp.fingerprint(F.col("text")).alias("f"), fp.paragraphs(F.coalesce("text", F.lit(""))).alias("p")).collect():
        assert r["f"] == tree(r["text"] or "")
        assert "".join(r["p"]) == (r["text"] or "")


def test_edits_and_neighbours(spark):
    rows = [(i * 10, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (30, "second of its id")]
    out = fp.compare_with_edits(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    least = {}
    for d, t in rows:
        if d is not None:
            least[d] = min(least.get(d, t or ""), t or "")
    ids = sorted(least, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    want = []
    for d, t in rows:
        t = t or ""
        n, nxt = len(t), least[after[d]] if d is not None else t
        edited = t[: n - n // 2] + nxt[: n // 2]
        want.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), tree(t), tree(edited), tree(nxt)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_one_document_and_none(spark):
    one = fp.compare_with_edits(frame(spark, [(5, "abcd")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fp.compare_with_edits(frame(spark, [(5, "x")]).where("false")).count() == 0


def test_likeness_and_differences(spark):
    a = "".join(f"Sentence number {i}.\n" for i in range(40))
    b = a.replace("number 17.", "number seventeen.")
    df = spark.createDataFrame([(a, b), (a, a), ("", ""), ("x", "y")], "a string, b string")
    t, u = fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))
    out = df.select(fp.likeness(t, u).alias("near"), fp.differing(t, u).alias("places")).collect()
    assert out[0]["near"] == 2 * 39 / 80 and out[0]["places"] == [17]
    assert out[1]["near"] == out[2]["near"] == 1 and out[1]["places"] == []
    assert out[3]["near"] == 0
