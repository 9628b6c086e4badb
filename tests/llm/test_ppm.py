import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ranktide.llm import ppm


def symbols(text):
    return [b + 1 for b in (text or "").encode()] + [0]


class Plain:
    """The same models, one symbol at a time."""

    def __init__(self, texts):
        self.follow, self.tokens = defaultdict(Counter), Counter()
        for t in texts:
            s = [0] * ppm.ORDER + symbols(t)
            for j in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.follow[tuple(s[j - k : j])][s[j]] += 1
            self.tokens.update((t or "").encode().lower().split())
            self.tokens["end"] += 1

    def chance(self, context, symbol):
        out, gone = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = self.follow.get(tuple(context[len(context) - k :]))
            if not seen:
                continue
            left = {a: n for a, n in seen.items() if a not in gone}
            if symbol in left:
                return out * (2 * left[symbol] - 1) / (2 * sum(left.values()))
            if left:
                out *= len(left) / (2 * sum(left.values()))
            gone |= set(seen)
        return out / (257 - len(gone))

    def score(self, text):
        s = [0] * ppm.ORDER + symbols(text)
        return sum(math.log10(self.chance(s[j - ppm.ORDER : j], s[j])) for j in range(ppm.ORDER, len(s)))

    def base(self, text):
        total, distinct = sum(self.tokens.values()), len(self.tokens)
        found = [self.tokens[w] for w in (text or "").encode().lower().split()] + [self.tokens["end"]]
        return len(found), sum(c > 0 for c in found), sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in found)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 10 == 0


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, score string")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return ppm.score_texts(df.withColumn("held_out", out), **how).collect()


@pytest.mark.parametrize("chunk_bytes", [300, 16 << 20])
def test_against_a_plain_model(spark, chunk_bytes):
    random.seed(3)
    texts = ["".join(random.choice("aab cd\né\x00") for _ in range(random.randint(0, 60))) for _ in range(50)]
    texts += ["", "", "zzz", None, "abcab", "abcab", "a" * 3000, "ab " * 500]
    rows = [((1 << 60) + i if i % 9 else None, t) for i, t in enumerate(texts)]
    plain = Plain([t for d, t in rows if not held(d)])
    got = sorted(run(spark, rows, chunk_bytes=chunk_bytes), key=lambda r: (r["doc_id"] or 0, r["score"]))
    want = []
    for d, t in rows:
        n, known, base = plain.base(t)
        want.append((d, held(d), n, known, sum(plain.tokens.values()), base, plain.score(t)))
    want.sort(key=lambda r: (r[0] or 0, r[6]))
    for r, w in zip(got, want, strict=True):
        assert tuple(r)[:5] == w[:5]
        assert r["base_score"] == pytest.approx(w[5]) and r["score"] == pytest.approx(w[6])


def test_chances_sum_to_one():
    plain = Plain(["abcab", "abd", "xyz"])
    for context in ([1, 2, 3, 98], [0, 0, 0, 98], [98, 99, 100, 98]):
        assert sum(plain.chance(context, s) for s in range(257)) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(200) if held(i)][:3]
    got = run(spark, [(ids[0], "ab"), (ids[1], None), (ids[2], "")])
    assert {r["train_tokens"] for r in got} == {0}
    assert sorted(r["score"] for r in got) == pytest.approx([-3 * math.log10(257), -math.log10(257), -math.log10(257)])
    assert run(spark, [(1, "x")])[0]["train_tokens"] == 2
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert ppm.score_texts(empty).count() == 0
