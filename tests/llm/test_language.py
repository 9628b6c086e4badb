import random

import pytest

from ranktide.llm import language
from ranktide.llm.language import Classifier, SuffixAutomaton, normalized


def brute_phrases(sample: bytes, text: bytes) -> int:
    """Phrases of one segment: each the longest match from where the last one ended."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample and text[at : at + n] in sample:
            n += 1
        at += n
        count += 1
    return count


def test_automaton_accepts_the_substrings():
    random.seed(1)
    for _ in range(50):
        text = bytes(random.choice(b"ab") for _ in range(random.randint(0, 25)))
        automaton = SuffixAutomaton(text)
        for n in range(6):
            for k in range(2**n):
                word = bytes(b"ab"[k >> i & 1] for i in range(n))
                s = 0
                for c in word:
                    s = automaton.next[s].get(c, -1) if s >= 0 else -1
                assert (s >= 0) == (word in text)


def test_phrases_match_a_plain_parse():
    random.seed(2)
    samples = {"x": bytes(random.choice(b"abc ") for _ in range(60)), "y": bytes(random.choice(b"abd ") for _ in range(40))}
    model = Classifier(samples)
    texts = [bytes(random.choice(b"abcde ") for _ in range(random.randint(0, 40))) for _ in range(60)]
    got = model.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        want = [brute_phrases(samples[k], t) for k in ("x", "y")]
        assert row.tolist() == [w if t else 0 for w in want]


def test_long_texts_are_the_sum_of_their_segments():
    model = Classifier({"x": b"abcab", "y": b"bca"})
    text = b"abcabdcab" * 500
    parts = [text[a : a + language.SEGMENT] for a in range(0, len(text), language.SEGMENT)]
    assert model.phrases([text])[0].tolist() == model.phrases(parts).sum(0).tolist()


def test_edge_cases(spark):
    rows = [(1, "", "en"), (2, None, "en"), (3, "12 !?", None), (4, "the cat the dog", "en"), (None, "le chat le chien", "fr"),
            (5, "der hund " * 3000, None), (5, "der hund " * 3000, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    out = language.identify(docs, language.fit(docs), "doc_id").collect()
    assert len(out) == 7
    by = {r["doc_id"]: r for r in out}
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and by[2]["score"] == 0
    assert by[4]["lang_pred"] == "en" and by[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in out)
    none = language.identify(docs, language.fit(docs.where("false")), "doc_id").collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = language.identify(docs, language.fit(docs.where("lang = 'fr'")), "doc_id").collect()
    assert {r["lang_pred"]: r["score"] for r in one} == {"und": 0.0, "fr": 1.0}
    assert language.identify(docs.where("false"), language.fit(docs), "doc_id").count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    got = language.op10_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    out = got.where("held_out").selectExpr("avg(CAST(lang_pred = lang AS int)) AS a").first()["a"]
    assert out > 0.99


@pytest.mark.parametrize("text", ["", "12345", "ok", "ok then"])
def test_a_language_with_hardly_any_text_wins_nothing(spark, text):
    random.seed(3)
    words = {"en": ["the", "house", "with", "some", "water", "and"], "de": ["das", "haus", "mit", "etwas", "wasser", "und"]}
    rows = [(i, " ".join(random.choices(words[k], k=60)), k) for i, k in enumerate(["en", "de"] * 20)]
    docs = spark.createDataFrame([*rows, (99, text, "zz")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model, "doc_id").collect()}
    assert all(got[i] == k for i, _, k in rows)


def test_a_phrase_costs_the_same_in_every_language():
    sample = " ".join(random.Random(4).choices(["the", "house", "with", "some", "water"], k=400)).encode()
    model = Classifier({"en": sample, "zz": b"ok"})
    assert model.predict(["some water with the house"])[0] == ["en"]
    assert Classifier({"a": b""}).bits == 1


def test_normalized():
    assert normalized("ÉTÉ, A1b\n c") == "été a b c".encode()
