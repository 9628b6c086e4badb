import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ranktide.llm import word_trie

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "A", "b", "1", ".", "\n", "\t", " ", "  ", "-=", "é", "日本", "𝒳", "　", "\0", "<|endoftext|>", "<|endof", "the ", "'s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def walk():
    vocabulary, merges, _ = word_trie.read_file(PATH)
    return word_trie.Walk(vocabulary, merges)


def texts():
    random.seed(12)
    out = ["".join(random.choices(ALPHABET, k=random.randrange(60))) for _ in range(400)]
    out += ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randrange(2000))) for _ in range(30)]
    out += [None, "", "x <|endoftext|> y", "  <|endoftext|>  <|endoftext|>", "same text", "same text"]
    return out + ["a" * 60_000, " " * 5000 + "x", "-" * 3000 + "=" * 777, "words of a long text " * 20_000, "��"]


def test_the_librarys_ids_and_text(spark, library):
    rows = [(i if i % 9 else None, t, "clash", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `a.b` int").repartition(3)
    out = word_trie.encode_decode(docs, PATH, "doc_id", "ids", "a.b")
    assert out.columns == ["doc_id", "ids", "a.b", "n_tokens", "ids", "decoded"]
    got = sorted(map(tuple, out.collect()), key=lambda r: r[2])
    assert len(got) == len(rows)
    for (doc_id, text, _, _), r in zip(rows, got, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert r[0] == doc_id and r[1] == "clash"
        assert r[3] == len(want) and np.frombuffer(r[4], "<u4").tolist() == want
        assert r[5] == library.decode(want, skip_special_tokens=False) == (text or "")


def test_every_token_is_its_own_tokenization(walk):
    vocabulary, _, _ = word_trie.read_file(PATH)
    words = sorted(vocabulary)
    assert [ids for ids in walk.ids(words)] == [[vocabulary[w]] for w in words]


def test_a_shared_prefix_is_worked_out_once(walk):
    words = sorted({b"prefix" * 50 + bytes([x, y]) for x in b"abcd" for y in b"xyz"} | {b"prefix"})
    tree = {w[: k + 1] for w in words for k in range(len(w))}
    before = walk.nodes
    list(walk.ids(words))
    assert walk.nodes - before == len(tree)


def test_merges_only_by_their_pairs():
    # "abc" is made of "a" and "bc" alone, and "ab" merges first: "ab" and "c" stay apart, and "abc" never comes up.
    vocabulary = {bytes((b,)): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaa": 260}
    merges = [(b"a", b"b"), (b"b", b"c"), (b"a", b"bc"), (b"a", b"a"), (b"aa", b"a")]

    def by_merging(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            some = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not some:
                return [vocabulary[p] for p in parts]
            _, i = min(some)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    random.seed(3)
    words = sorted({"".join(random.choices("abcx", k=random.randrange(1, 12))).encode() for _ in range(500)} | {b"abc"})
    assert list(word_trie.Walk(vocabulary, merges).ids(words)) == [by_merging(w) for w in words]


@pytest.mark.parametrize("limit", [0, 5])
def test_a_small_table_changes_nothing(library, limit):
    vocabulary, merges, added = word_trie.read_file(PATH)
    table = word_trie.WordTable(word_trie.TrieEncoder(word_trie.Walk(vocabulary, merges), added, limit), limit)
    some = [t or "" for t in texts()[:80]]
    for _ in range(2):
        assert [x.tolist() for x in table.encode_texts(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_prefixes():
    for a, b, n in [(b"", b"", 0), (b"", b"a", 0), (b"ab", b"abc", 2), (b"abd", b"abc", 2), (b"x" * 999 + b"1", b"x" * 999 + b"2", 999), (b"q", b"w", 0)]:
        assert word_trie.shared_prefix(a, b) == n


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert word_trie.encode_decode(docs, PATH, "doc_id").count() == 0
