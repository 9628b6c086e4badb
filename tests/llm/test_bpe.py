import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ranktide.llm import bpe
from ranktide.llm.pieces import PieceEncoder, WordTable, split

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange_texts(n: int) -> list[str]:
    random.seed(7)
    alphabets = ["ab eét'si1!\n\t 日Ⅷ²　\x1c\x85\x00", "ab eét'si1!.\n\t ab", "the and ing of. "]
    out = ["".join(random.choice(a) for _ in range(random.randint(0, 30))) for _ in range(n) for a in alphabets]
    words = ["ab", "don't", "x\n", "1.5", "\n", "the", "é,", "a\tb", "\r", "<|endoftext|>", "longwordwithoutend" * 4]
    return out + [" ".join(random.choice(words) for _ in range(random.randint(0, 12))) for _ in range(n)]


def test_table_equals_the_library(ranks, library):
    texts = strange_texts(3000) + ["", "a" * 4000, " " * 3000, "日本語" * 400, "x y" * 5000]
    transducer = bpe.Transducer(ranks)
    table = WordTable(PieceEncoder(lambda p: transducer.encode(p.encode())))
    for text, ids in zip(texts, table.encode_texts(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)


def test_tables_that_start_anew_give_the_same(ranks, library):
    transducer = bpe.Transducer(ranks, states=40)
    table = WordTable(PieceEncoder(lambda p: transducer.encode(p.encode()), limit=10), limit=10)
    texts = strange_texts(200)
    for _ in range(3):
        for text in texts:
            (ids,) = table.encode_texts([text])
            assert ids.tolist() == library.encode_ordinary(text)


def test_transducer_on_any_bytes(ranks, library):
    random.seed(8)
    transducer = bpe.Transducer(ranks)
    for _ in range(2000):
        piece = bytes(random.choice(b"thein gaos\xc3\xa9re\xff") for _ in range(random.randint(1, 25)))
        assert transducer.encode(piece) == library._core_bpe.encode_single_piece(piece)


def test_emission_is_early(ranks):
    transducer = bpe.Transducer(ranks)
    transducer.encode(b" zq" * 500)
    assert max(len(key[1]) for key, _ in transducer.state) < 2 * transducer.longest


def test_pieces_join_to_the_text():
    for text in strange_texts(300):
        assert "".join(split(text)) == text


def test_streaming_decode(ranks, library):
    decoder = bpe.Decoder(ranks)
    text = "naïve 日本語 🙂 end"
    ids = np.array(library.encode_ordinary(text), np.uint32)
    assert decoder.to_bytes(ids) == text.encode()
    parts = list(decoder.to_text(ids[i : i + 1] for i in range(len(ids))))
    assert "".join(parts) == text and not any("�" in p for p in parts)
    stream = bpe.Utf8Stream()
    assert "".join(stream.feed(bytes([b])) for b in text.encode()) + stream.end() == text
    assert stream.feed(b"a\xf0\x9f") == "a" and stream.end() == "�"
    assert stream.feed(b"\xffb") == "�b"


def test_round_trip(spark):
    rows = [(1, "a b"), (None, None), (2, ""), (2, "日本 语" * 2000), (2, "日本 语" * 2000)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, ids binary")
    out = bpe.encode_decode(docs, PATH).collect()
    assert sorted(r["decoded"] for r in out) == sorted(t or "" for _, t in rows)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)
    assert bpe.encode_decode(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("letters", ["acgt", "abcdefghijklmnopqrstuvwxyz", "日本語é"])
def test_a_word_longer_than_the_automaton(ranks, library, letters):
    random.seed(9)
    piece = "".join(random.choices(letters, k=6000))
    transducer = bpe.Transducer(ranks, states=1000)
    for _ in range(2):
        assert transducer.encode(piece.encode()) == library.encode_ordinary(piece)
    assert len(transducer.state) <= 2001
