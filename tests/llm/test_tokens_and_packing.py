import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ranktide.llm import hf, packing, token_files
from ranktide.llm.common import stage_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return t


def rows():
    random.seed(4)
    words = ["the", "Of", "ñandú", "x1.", "\n", "日本", "<|endoftext|>", "a\t b"]
    out = [(i * 3 % 101, " ".join(random.choice(words) for _ in range(random.choice([0, 1, 5, 60, 900])))) for i in range(101)]
    return out + [(500, None), (501, ""), (None, "no id"), (7, "repeated"), (7, "repeated")]


def frame(spark):
    return spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, start int").repartition(4)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack_unpack():
    random.seed(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = np.array([random.choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, random.randrange(1 << 20)]) for _ in range(n)], np.uint32)
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4)
        assert token_files.unpack(control, data, n).tolist() == values.tolist()


def test_files_hold_the_librarys_ids(spark, library):
    out = stage_path(spark, "test-files")
    token_files.write_token_files(frame(spark), PATH, 2, out)
    got = token_files.read_token_files(spark, out).collect()
    want = sorted(((d is not None, d or 0, crc(ids := [*library.encode(t or "", add_special_tokens=False).ids, 2]), ids) for d, t in rows()))
    mine = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in mine] == [d if k else None for k, d, *_ in want]
    at = 0
    for r in mine:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"], np.frombuffer(r["ids"], "<u4").tolist()) for r in mine) == want
    # More frequent ids have smaller ranks.
    ranks = [r["id"] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()]
    count = defaultdict(int)
    for *_, ids in want:
        for i in ids:
            count[i] += 1
    assert ranks == sorted(count, key=lambda i: (-count[i], i))


def test_empty_files(spark):
    out = stage_path(spark, "test-files")
    token_files.write_token_files(frame(spark).where("false"), PATH, 2, out)
    assert token_files.read_token_files(spark, out).count() == 0


def test_room_tree_finds_the_first():
    random.seed(2)
    tree, room = packing.RoomTree(37, 100), [100] * 37
    for _ in range(300):
        need = random.randint(1, 60)
        want = next((i for i, r in enumerate(room) if r >= need), None)
        if want is None:
            break
        assert tree.first_fit(need) == want
        room[want] -= need


@pytest.mark.parametrize("lengths", [[], [1], [1024], [1025], [5000, 1, 1023], None])
def test_every_id_in_one_piece(lengths):
    random.seed(3)
    lengths = lengths if lengths is not None else [random.randint(1, 3000) for _ in range(500)]
    bins = packing.pack_lengths(lengths)
    pieces = defaultdict(list)
    for b in bins:
        assert 0 < sum(n for *_, n in b) <= 1024
        for d, a, n in b:
            pieces[d].append((a, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(pieces[d]):
            assert a == at and k > 0
            at += k
        assert at == n
    assert len(bins) * 1024 - sum(lengths) < 1024


def test_packing(spark, library):
    out = packing.pack_documents(frame(spark), PATH, group_bytes=2000).collect()
    want = sorted(crc([*library.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in rows())
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    whole = []
    for d, pieces in docs.items():
        pieces.sort(key=lambda r: (r["sequence_id"] >> 32, r["start"]))
        if d == 7:  # repeated rows: which copy a piece is of can't be told
            assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
            continue
        ids = b"".join(r["ids"] for r in pieces)
        assert {r["doc_tokens"] for r in pieces} == {len(ids) // 4}
        whole.append(zlib.crc32(ids))
    assert not set(whole) - set(want)
    assert packing.pack_documents(frame(spark).where("false"), PATH).count() == 0


def test_words_in_a_row_are_the_librarys_texts(library):
    random.seed(9)
    alphabets = ["ab eét'si1!\n\t 日Ⅷ²　\x1c\x85\x00", "ab eét'si1!.\n\t ab", "the and ing of. ", "ab \n"]
    texts = ["".join(random.choice(a) for _ in range(random.randint(0, 30))) for _ in range(1500) for a in alphabets]
    words = ["ab", "don't", "<|endoftext|>", "x\ny", "é,", "a\tb", "w" * 50, "é" * 20]
    texts += [" ".join(random.choice(words) for _ in range(random.randint(0, 12))) for _ in range(1500)]
    for text, ids in zip(texts, hf.encode_texts(PATH, texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
