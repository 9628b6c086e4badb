import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(["in", "er", "of", "the", "an", "tion"]) + r.choice(["ou", "and", "st", "ed"]) + r.choice(["ing", "re", "es", ""]) for _ in range(n)]


def rows():
    out = [(i, " ".join(words(80, i)) + ".", "en", "s", 1) for i in range(20)]
    out += [(100, None, "en", "s", None), (101, "", "en", "s", 0), (102, "12345 %%%", None, "s", 9), (103, "Ελληνικά " * 20, None, "s", 180)]
    base = words(200, 50)
    for i in range(6):  # near copies: one word of each is another
        out.append((200 + i, " ".join(base[:i] + ["other"] + base[i + 1 :]), "en", "s", 1))
    out += [(300, out[3][1], "en", "t", 1), (None, out[4][1], "en", "t", 1), (5, out[5][1], "en", "s", 1)]
    passage = " ".join(words(60, 99))
    for i in range(3):
        out.append((400 + i, " ".join(words(70, 400 + i)) + " \n" + passage + " é " + " ".join(words(70, 500 + i)), "en", "s", 1))
    return out, passage


@pytest.fixture(scope="module")
def stages(spark):
    data, _ = rows()
    docs = spark.createDataFrame(data, COLUMNS).repartition(3)
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, ""), "test-stage")
        out.append(docs.collect())
    return out


def test_language(stages):
    gone = Counter(r["doc_id"] for r in stages[0]) - Counter(r["doc_id"] for r in stages[1])
    assert gone == Counter([100, 101, 102, 103])
    assert stages[1][0].asDict().keys() == stages[0][0].asDict().keys()


def test_one_of_each_group_stays(stages):
    before = Counter(r["doc_id"] for r in stages[1])
    after = Counter(r["doc_id"] for r in stages[2])
    assert before - after == Counter([201, 202, 203, 204, 205, 300, None, 5])
    assert {tuple(r) for r in stages[2]} <= {tuple(r) for r in stages[1]}


def test_passages_are_cut(stages):
    _, passage = rows()
    texts = {r["doc_id"]: r["text"] for r in stages[2]}
    for r in stages[3]:
        if r["doc_id"] > 400:
            assert passage[20:-20] not in r["text"] and len(r["text"]) > len(texts[r["doc_id"]]) - len(passage) - 80
        else:
            assert r["text"] == texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert len(stages[3]) == len(stages[2])


def test_packed(stages):
    loads, tokens = defaultdict(int), defaultdict(int)
    for r in stages[4]:
        loads[r["sequence_id"]] += r["length"]
        tokens[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert max(loads.values()) <= 1024
    assert set(tokens) == {r["doc_id"] for r in stages[3]}


def test_foreign_texts_in_the_same_script_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = random.Random(7)
    foreign = [
        "Gli uomini nascono liberi e uguali in dignità e diritti; sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. " * 3,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
        "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. " * 3,
        " ".join("".join(r.choices("0123456789abcdef", k=32)) for _ in range(30)),
    ]
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    left = {x["doc_id"] for x in cp.language_stage(spark, both, sf).select("doc_id").collect()}
    known = {x["doc_id"] for x in docs.where("text RLIKE '\\\\p{L}'").select("doc_id").collect()}
    assert not [d for d in left if d < 0]
    assert len(known - left) <= len(known) // 200


def repeats(spark, data):
    docs = spark.createDataFrame(data, COLUMNS).repartition(3)
    return {r["doc_id"]: r["text"] for r in cp.repeats_stage(spark, docs, "").collect()}


def test_one_copy_of_a_passage_stays(spark):
    quoted = " ".join(words(100, 1))
    short = " ".join(["it", "is", "an", "ox", "at"][(i * i + i // 5) % 5] for i in range(60))  # 60 words, under 200 bytes
    assert len(short) < 200
    rest = [" ".join(words(60, 10 + i)) for i in range(6)]
    data = [
        (2, rest[0] + "\n" + quoted + "\n" + rest[1], "en", "s", 1), (9, quoted, "en", "s", 1),  # the longer one came first
        (11, quoted[:-3], "en", "s", 1), (None, rest[2] + " | " + short, "en", "s", 1),
        (20, rest[3] + " | " + short + " | " + rest[4], "en", "s", None), (21, short + " | " + rest[5], "en", "s", 1),
    ]
    left = repeats(spark, data)
    assert left[2] == data[0][1] and left[20] == data[4][1]
    assert 9 not in left and 11 not in left
    for doc_id, text in ((21, rest[5]), (None, rest[2])):
        assert text[3:-3] in left[doc_id] and short[5:-5] not in left[doc_id]
    one = repeats(spark, [(5, quoted, "en", "s", 1), (3, quoted[1:], "en", "s", 1), (4, "x " + quoted[1:], "en", "s", 1)])
    assert one == {3: quoted[1:], 4: "x ", 5: quoted[0]}


def test_columns_of_any_name(spark):
    names = ["score", "rate", "lang_pred", "kept", "spans", "n_bytes", "k1", "k2", "bucket", "row", "own", "a.b", "found", "cls"]
    data, _ = rows()
    docs = spark.createDataFrame(data, COLUMNS).where("doc_id < 10 OR doc_id >= 200").repartition(2)
    for n in names:
        docs = docs.withColumn(n, cp.F.lit(f"own {n}"))
    docs = docs.unionByName(spark.createDataFrame([(900, "a long tail " * 120_000, "en", "s", 1)], COLUMNS), allowMissingColumns=True)
    for _, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, ""), "test-stage")
        got = docs.where("doc_id < 900").collect()
        assert got and all(r[n] == f"own {n}" for r in got for n in names)
    assert cp.packing_stage(spark, docs, "").count() > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, ""), "test-stage")
    assert docs.count() == 0


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
