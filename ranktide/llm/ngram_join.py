"""Joining documents whose word shingles overlap, by vertical partitioning.

Two documents link if the Jaccard coefficient of their sets of five-word
shingles is at least ``percent`` / 100. All n-grams have one global order
(by document frequency, then hash). Which pairs are compared, exactly:

1. Documents of one set are one class. A document all of whose partners were
   to share less than ``percent`` of its n-grams has none: n-grams that no
   other set holds can't count, so documents with too few others drop out.
   Frequencies are exact counts, kept where the n-grams are: texts lie in
   chunks, a chunk's distinct n-grams go to buckets by range, and their
   frequency classes come back.
2. Linked sets share one of their rarest n-grams: of n, the first
   n - ceil(n * percent / 100) + 1 in the global order. Each n-gram ties its
   classes to the least of them; the components of these ties are families.
   Partners lie in one family.
3. A family's classes meet in cells of at most ``BLOCK`` by ``BLOCK``. The
   order of the n-grams' hashes is cut into ``FRAGMENTS``; every fragment of a cell is a task
   of its own that counts the partial overlaps of all the cell's pairs as a
   matrix, and the matrices are summed per pair.
4. All blocks of a family of more than ``BLOCK`` classes meet, each two once.
   Where no links are counted (``count_links``), components need less: the
   family is first compared with its most copied class alone, and only blocks
   of classes that don't link to that meet all blocks.

A cell counts every link of its classes, each as many times as the class at its
other end has copies; the sums, and the copies beside it, are a document's
number of links, so a group of copies gives as many rows as it has members.
Besides, a cell hands on as many links as connect what is linked in it; these
serve only to find the components. A family that is one cell is done with that:
only links of larger ones go through rounds of joining. N-grams are 64-bit hashes (see
``shingles``), sets 128-bit.

Defined results: null or wordless texts have an empty set and link with
nothing, each its own component; repeated rows are documents; ids that are null
are never a component's id unless it has no other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, groups_for, let_go, partitions, staged, text_keys
from ranktide.llm.components import components
from ranktide.llm.shingles import WORDS, shingle_sets

PERCENT = 80
CHUNK_BYTES = 16 << 20
FRAGMENTS = 4
BLOCK = 256
BIN_BYTES = 4 << 20
_SHORT = 24  # frequencies are counted by a hash's upper 40 bits; they only order n-grams


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending numbers as the first and 32-bit steps, where those do."""
    steps = np.diff(keys)
    if len(steps) and steps.max() >= 1 << 32:
        return b"\1" + keys.tobytes()
    return b"\0" + keys[:1].tobytes() + steps.astype("<u4").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\1":
        return np.frombuffer(blob, np.uint64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1, 1), np.frombuffer(blob, "<u4", offset=9).astype(np.uint64)]), dtype=np.uint64)


def _edges_of(buckets: int) -> np.ndarray:
    return np.array([(b << 40) // buckets for b in range(buckets)] + [1 << 40], np.uint64)


def _gather(buckets: int, words: int):
    """A chunk's distinct n-grams and how many of its sets hold each, by bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        short = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(pdf["text"].tolist(), words)]) >> np.uint64(_SHORT)
        keys, counts = np.unique(short, return_counts=True)
        cut = np.searchsorted(keys, _edges_of(buckets))
        rows = [
            (pdf["chunk"].iloc[0], b, _pack(keys[x:y]), np.minimum(counts[x:y], 255).astype(np.uint8).tobytes())
            for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y
        ]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "counts"])

    return run


def _frequency_classes(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the n-grams' document frequencies over all chunks, as whole binary logarithms."""
    lists = [_unpack(k) for k in pdf["keys"]]
    which, each = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(each, weights=np.frombuffer(b"".join(pdf["counts"]), np.uint8), minlength=len(which))
    cls = np.log2(total).astype(np.uint8)[each]
    cut = np.cumsum([0, *map(len, lists)])
    blobs = [cls[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "classes": blobs})


#: An id of null would make pandas read all ids as floats: they travel as 0 with a flag.
_DOC = "doc_id long, named boolean, k1 long, k2 long, chunk int, n long, cls string, head int, grams binary"


def _candidates(percent: int, words: int):
    """Every document of a chunk; those that may have partners with their class, and its n-grams once a chunk.

    ``grams`` lists the n-grams that other sets hold too, in the global order;
    the first ``head`` of them are among the set's rarest.
    """

    def run(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split()[0] for f in _DOC.split(", ")]
        if not len(docs):
            return pd.DataFrame(columns=columns)
        sets = list(shingle_sets(docs["text"].tolist(), words))
        keys, each = np.unique(np.concatenate(sets) >> np.uint64(_SHORT), return_inverse=True)
        classes = np.frombuffer(b"".join(back.sort_values("bucket")["classes"]), np.uint8)
        if len(classes) != len(keys):
            raise RuntimeError("a chunk's n-grams changed between two reads")
        classes = classes[each]
        at, seen, rows = 0, set(), []
        for grams in sets:
            n = len(grams)
            freq = classes[at : at + n]
            at += n
            shared = int((freq > 0).sum())
            least = least_overlap(n, percent)
            if not n or shared < least:
                rows.append((n, None, 0, None))
                continue
            cls = hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest()
            blob = None
            if cls not in seen:
                seen.add(cls)
                order = np.lexsort((grams, freq))[n - shared :]
                blob = grams[order].tobytes()
            rows.append((n, cls, shared - least + 1, blob))
        out = pd.DataFrame(rows, columns=["n", "cls", "head", "grams"])
        for c in ("doc_id", "named", "k1", "k2", "chunk"):
            out[c] = docs[c].to_numpy()
        return out[columns]

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rarest shared n-grams of each class."""
    for b in batches:
        cls, grams = [], []
        for c, head, blob in zip(*(b.column(k).to_pylist() for k in ("cls", "head", "grams")), strict=True):
            some = np.frombuffer(blob, np.int64, head)
            grams.append(some)
            cls += [c] * len(some)
        yield pa.RecordBatch.from_pydict({
            "gram": pa.array(np.concatenate([np.zeros(0, np.int64), *grams])), "cls": pa.array(cls, pa.string())
        })


_CELL = ["family", "i", "j"]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class in a cell -> its part of each fragment of the hashes' order."""
    keep = ["bin", *_CELL, "role", "cls"]
    for b in batches:
        whole = [np.frombuffer(g, np.uint64) for g in b.column("grams").to_pylist()]
        part = [np.right_shift(w, np.uint64(62)) * np.uint64(FRAGMENTS) // np.uint64(4) for w in whole]
        for f in range(FRAGMENTS):
            blobs = [w[p == f].tobytes() for w, p in zip(whole, part, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array([f] * b.num_rows, pa.int32()), pa.array(blobs, pa.binary())],
                names=[*keep, "fragment", "grams"],
            )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set has in common with each right set."""
    size = np.array([len(r) for r in right])
    names, each = np.unique(np.concatenate([*right, np.zeros(0, np.uint64)]), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), size)
    out = np.zeros((len(left), len(right)), np.uint32)
    here = np.zeros(len(names) + 1, np.uint8)
    for row, grams in zip(out, left, strict=True):
        at = np.minimum(np.searchsorted(names, grams), max(len(names) - 1, 0))
        if len(names):
            at = at[names[at] == grams]
            here[at] = 1
            row[:] = np.bincount(owner[here[each] > 0], minlength=len(right))
            here[at] = 0
    return out


def _count_overlaps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial overlaps of all pairs of each cell in one fragment."""
    rows = []
    for cell, part in pdf.sort_values("cls").groupby(_CELL):
        grams = [np.frombuffer(g, np.uint64) for g in part["grams"]]
        role = part["role"].to_numpy()
        lefts, rights = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        found = overlaps([grams[i] for i in lefts], [grams[i] for i in rights])
        rows.append((pdf["bin"].iloc[0], *cell, found.tobytes()))
    return pd.DataFrame(rows, columns=["bin", *_CELL, "counts"])


def _links_of(percent: int):
    """Sums of the partial overlaps of each pair -> for each class the copies of all classes that it links to in a cell
    (``v`` null), and links (u, v) that connect what is linked in the cell, all with its least class where it is
    ``whole``."""

    def run(counts: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        u, v, links, done = [], [], [], []
        members = {k: p for k, p in cells.sort_values("cls").groupby(_CELL)}
        for cell, part in counts.groupby(_CELL):
            names, n, role, copies, whole = (members[cell][k].to_numpy() for k in ("cls", "n", "role", "copies", "whole"))
            lefts, rights = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            both = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in part["counts"]).reshape(len(lefts), len(rights))
            union = n[lefts][:, None] + n[rights][None, :] - both
            linked = (100 * both >= percent * union) & (lefts[:, None] != rights[None, :])
            # A class on both sides meets each other of these in two places: it counts on the left.
            far = np.zeros(len(names), np.int64)
            far[lefts] += linked @ copies[rights]
            alone = role[rights] == 2
            far[rights[alone]] += copies[lefts] @ linked[:, alone]
            some = np.flatnonzero(far)
            above, apart = np.arange(len(names)), len(names) - 1

            def root(z: int, above: np.ndarray = above) -> int:
                while above[z] != z:
                    above[z] = above[above[z]]
                    z = above[z]
                return z

            ends = []
            for a, b in zip(*np.nonzero(linked), strict=True):
                if not apart:
                    break
                x, y = root(lefts[a]), root(rights[b])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    apart -= 1
                    ends.append((lefts[a], rights[b]))
            if whole[0]:
                ends = [(z, root(z)) for z in range(len(names)) if root(z) != z]
            u += names[some].tolist() + [names[x] for x, _ in ends]
            v += [None] * len(some) + [names[y] for _, y in ends]
            links += far[some].tolist() + [0] * len(ends)
            done += [bool(whole[0])] * (len(some) + len(ends))
        return pd.DataFrame({
            "u": pd.Series(u, dtype=object), "v": pd.Series(v, dtype=object), "links": pd.Series(links, dtype="int64"), "done": pd.Series(done, dtype=bool)
        })

    return run


def compare(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect the classes linked in a cell, and rows (u, null, links) of a class's links in a cell;
    ``done`` says that the cell was ``whole``.

    ``cells``: family, i, j, role (1: left, 2: right, 3: both), cls, n, copies,
    chunk, whole (all of its family); ``sets``: cls, chunk, grams.
    """
    size = cells.agg(F.sum(8 * F.col("n")).alias("n")).first()["n"] or 0
    bins = max(partitions(cells), -(-int(size) // BIN_BYTES))
    cells = cells.withColumn("bin", F.pmod(F.xxhash64(*_CELL), F.lit(bins)).cast("int"))
    schema = "bin int, family string, i int, j int, role int, cls string, fragment int, grams binary"
    parts = cells.join(sets, ["cls", "chunk"]).drop("chunk").mapInArrow(_fragments, schema)
    counts = parts.groupBy("bin", "fragment").applyInPandas(_count_overlaps, "bin int, family string, i int, j int, counts binary")
    members = cells.select("bin", *_CELL, "role", "cls", "n", "copies", "whole")
    found = counts.groupBy("bin").cogroup(members.groupBy("bin"))
    return found.applyInPandas(_links_of(percent), "u string, v string, links long, done boolean")


def _family_links(classes: DataFrame, families: DataFrame, sets: DataFrame, percent: int, count_links: bool) -> DataFrame:
    """What ``compare`` gives for the classes of every family: links that connect them as all pairs would and, with
    ``count_links``, the sums of all links."""
    members = classes.join(families.select(F.col("node").alias("cls"), F.col("component").alias("family")), "cls")
    # The class with most copies leads; ties go to the least key. (Joins with written tables can split a large family.)
    sizes = members.groupBy("family").agg(
        F.count("*").alias("size"), F.min(F.struct(-F.col("copies"), F.col("cls"))).alias("lead")
    )
    sizes = staged(sizes.select("family", "size", F.col("lead.cls").alias("lead")), "ngram-sizes")
    members = staged(members.join(sizes, "family"), "ngram-families")
    zero = F.lit(0)
    small = members.where(F.col("size") <= BLOCK).select(
        "family", zero.alias("i"), zero.alias("j"), F.lit(3).alias("role"), "cls", "n", "copies", "chunk",
        F.lit(True).alias("whole"),
    )
    large = members.where(F.col("size") > BLOCK).withColumns({
        "blocks": F.ceil(F.col("size") / BLOCK).cast("int"), "whole": F.lit(False),
    })
    if large.isEmpty():
        return compare(small, sets, percent)
    block = lambda of: F.pmod(F.xxhash64("cls"), F.col(of)).cast("int")
    pick = ["family", "i", "j", "role", "cls", "n", "copies", "chunk", "whole"]
    if count_links:
        own, other = F.col("own"), F.col("other")
        pairs = large.withColumn("own", block("blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.withColumns({
            "i": F.least(own, other), "j": F.greatest(own, other),
            "role": F.when(own < other, 1).when(own > other, 2).otherwise(3),
        })
        return compare(small.unionByName(pairs.select(*pick)), sets, percent)
    follower = large.where("cls <> lead").select(
        "family", F.lit(-1).alias("i"), block("blocks").alias("j"), F.lit(2).alias("role"), "cls", "n", "copies", "chunk",
        "whole",
    )
    leader = large.where("cls = lead").select(
        "family", F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
        F.lit(1).alias("role"), "cls", "n", "copies", "chunk", "whole",
    )
    done = staged(compare(small.unionByName(follower).unionByName(leader), sets, percent), "ngram-links")
    led = done.where("v IS NOT NULL AND NOT done").select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    rest = large.where("cls <> lead").join(led, "cls", "left_anti")
    left_over = rest.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    # In a cell of the rest's block i and all classes' block j a class can be on either side or on both.
    as_left = rest.join(left_over, "family").withColumn("i", block("rows")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    as_right = large.join(left_over, "family").withColumn("j", block("blocks")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))
    )
    again = (
        as_left.withColumn("role", F.lit(1)).select(*pick)
        .unionByName(as_right.withColumn("role", F.lit(2)).select(*pick))
        .groupBy("family", "i", "j", "cls", "n", "copies", "chunk", "whole").agg(F.sum("role").cast("int").alias("role"))
    )
    return done.unionByName(compare(staged(again, "ngram-cells"), sets, percent))


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, chunk_bytes: int = CHUNK_BYTES, count_links: bool = False
) -> DataFrame:
    """One row per document: doc_id, k1, k2 (the text's key), n_shingles, component, component_id and, with
    ``count_links``, n_links (the other documents whose sets link with this one's).

    ``component`` names the group of linked documents (null: linked with
    nothing and no other document has its set, as far as counted);
    ``component_id`` is its smallest doc_id.
    """
    k1, k2 = text_keys()
    chunks = groups_for(docs, "text", chunk_bytes)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"),
        "text", k1, k2, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    sent = rows.groupBy("chunk").applyInPandas(_gather(chunks, words), "chunk int, bucket int, keys binary, counts binary")
    back = sent.groupBy("bucket").applyInPandas(_frequency_classes, "chunk int, bucket int, classes binary")
    read = staged(
        rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(_candidates(percent, words), _DOC),
        "ngram-documents", codec="snappy",
    )
    known = read.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")
    classes = staged(
        known.where("cls IS NOT NULL").groupBy("cls").agg(
            F.count("*").alias("copies"), F.max("n").alias("n"), F.min("chunk").alias("chunk"), F.min("doc_id").alias("first")
        ),
        "ngram-classes",
    )
    sets = known.where("grams IS NOT NULL").select("cls", "chunk", "head", "grams")
    heads = sets.select("cls", "head", "grams").mapInArrow(_heads, "gram long, cls string")
    ties = heads.groupBy("gram").agg(F.min("cls").alias("u"), F.max("cls").alias("v")).where("u < v").select("gram", "u")
    families = components(heads.join(ties, "gram").select("u", F.col("cls").alias("v")))
    found = staged(_family_links(classes, families, sets.select("cls", "chunk", "grams"), percent, count_links), "ngram-found")
    linked = found.where("v IS NOT NULL")
    groups = components(linked.where("NOT done").select("u", "v")).select(F.col("node").alias("cls"), "component")
    groups = groups.unionByName(linked.where("done").select(F.col("u").alias("cls"), F.col("v").alias("component")))
    named = classes.join(groups, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), "first", "copies")
    result = ["doc_id", "k1", "k2", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id")]
    of_class = ["cls", "component"]
    if count_links:
        far = staged(found.where("v IS NULL").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("far")), "ngram-counts")
        named = named.join(far, "cls", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("far", F.lit(0)))
        result.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
        of_class.append("n_links")
    named = staged(named, "ngram-groups")
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = staged(named.select(*of_class).join(ids, "component"), "ngram-verdicts")
    return known.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "cls").join(by_class, "cls", "left").select(*result)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the group it is linked into."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, the number of documents it links with and the group it is linked into."""
    found = near_duplicates(documents(spark, sf_dir), count_links=True)
    return found.select("doc_id", "n_shingles", "n_links", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \t-\r]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
        ELSE array_to_string(words[i : i + 4], ' ') END AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
     LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY 1) m ON m.x = d.doc_id
"""

LINKS_SQL = ORACLE_SQL.replace(
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,",
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links,",
)
