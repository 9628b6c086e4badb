"""A Merkle manifest of a dataset, with a witness for every row, by aligned appends.

Every row is a leaf. A group's leaves, in order, are the lowest nodes of its
tree: ``FANOUT`` in a row (the last ones: fewer, even one) make a node of the
next level, until one is left, the group's subroot. The subroots in the groups'
order make the root in the same way. A row's witness is, level by level, the
nodes before and after its own in their run; leaf and witness give the root.

Witnesses come about while nodes are appended (``Appender``): a new node of an
open run extends the partial witnesses of the nodes before it and starts its own
with them; a run that is full, or closed, becomes a node of the run above, to
which the witnesses below it are tied. So a node costs the same wherever it
stands, and a witness serves all leaves under its node.

Appends are aligned, which lets them run apart: blocks of ``FANOUT ** LEVELS``
leaves are whole subtrees, each appended by a task of its own. Block roots are
in turn nodes appended in blocks, so a tree of n leaves takes log n / LEVELS
rounds. Then rounds are gone through from the top: a block is appended again,
and its nodes' witnesses go on with its own. No task holds more than a block,
however large a group is, and witnesses never move.

A leaf's place in its group comes from a sort by range over all rows: the place
within the range's part, after the counts of the parts before it.

Defined results: null fields are ``-``; a null group is one of its own and comes
first; rows without id come first in their group, rows of one id in the order
of their leaves, so repeated rows stand side by side; one row alone is its
group's subroot, one group's subroot the root; an empty table gives no rows.
Columns kept go by any name: those of the result come after them.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.llm.common import documents, partitions, schema_of, staged

FANOUT, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<before:string,after:string>>"
_WITNESS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(leaves: int, fanout: int = FANOUT) -> int:
    """The levels above so many leaves."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // fanout), n + 1
    return n


class Witness:
    """The nodes before and after one in its run, as far as they are there, and the witness of the node that the run makes."""

    __slots__ = ("before", "after", "above")

    def __init__(self, before: list[str]):
        self.before, self.after, self.above = before, [], None

    def levels(self) -> Iterator[tuple[str, str]]:
        at = self
        while at is not None:
            yield "".join(at.before), "".join(at.after)
            at = at.above


class Appender:
    """A tree of ``levels`` levels to which nodes are appended from left to right."""

    def __init__(self, levels: int, fanout: int = FANOUT):
        self.fanout = fanout
        self.runs: list[list[tuple[str, Witness]]] = [[] for _ in range(levels)]
        self.root: str | None = None

    def append(self, node: str, level: int = 0) -> Witness | None:
        """The node's witness, which later appends extend (none: the node is the root)."""
        if level == len(self.runs):
            if self.root is not None:
                raise ValueError("more nodes than the levels hold")
            self.root = node
            return None
        run = self.runs[level]
        mine = Witness([n for n, _ in run])
        for _, earlier in run:
            earlier.after.append(node)
        run.append((node, mine))
        if len(run) == self.fanout:
            self._finish(level)
        return mine

    def _finish(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        above = self.append(digest([n for n, _ in run]), level + 1)
        for _, w in run:
            w.above = above

    def close(self) -> str | None:
        """The root of what was appended."""
        for level, run in enumerate(self.runs):
            if run:
                self._finish(level)
        return self.root


def leaf(values: list[Column]) -> Column:
    """The digest of a row's values: each as its UTF-8 byte count, a colon and itself, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with _pos (from 0, in the group) and _size (the group's rows). Group columns aren't null."""
    salt = F.xxhash64(F.monotonically_increasing_id())  # rows that are alike needn't lie in one part
    keys = [*group, *order, "_salt"]
    ranged = rows.withColumn("_salt", salt).repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys).drop("_salt")
    parts = F.shiftright("_at", 33).alias("_part")
    kept = staged(ranged.withColumn("_at", F.monotonically_increasing_id()).select("*", parts), "merkle-ranges")
    counts = kept.groupBy("_part", *group).agg(F.count("*").alias("n"), F.min("_at").alias("least"))
    # One row a part and group: a group's rows here are as many as it has parts.
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", *group, (before - F.col("least")).alias("_shift"), F.sum("n").over(own).alias("_size"))
    # No key has more rows than a part.
    found = kept.join(staged(counts, "merkle-parts"), ["_part", *group]).withColumn("_pos", F.col("_at") + F.col("_shift"))
    return staged(found.drop("_at", "_part", "_shift"), "merkle-leaves")


def _append_all(nodes: list[str], size: int, fanout: int, levels: int) -> tuple[str, list[Witness | None]]:
    """A block's root and its nodes' witnesses; ``size`` is the group's nodes."""
    tree = Appender(levels if size > fanout**levels else height(size, fanout), fanout)
    found = [tree.append(n) for n in nodes]
    return tree.close(), found


def _block_roots(group: list[str], fanout: int, levels: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("_pos")
        size = block.column("_size")[0].as_py()
        root, _ = _append_all(block.column("_node").to_pylist(), size, fanout, levels)
        width = fanout**levels
        one = block.slice(0, 1).select(group)
        return one.append_column("_pos", pa.array([block.column("_pos")[0].as_py() // width])).append_column(
            "_size", pa.array([-(-size // width)])).append_column("_node", pa.array([root]))

    return run


def _block_witnesses(columns: list[str], fanout: int, levels: int):
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("_pos")
        _, found = _append_all(block.column("_node").to_pylist(), block.column("_size")[0].as_py(), fanout, levels)
        upper = above.column("_witness")[0].as_py()
        rest = [(w["before"], w["after"]) for w in upper]
        made: dict[int, list[tuple[str, str]]] = {}  # siblings' witnesses differ in their lowest level only
        befores, afters, ends = [], [], [0]
        for w in found:
            if w is not None:
                befores.append("".join(w.before))
                afters.append("".join(w.after))
                if id(w.above) not in made:
                    made[id(w.above)] = [*(w.above.levels() if w.above else ()), *rest]
            more = made[id(w.above)] if w is not None else rest
            befores += [a for a, _ in more]
            afters += [b for _, b in more]
            ends.append(len(befores))
        pairs = pa.StructArray.from_arrays([pa.array(befores, pa.string()), pa.array(afters, pa.string())], names=["before", "after"])
        out = block.select(columns).append_column("_witness", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=_WITNESS))
        for c in ("_subroot", "_root"):
            out = out.append_column(c, pa.array([above.column(c)[0].as_py()] * len(block), pa.string()))
        return out

    return run


def climb(nodes: DataFrame, group: list[str], fanout: int, levels: int) -> list[DataFrame]:
    """All rounds of the trees, from the given nodes (group, _pos, _size, _node) to one node a group."""
    width = F.lit(fanout**levels)
    rounds = [nodes]
    most = nodes.agg(F.max("_size").alias("n")).first()["n"] or 0
    schema = schema_of(nodes, group, "_pos long, _size long, _node string")
    while most > 1:
        some = rounds[-1].select(*group, "_pos", "_size", "_node", F.floor(F.col("_pos") / width).alias("_block"))
        roots = some.groupBy(*group, "_block").applyInArrow(_block_roots(group, fanout, levels), schema)
        rounds.append(staged(roots, "merkle-roots"))
        most = -(-most // fanout**levels)
    return rounds


def descend(rounds: list[DataFrame], top: DataFrame, group: list[str], fanout: int, levels: int) -> DataFrame:
    """The first round's rows with _witness, _subroot and _root, given those of each group's last node (``top``)."""
    width = F.lit(fanout**levels)
    above = rounds[-1].join(top, group) if len(rounds) == 1 else top.withColumn("_pos", F.lit(0).cast("long"))
    for i, nodes in reversed(list(enumerate(rounds[:-1]))):
        columns = nodes.columns if i == 0 else [*group, "_pos"]
        blocks = nodes.withColumn("_block", F.floor(F.col("_pos") / width)).groupBy(*group, "_block")
        schema = schema_of(nodes, columns, f"_witness {WITNESS}, _subroot string, _root string")
        over = above.select(*group, F.col("_pos").alias("_block"), "_witness", "_subroot", "_root").groupBy(*group, "_block")
        above = blocks.cogroup(over).applyInArrow(_block_witnesses(columns, fanout, levels), schema)
        if i:
            above = staged(above, "merkle-witnesses")
    return above


def manifest(
    docs: DataFrame, *keep: Column, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS,
    fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """The ``keep`` columns (named) of every row with leaf, subroot, root and witness (its levels, lowest first).

    ``columns`` make the leaf; ``group`` (a string) says whose tree it is in, ``order`` where.
    """
    key = F.col(f"`{group}`")
    names = [f"_keep{i}" for i in range(len(keep))]
    chosen = docs.select(*keep)
    rows = docs.select(
        *[c.alias(k) for c, k in zip(keep, names, strict=True)], key.isNotNull().alias("_named"),
        F.coalesce(key, F.lit("")).alias("_group"), F.col(f"`{order}`").alias("_order"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("_node"),
    )
    rows = staged(rows, "merkle-rows")  # texts are read once
    by = ["_named", "_group"]  # null first, then by bytes
    rounds = climb(placed(rows, by, [F.col("_order").asc_nulls_first(), F.col("_node")]), by, fanout, levels)
    subroots = rounds[-1].select(*by, F.col("_node").alias("_node"), F.lit(0).alias("_all"))
    over = climb(placed(subroots, ["_all"], [F.col("_named"), F.col("_group")]), ["_all"], fanout, levels)
    none = F.lit([]).cast(WITNESS)
    root = over[-1].select("_all", none.alias("_witness"), F.lit("").alias("_subroot"), F.col("_node").alias("_root"))
    groups = descend(over, root, ["_all"], fanout, levels)
    top = staged(groups.select(*by, "_witness", F.col("_node").alias("_subroot"), "_root"), "merkle-groups")
    found = descend(rounds, top, by, fanout, levels)
    return found.select(
        *[F.col(k).alias(c) for c, k in zip(chosen.columns, names, strict=True)], F.col("_node").alias("leaf"),
        F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_witness").alias("witness"),
    )


def folded(start: Column, witness: str = "witness") -> Column:
    """The root that a leaf and a witness give."""
    return F.aggregate(witness, start, lambda node, w: F.sha2(F.concat(w["before"], node, w["after"]), 256))


def siblings(witness: str = "witness") -> Column:
    """All siblings of a witness, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["before"], w["after"])), "")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the proof holds for the row as found: a third is tampered with."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    values = [lower if c == "text" else F.col(c) for c in COLUMNS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(values))
    found = manifest(documents(spark, sf_dir), F.col("doc_id"), changed.alias("changed"))
    found = found.withColumn("folded_root", folded(F.coalesce("changed", "leaf")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def oracle_sql(group_levels: int = 8, top_levels: int = 4, fanout: int = FANOUT) -> str:
    """The contract in SQL, for up to ``fanout ** group_levels`` rows a language and ``fanout ** top_levels`` languages."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    plain = "sha256(" + " || ".join(value(c) for c in COLUMNS) + ")"
    changed = "sha256(" + " || ".join(value(low if c == "text" else c) for c in COLUMNS) + ")"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    bytes_ = "list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {byte}), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, lang, {plain} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {changed} END AS changed FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,"
        " count(*) OVER (PARTITION BY lang) AS n, leaf AS node FROM d)",
        "f0 AS (SELECT doc_id, lang, leaf, pos, coalesce(changed, leaf) AS cur, '' AS proof FROM a0)",
    ]

    def levels(a: str, f: str, key: str, place: str, count: int) -> None:
        for k in range(count):
            run = f"PARTITION BY {key}, pos // {fanout} ORDER BY pos ROWS BETWEEN"
            parts.append(
                f"{a}s{k} AS (SELECT {key}, pos, n, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,"
                f" coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {a}{k})"
            )
            parts.append(
                f"{f}{k + 1} AS (SELECT f.* EXCLUDE (cur, proof), CASE WHEN s.n > 1 THEN sha256(pre || cur || post) ELSE cur END AS cur,"
                f" proof || CASE WHEN s.n > 1 THEN pre || post ELSE '' END AS proof FROM {f}{k} f JOIN {a}s{k} s"
                f" ON f.{key} IS NOT DISTINCT FROM s.{key} AND f.{place} // {fanout**k} = s.pos)"
            )
            parts.append(
                f"{a}{k + 1} AS (SELECT {key}, pos // {fanout} AS pos, (n + {fanout - 1}) // {fanout} AS n,"
                f" CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node"
                f" FROM {a}{k} GROUP BY {key}, pos // {fanout}, n)"
            )

    levels("a", "f", "lang", "pos", group_levels)
    parts.append(
        f"b0 AS (SELECT 0 AS one, lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{group_levels})"
    )
    parts.append(
        f"g0 AS (SELECT doc_id, leaf, b.node AS subroot, 0 AS one, b.pos AS turn, cur, proof FROM f{group_levels} f"
        " JOIN b0 b ON f.lang IS NOT DISTINCT FROM b.lang)"
    )
    levels("b", "g", "one", "turn", top_levels)
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, cur AS folded_root,"
        f" cur = r.node AS verified FROM g{top_levels}, b{top_levels} r"
    )


ORACLE_SQL = oracle_sql()
