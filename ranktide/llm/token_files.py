"""Token ids in compact files: frequency-ranked, variable-length, with separate control bytes.

An id is written as its rank by corpus frequency (ties to the smaller id), in
one to four whole bytes. The lengths lie apart from the data: two bits a value,
four values a control byte. So a reader turns control bytes into lengths and
offsets by one table lookup and gathers the data without a branch per value.

The files are Parquet tables of blocks in ascending ``doc_id`` order (nulls
first; ties by the text's hash). A block holds whole documents: their ids and
token counts, ``control`` and ``data``. Beside them lies ``ranks``: the token
id of each rank, at most one row for each entry of the vocabulary. Spark's
writers commit the files, so tasks may be lost and run again.

Defined results: a null text is empty; every document ends with ``end_id``, so
an empty one has one token; repeated rows are documents of their own; an empty
table gives empty files. Memory: a block of about ``BLOCK_TOKENS`` tokens, or
the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.llm import hf
from ranktide.llm.common import documents, partitions, stage_path, staged

BLOCK_TOKENS = 1 << 18

#: Bytes of each of a control byte's four values, and which of 4 * width places its data fill, for each width.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
FILLED = {w: (np.arange(w) < LENGTHS[:, :, None]).reshape(256, 4 * w) for w in (1, 2, 4)}


def _width(most_bytes: int) -> int:
    return next(w for w in FILLED if w >= most_bytes)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    n, top = len(values), int(values.max(initial=0))
    width = _width(max(1, -(-top.bit_length() // 8)))
    codes = np.zeros(-(-n // 4) * 4, np.uint8)  # bytes beyond the first
    for k in (1, 2, 3):
        if top >> 8 * k:
            codes[:n] += values >= 1 << 8 * k
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    filled = FILLED[width][control].reshape(-1)[: n * width]
    return control.tobytes(), values.astype(f"<u{width}").view(np.uint8)[filled].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    codes = np.frombuffer(control, np.uint8)
    width = _width(int(LENGTHS[codes].max(initial=1)))
    out = np.zeros(n * width, np.uint8)
    out[FILLED[width][codes].reshape(-1)[: n * width]] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{width}").astype(np.uint32)


def _blocks(path: str, end_id: int):
    """Arrow batches of (part, doc_id, text), sorted -> blocks of raw ids with their histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = -1, 0
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            total = np.bincount(flat)
            seen = np.flatnonzero(total)
            count = total[seen]
            raw = flat.astype("<u2") if len(flat) == 0 or seen[-1] < 1 << 16 else flat
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "lens": pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                "width": pa.array([raw.itemsize], pa.int32()),
                "ids": pa.array([raw.tobytes()], pa.binary()),
                "seen": pa.array([seen.astype("<u4").tobytes()], pa.binary()),
                "count": pa.array([count.astype("<i8").tobytes()], pa.binary()),
            })

        end = np.array([end_id], np.uint32)
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()  # one range partition a task
            names = b.column("doc_id").to_pylist()
            for name, got in zip(names, hf.encode_texts(path, b.column("text").to_pylist()), strict=True):
                docs.append(name)
                ids.append(np.concatenate([got, end]))
                held += len(got) + 1
                if held >= BLOCK_TOKENS:
                    yield block()
                    docs, ids, held, seq = [], [], 0, seq + 1
        if docs:
            yield block()

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for seen, count in zip(b.column("seen").to_pylist(), b.column("count").to_pylist(), strict=True):
            at = np.frombuffer(seen, "<u4")
            if len(at) and at[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
            total[at] += np.frombuffer(count, "<i8")
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})


def _coded(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[i].as_py(), f"<u{b.column('width')[i].as_py()}")
                control, data = pack(rank[ids])
                yield pa.RecordBatch.from_pydict({
                    "part": b.column("part").slice(i, 1), "seq": b.column("seq").slice(i, 1),
                    "doc_ids": b.column("doc_ids").slice(i, 1), "lens": b.column("lens").slice(i, 1),
                    "n_tokens": pa.array([len(ids)], pa.int64()),
                    "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
                })

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, out: str) -> None:
    """Encode every text with the tokenizers library and write ``out/blocks`` and ``out/ranks``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranged = (
        docs.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    raw = staged(
        ranged.mapInArrow(
            _blocks(tokenizer, end_id),
            "part int, seq int, doc_ids array<bigint>, lens array<bigint>, width int, ids binary, seen binary, count binary",
        ),
        "token-blocks", codec="none",
    )
    counts = (
        raw.select("seen", "count").mapInArrow(_histogram, "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "id")
    )
    by_rank = [r["id"] for r in counts.select("id").collect()]  # at most the vocabulary
    rank = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    raw.select("part", "seq", "doc_ids", "lens", "width", "ids").mapInArrow(
        _coded(rank),
        "part int, seq int, doc_ids array<bigint>, lens array<bigint>, n_tokens long, control binary, data binary",
    ).write.option("compression", "none").parquet(f"{out}/blocks")
    spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids themselves
    (``ids``, little-endian unsigned 32-bit; left out on request)."""
    by_rank = np.zeros(1, "<u4")
    rows = spark.read.parquet(f"{path}/ranks").collect()  # at most the vocabulary
    if rows:
        by_rank = np.zeros(len(rows), "<u4")
        by_rank[[r["rank"] for r in rows]] = [r["id"] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n_tokens")[i].as_py()
                ids = by_rank[unpack(b.column("control")[i].as_py(), b.column("data")[i].as_py(), n)]
                lens = b.column("lens")[i].as_py()
                ends = np.cumsum(lens).tolist()
                cut = [ids[e - k : e].tobytes() for e, k in zip(ends, lens, strict=True)]
                out = {
                    "part": pa.array([b.column("part")[i].as_py()] * len(lens), pa.int32()),
                    "seq": pa.array([b.column("seq")[i].as_py()] * len(lens), pa.int32()),
                    "doc_id": b.column("doc_ids")[i].values,
                    "inside": pa.array([e - k for e, k in zip(ends, lens, strict=True)], pa.int64()),
                    "n_tokens": pa.array(lens, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cut, pa.binary())} if with_ids else {}))

    blocks = spark.read.parquet(f"{path}/blocks")
    schema = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    docs = blocks.mapInArrow(run, schema + (", ids binary" if with_ids else ""))
    sizes = blocks.select("part", "seq", "n_tokens")
    before = lambda w, col: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a range partition
    parts = parts.select("part", before(Window.orderBy("part"), "n").alias("part_start"))
    starts = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq"), "n_tokens").alias("block_start"))
    return (
        docs.join(starts, ["part", "seq"]).join(parts, "part")
        .select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("inside")).alias("start"),
                "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, ended by id 2, through the files and back; the ids' checksum stands for the ids."""
    out = stage_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2, out)
    return read_token_files(spark, out, with_ids=False)
