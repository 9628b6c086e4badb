"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ranktide.session import checkpoint_dir, shuffles_removed


_KEPT: dict = {}
_SHIPPED: set[str] = set()


def kept(name: tuple, make):
    """What a Python worker keeps from task to task for one operator; that of any other is let go first."""
    if name not in _KEPT:
        let_go()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Free what another operator kept in this Python worker, and hand its memory back to the system."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most: only these are Python objects at a time."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def ship(spark: SparkSession) -> None:
    """Give this package's modules to the session's Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ranktide-code-"), "ranktide.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)  # Spark's file server brings it to every executor
    _SHIPPED.add(sc.applicationId)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder that the session names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *partition_by: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back.

    Later stages depend on files all executors share, so a lost executor never
    makes an earlier stage run again, and what was shuffled for it goes at once.
    """
    path = stage_path(df.sparkSession, name)
    w = df.write.option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_keys(text: str = "text") -> list:
    """Two independently seeded 64-bit hashes of a text (null as empty): 128 bits that name it."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def schema_of(kept: DataFrame, names: list[str], *more: str) -> StructType:
    """A schema of columns of ``kept``, of whatever names their types hold, and then those said in DDL."""
    return StructType([*(kept.schema[n] for n in names), *(f for ddl in more for f in StructType.fromDDL(ddl).fields)])


def partitions(df: DataFrame) -> int:
    """Shuffle partitions that the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def groups_for(df: DataFrame, column: str, group_bytes: int) -> int:
    """Groups of about ``group_bytes`` of ``column`` each, and no fewer than the session's shuffle partitions."""
    total = df.select(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0
    return max(partitions(df), -(-int(total) // group_bytes))
