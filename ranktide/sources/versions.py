"""Tables in versions: data in folders of their own, and a version file that says which of them make the table.

``<path>/data/<id>/...`` is written once and never changed. ``<path>/versions/<n>.json``
maps names (a bucket's number, a model) to such folders and comes into being by one
rename that fails where the file exists. So a reader sees one whole version or the
next; a crash before the rename leaves folders that no version names; and of two
writers that start from the same version one comes first, and the other merges
again, into what the first has published. The folder must be one that all executors
share, in a store whose renames are atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ranktide.session import shuffles_removed


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self._conf)

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/versions")
        if not self._fs().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        """The newest version's (or a given one's) number and what it names; (0, {}) before the first."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return 0, {}
        rows = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).collect()  # one short row
        return number, json.loads(rows[0]["value"])

    def publish(self, number: int, names: dict[str, str]) -> bool:
        """Make ``names`` the version of this number; False if there is one already."""
        fs = self._fs()
        part, to = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/versions/{number:012d}.json")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(names, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf)
        if fs.exists(to):
            fs.delete(part, False)
            return False
        try:
            context.rename(part, to, self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as ex:  # noqa: BLE001 - the JVM's exception, told apart by its name
            if "FileAlreadyExists" not in str(ex):
                raise
            fs.delete(part, False)
            return False
        return True


class BucketedTable:
    """A table of one row a key, in ``buckets`` by the hash of the key; an update writes the buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: list[str], buckets: int = 64):
        self.spark, self.schema, self.key, self.buckets = spark, StructType.fromDDL(ddl), key, buckets
        self.versions = Versions(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, names: dict[str, str], only: list[int] | None = None) -> DataFrame:
        folders = [f"{folder}/_bucket={b}" for b, folder in names.items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of the newest version, or a given one."""
        return self._rows(self.versions.current(number)[1])

    def clustered(self, rows: DataFrame) -> DataFrame:
        """Rows brought together by bucket (``_bucket``): what is grouped by it and the key needs no other exchange to be written."""
        return rows.withColumn("_bucket", self.bucket()).repartition("_bucket")

    def _buckets(self, keys: DataFrame) -> list[int]:
        return [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # one row a bucket

    def update(
        self, touched: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame], tries: int = 20,
        new: DataFrame | None = None,
    ) -> int:
        """Write the buckets of the rows that ``touched(all rows)`` gives (key columns) as ``combine(their rows)`` makes them
        and publish; begun again on a newer version if another writer came first. The new version's number.

        The keys of ``new`` are touched, too; ``touched`` is asked only about the buckets that hold none of them.
        ``combine`` may give ``clustered`` rows."""
        fresh = [] if new is None else self._buckets(new)
        for _ in range(tries):
            number, names = self.versions.current()
            rest = None if new is None else [int(b) for b in names if int(b) not in fresh]
            some = fresh + (self._buckets(touched(self._rows(names, rest))) if rest is None or rest else [])
            if not some:
                return number
            folder = self.versions.new_folder()
            rows = combine(self._rows(names, some))
            if "_bucket" not in rows.columns:
                rows = self.clustered(rows)
            rows.select(*self.schema.names, "_bucket").write.partitionBy("_bucket").parquet(folder)
            left = self._written(folder)
            names = {b: f for b, f in names.items() if int(b) not in some} | dict.fromkeys(left, folder)
            if self.versions.publish(number + 1, names):
                return number + 1
        raise RuntimeError(f"{tries} other writers came first")

    def _written(self, folder: str) -> list[str]:
        """The buckets in a folder; one that lost all its rows has none."""
        found = [f.getPath().getName() for f in self.versions._fs().listStatus(self.versions._hadoop(folder))]
        return [n.removeprefix("_bucket=") for n in found if n.startswith("_bucket=")]


def write_audit_publish(
    versions: Versions, models: dict[str, DataFrame], audit: Callable[[dict[str, DataFrame]], None], tries: int = 20
) -> tuple[int, dict[str, DataFrame]]:
    """Write models to folders of a new version, run ``audit`` on what was written, and publish them together.

    ``audit`` raises to block: the version before stays what readers see. A model
    may read the others as they were written: give it as a function of these. No
    step's shuffle files outlive it, so the disk holds the models and one step's.
    """
    folders, written = {}, {}
    for name, model in models.items():
        folders[name] = f"{versions.new_folder()}/{name}"
        df = model(written) if callable(model) else model
        with shuffles_removed(versions.spark):
            df.write.option("compression", "zstd").parquet(folders[name])
        written[name] = versions.spark.read.schema(df.schema).parquet(folders[name])
    with shuffles_removed(versions.spark):
        audit(written)
    for _ in range(tries):
        number, names = versions.current()
        if versions.publish(number + 1, names | folders):
            return number + 1, written
    raise RuntimeError(f"{tries} other writers came first")


def read_model(versions: Versions, name: str, number: int | None = None) -> DataFrame:
    """A model of the newest version, or a given one."""
    return versions.spark.read.parquet(versions.current(number)[1][name])
