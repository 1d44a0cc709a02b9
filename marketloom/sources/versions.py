"""S9, S11, S12. Published versions of all tables, of which readers see one or the other and never a part.

A version's tables and its manifest are written to a folder of their own. The commit is one small file,
``versions/<number>``, which names that folder and is made only if it is not there: of two publishers that started from
the same version one makes it, and the other meets a ``Conflict`` and starts again from what is there now. Versions stay,
so that older ones can be read, and a table that a version has from the one before lies in that one's folder only: the manifest
names the folder of each table. A commit file without its last line (of a publisher that died) counts for nothing.

``FileSystem.create`` without overwriting has to be atomic, as it is on HDFS.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "done"
#: Seconds after which a commit file that is not complete is taken for that of a dead publisher.
GRACE = 60


#: A table, or what makes it from the tables written before it.
Table = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


class Conflict(RuntimeError):
    """Another publisher has made a version since."""


class EmptySnapshot(ValueError):
    """A table that has to hold rows has none."""


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that setting gets one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="marketloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to a new folder and read again, so that what uses it several times works it out once."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Warehouse:
    """Versions of tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, str]:
        """All commit files by number: the folder's name, or an empty text where it is not complete."""
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return {}
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()]
        if not numbers:
            return {}
        rows = self.spark.read.text(f"{self.root}/versions/*", wholetext=True).select(F.col("_metadata.file_name").alias("n"), "value").collect()
        folders = {int(r["n"]): r["value"].split("\n") for r in rows}
        return {n: folders[n][0] if folders.get(n, [])[1:2] == [DONE] else "" for n in numbers}

    def _next(self, based_on: int) -> int:
        commits = self._commits()
        latest = max((n for n, folder in commits.items() if folder), default=0)
        if latest != based_on:
            raise Conflict(f"version {latest} has come after {based_on}")
        for n in commits:
            if n > latest and time.time() - self._fs.getFileStatus(self._path(f"{self.root}/versions/{n:012d}")).getModificationTime() / 1000 < GRACE:
                raise Conflict(f"version {n} is being made")
        return 1 + max(commits, default=0)

    def latest(self) -> int:
        """The number of the latest version; 0 if there is none."""
        return max((n for n, folder in self._commits().items() if folder), default=0)

    def _folder(self, version: int | None) -> str:
        whole = {n: folder for n, folder in self._commits().items() if folder}
        number = max(whole, default=0) if version is None else version
        if number not in whole:
            raise ValueError(f"no version {number} in {self.root}")
        return f"{self.root}/data/{whole[number]}"

    def manifest(self, version: int | None = None) -> DataFrame:
        """``dataset, row_count, snapshot_versions, folder, version, published_at`` of a version, the latest if none is given."""
        return self.spark.read.parquet(f"{self._folder(version)}/manifest")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the latest if none is given; unknown names raise."""
        path = f"{self._folder(version)}/tables/{name}"
        if not self._fs.exists(self._path(path)):
            manifest = self.manifest(version)
            found = manifest.filter(F.col("dataset") == name).select("folder").first() if "folder" in manifest.columns else None
            if found is None:
                raise ValueError(f"unknown table: {name}")
            path = f"{self.root}/data/{found['folder']}/tables/{name}"
        return self.spark.read.parquet(path)

    def publish(self, tables: dict[str, Table], based_on: int, filled: Sequence[str] = (), version_col: str = "snapshot_version", same: Sequence[str] = ()) -> int:
        """Write all tables and commit them as the version after ``based_on``; its number.

        ``Conflict`` if there is a later version by then, ``EmptySnapshot`` if a table named in ``filled`` has no rows; the
        latest version stays as it is in both cases. Tables may be made from those of earlier versions, or by a function of those
        that come before in ``tables``, as they were written. Tables named in ``same`` are those of ``based_on``, not written
        again.
        """
        folder = uuid.uuid4().hex
        number = self._next(based_on)
        manifest = self._taken(same, based_on, filled).withColumns({"version": F.lit(number), "published_at": F.current_timestamp()}) if same else None
        done: dict[str, DataFrame] = {}
        for name, made in tables.items():
            df = made(done) if callable(made) else made
            path = f"{self.root}/data/{folder}/tables/{name}"
            df.write.option("compression", "zstd").parquet(path)
            done[name] = written = self.spark.read.schema(df.schema).parquet(path)
            if name in filled and written.isEmpty():
                self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
                raise EmptySnapshot(f"{name} has no rows")
            versions = F.array_sort(F.collect_set(version_col)) if version_col in df.columns else F.array().cast("array<string>")
            row = written.agg(F.count("*").alias("row_count"), versions.alias("snapshot_versions"))
            row = row.select(F.lit(name).alias("dataset"), "row_count", "snapshot_versions", F.lit(folder).alias("folder"), F.lit(number).alias("version"), F.current_timestamp().alias("published_at"))
            manifest = row if manifest is None else manifest.unionByName(row)
        manifest.coalesce(1).write.parquet(f"{self.root}/data/{folder}/manifest")
        self._claim(number, folder)
        return number

    def _taken(self, names: Sequence[str], version: int, filled: Sequence[str]) -> DataFrame:
        """The rows of a version's manifest for the tables ``names``, which have to be there."""
        rows = self.manifest(version).filter(F.col("dataset").isin(list(names)))
        if "folder" not in rows.columns:
            rows = rows.withColumn("folder", F.lit(self._folder(version).rsplit("/", 1)[1]))
        counts = {r["dataset"]: r["row_count"] for r in rows.collect()}
        for name in names:
            if name not in counts:
                raise ValueError(f"unknown table: {name}")
            if name in filled and not counts[name]:
                raise EmptySnapshot(f"{name} has no rows")
        return rows

    def _claim(self, number: int, folder: str) -> None:
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._path(f"{self.root}/versions/{number:012d}"), False)
        except Py4JJavaError as e:
            if "Exist" not in e.java_exception.getClass().getSimpleName():
                raise
            self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
            raise Conflict(f"version {number} has been made meanwhile") from None
        out.write(f"{folder}\n{DONE}\n".encode())
        out.close()

    def update(self, make: Callable[[int], dict[str, Table]], attempts: int = 5, **options) -> int:
        """Publish what ``make(latest version)`` gives; after a conflict again, from what is the latest then."""
        for left in reversed(range(attempts)):
            based_on = self.latest()
            try:
                return self.publish(make(based_on), based_on, **options)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be positive")
