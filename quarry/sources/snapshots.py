"""Several tables under one line of versions: numbered manifests, atomic commits, older versions, vacuum.

Data files are never changed: a commit first writes new folders, then one manifest that lists, for every table,
the folders of which it consists. Whoever links a manifest under the next number has committed; a number can be
taken once. A writer that comes second looks at what the first one changed: if that touches a table it has read or
replaced, its change is worked out again on the new version, otherwise its folders are listed after the other's. A
crash at any step leaves the last manifest, and with it whole tables.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.streaming.runs import shared_root


class Conflict(RuntimeError):
    """Other writers were first, as often as was tried."""


@dataclass
class Put:
    """The table's rows from now on."""

    rows: DataFrame
    by: tuple[str, ...] = ()


@dataclass
class Append:
    """Rows that are added to the table's; those of a folder are written already."""

    rows: DataFrame
    by: tuple[str, ...] = ()
    folder: str | None = None


class Drop:
    """The table goes."""


@dataclass
class Snapshot:
    """The tables as of one version; ``touched`` are those that were asked for."""

    spark: SparkSession
    root: str
    version: int
    tables: dict
    touched: set = field(default_factory=set)

    def load(self, name: str) -> DataFrame | None:
        self.touched.add(name)
        entry = self.tables.get(name)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        if not entry["folders"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{name}")
        return rows.parquet(*(f"{self.root}/data/{f}" for f in entry["folders"])).select(*schema.names)  # without the folders' names


def live(now: Snapshot, rows: DataFrame, item: str) -> DataFrame:
    """Rows (``item``, rev, ...) without those that a later change has replaced, by the table ``gone`` (item, before)."""
    gone = now.load("gone")
    if gone is None:
        return rows
    last = gone.groupBy(F.col("item").alias("gone_item")).agg(F.max("before").alias("before"))
    return rows.join(last, F.col(item) == F.col("gone_item"), "left").filter("before IS NULL OR rev >= before").drop("gone_item", "before")


class Catalog:
    """Versions below one folder of a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def fresh(spark: SparkSession, name: str) -> Catalog:
        return Catalog(spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")

    # Files.
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder, and when they were changed."""
        fs, path = self._path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, name: str) -> str:
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        fs, path = self._path(name)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _claim(self, aside: str, name: str) -> bool:
        """Moves a file to a name that nobody has; False if somebody has it."""
        fs, source = self._path(aside)
        target = self._path(name)[1]
        if fs.getUri().getScheme() == "file":  # a rename would replace the other's file there; a link does not
            try:
                os.link(*(urllib.parse.unquote(p.toUri().getPath()) for p in (source, target)))
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(source, False)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)  # none: never over a file
        try:
            hadoop.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            fs.delete(source, False)
            return False

    # Versions.
    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self._names("log") if n.endswith(".json") and n[0] != ".")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The tables as of a version, the last one unless it is given; before the first there are none."""
        have = self.versions()
        at = have[-1] if version is None and have else version or 0
        if at == 0:
            return Snapshot(self.spark, self.root, 0, {})
        if at not in have:
            raise KeyError(f"no version {at}")
        return Snapshot(self.spark, self.root, at, json.loads(self._read(f"log/{at:020d}.json"))["tables"])

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        return self.snapshot(version).load(name)

    def step(self, name: str) -> None:
        """Called between any two steps of a commit; tests stop there."""

    def _stage(self, table: str, rows: DataFrame, by: tuple[str, ...]) -> str:
        folder = f"{table}/segment=s{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/data/{folder}")
        return folder

    def appended(self, table: str, rows: DataFrame) -> Append:
        """Rows written at once, so that a change can read them; they are the table's when the change is committed."""
        folder = self._stage(table, rows, ())
        return Append(self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{folder}"), folder=folder)

    def _delete(self, folders: list[str]) -> None:
        for f in folders:
            fs, path = self._path(f"data/{f}")
            fs.delete(path, True)

    def commit(self, change: Callable[[Snapshot], dict], tries: int = 8) -> Snapshot:
        """``change(snapshot)`` gives Put, Append or Drop by table; all of them hold from the next version on, or none.

        It is called again on a newer version if a table that it loads or replaces has changed meanwhile.
        """
        base, wanted, staged = None, {}, {}
        for _ in range(tries):
            now = self.snapshot()
            moved = base is None or any(now.tables.get(t) != base.tables.get(t) for t in base.touched)
            if moved:
                self._delete([f for f in staged.values() if f])
                base, wanted = now, change(now)
                if not wanted:  # nothing to change
                    return now
                base.touched |= {t for t, c in wanted.items() if not isinstance(c, Append)}
                self.step("changed")
                staged = {}
                for t, c in wanted.items():
                    staged[t] = None if isinstance(c, Drop) else getattr(c, "folder", None) or self._stage(t, c.rows, c.by)
                    self.step(f"staged {t}")
            tables = dict(now.tables)
            for t, c in wanted.items():
                if isinstance(c, Drop):
                    tables.pop(t, None)
                else:
                    before = tables[t]["folders"] if isinstance(c, Append) and t in tables else []
                    tables[t] = {"folders": [*before, staged[t]], "schema": json.loads(c.rows.schema.json())}
            aside = f"log/.{uuid.uuid4().hex}"
            self._write(aside, json.dumps({"version": now.version + 1, "parent": now.version, "at": time.time(), "tables": tables}))
            self.step("written")
            if self._claim(aside, f"log/{now.version + 1:020d}.json"):
                self.step("committed")
                return Snapshot(self.spark, self.root, now.version + 1, tables)
        self._delete([f for f in staged.values() if f])
        raise Conflict(f"{tries} tries")

    def destroy(self) -> None:
        """All versions and all data."""
        fs, path = self._path("")
        fs.delete(path, True)

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> int:
        """Forgets all but the last ``keep`` versions, and deletes folders that none of them lists.

        Folders changed within ``older_than`` seconds stay, since a commit on its way may list them.
        """
        have = self.versions()
        kept = set()
        for v in have[-keep:]:
            kept |= {f for entry in self.snapshot(v).tables.values() for f in entry["folders"]}
        for v in have[:-keep]:
            fs, path = self._path(f"log/{v:020d}.json")
            fs.delete(path, False)
        folders = [(f"{table}/{n}", at) for table, _ in self._names("data") for n, at in self._names(f"data/{table}")]
        old = [n for n, at in folders if n not in kept and at <= (time.time() - older_than) * 1000]
        self._delete(old)
        return len(old)
