"""Versioned tables: files are written first, a manifest that names them last.

A table is cut into slices by a hash of its slice columns. Replacing some rows writes new
files for their slices only; all other slices keep the files they have. Readers follow the
newest manifest, so a job that dies half way leaves nothing they would see, and a reader that
has started keeps a consistent version. Adding rows whose keys are new rewrites nothing.

One writer at a time: a version that another writer has taken meanwhile raises, and its
files are simply not named by any manifest. ``expire`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICES = 64
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
MOST_FILES = 8  # folders of a slice, before the next change writes it anew


class Files:
    """The files below a folder, by the session's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def listing(self) -> list[tuple[str, int, int]]:
        """Name, bytes and time of change of everything directly below, folders by their contents."""
        found = []
        for status in self._fs.listStatus(self._path("")) if self.exists() else []:
            size = self._fs.getContentSummary(status.getPath()).getLength()
            found.append((status.getPath().getName(), size, status.getModificationTime()))
        return sorted(found)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, seen as a whole or not at all."""
        draft = f".draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self._path(name).getParent())
        if self.exists(name) or not self._fs.rename(self._path(draft), self._path(name)):
            self._fs.delete(self._path(draft), False)
            raise FileExistsError(f"{self.root}/{name} was written meanwhile")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Manifests:
    """Numbered descriptions of a folder's contents; the newest one counts."""

    def __init__(self, files: Files, folder: str = "manifests"):
        self.files, self.folder = files, folder

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(self.folder) if n.endswith(".json") and not n.startswith(".")]

    def read(self, version: int | None = None) -> tuple[int, dict | None]:
        """Number and contents of a version, by default the newest; 0 and None where there is none."""
        known = self.versions()
        if not known:
            return 0, None
        version = known[-1] if version is None else version
        return version, json.loads(self.files.read(f"{self.folder}/{version:012d}.json"))

    def add(self, after: int, contents: dict) -> int:
        self.files.create(f"{self.folder}/{after + 1:012d}.json", json.dumps(contents))
        return after + 1


class Snapshots:
    """A table under ``path``, sliced by a hash of ``by``."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], n_slices: int = SLICES):
        self.spark, self.by, self.n_slices = spark, by, n_slices
        self.files = Files(spark, path)
        self.manifests = Manifests(self.files)

    @property
    def version(self) -> int:
        return self.manifests.read()[0]

    def folders(self, version: int | None = None) -> dict[int, list[str]]:
        """The folders of each slice."""
        _, now = self.manifests.read(version)
        return {int(k): v for k, v in now["slices"].items()} if now else {}

    def read(self, version: int | None = None, slices: set[int] | None = None) -> DataFrame | None:
        """The rows of a version (the newest) and of some slices (all); None where nothing was written yet."""
        _, now = self.manifests.read(version)
        if now is None:
            return None
        schema = StructType.fromJson(now["schema"])
        chosen = [f"{self.files.root}/{x}" for k, folders in now["slices"].items() if slices is None or int(k) in slices for x in folders]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*chosen)

    def slice_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.n_slices)).cast("int")

    def slices_of(self, rows: DataFrame) -> set[int]:
        """The slices that rows fall in: at most n_slices numbers."""
        return {r[0] for r in rows.select(self.slice_of()).distinct().collect()}

    def _written(self, rows: DataFrame) -> dict[int, str]:
        """Files of the rows, by slice. Rows of one slice meet, and large slices are split again.

        A task keeps a file open for each of its slices; otherwise Spark sorts (and spills) all rows by slice first.
        """
        folder = f"data/{uuid.uuid4().hex}"
        sliced = rows.withColumn("_slice", self.slice_of()).hint("rebalance", "_slice")
        given = self.spark.conf.get(OPEN_FILES, "0")
        self.spark.conf.set(OPEN_FILES, str(self.n_slices))
        try:
            sliced.write.partitionBy("_slice").parquet(f"{self.files.root}/{folder}")
        finally:
            self.spark.conf.set(OPEN_FILES, given)
        made = [n for n in self.files.names(folder) if n.startswith("_slice=")]
        return {int(n.removeprefix("_slice=")): f"{folder}/{n}" for n in made}

    def _commit(self, rows: DataFrame, gone: set[int] | None) -> int:
        """Rows added to what is there, without the slices that are gone (None: all)."""
        version, now = self.manifests.read()
        if now and gone is not None and rows.schema.names != [f["name"] for f in now["schema"]["fields"]]:
            raise ValueError(f"columns differ from those of version {version}")
        made = self._written(rows)
        old = {} if now is None or gone is None else {int(k): v for k, v in now["slices"].items() if int(k) not in gone}
        slices = {k: old.get(k, []) + ([made[k]] if k in made else []) for k in sorted(old.keys() | made.keys())}
        return self.manifests.add(version, {"schema": json.loads(rows.schema.json()), "slices": slices})

    def write(self, rows: DataFrame) -> int:
        """All rows anew."""
        return self._commit(rows, None)

    def add(self, rows: DataFrame) -> int:
        """Rows with new keys beside those that are there; slices of many folders are written anew with them."""
        full = {k for k, folders in self.folders().items() if len(folders) >= MOST_FILES}
        if full:
            rows = rows.unionByName(self.read(slices=full).select(*rows.columns))
        return self._commit(rows, full)

    def replace(self, rows: DataFrame, keys: DataFrame) -> int:
        """``rows`` instead of all rows with one of the keys; a slice without such keys keeps its files.

        keys: columns of the table, among them the slice columns.
        """
        if self.version == 0:
            return self.write(rows)
        touched = self.slices_of(keys)  # of the keys alone: rows may be costly, and are computed once
        kept = self.read(slices=touched).join(keys.distinct(), keys.columns, "left_anti")
        return self._commit(kept.select(*rows.columns).unionByName(rows), touched)

    def current(self, build: Callable[[], DataFrame]) -> DataFrame:
        """The newest version; the first one is built where there is none."""
        if self.version == 0:
            self.write(build())
        return self.read()

    def expire(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest ``keep``, and all files that those do not name."""
        known = self.manifests.versions()
        needed = {x.split("/_slice=")[0] for v in known[-keep:] for xs in self.folders(v).values() for x in xs}
        gone = [f"{self.manifests.folder}/{v:012d}.json" for v in known[:-keep]]
        gone += [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in needed]
        for name in gone:
            self.files.delete(name)
        return gone
