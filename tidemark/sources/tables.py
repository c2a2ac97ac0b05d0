"""Tables in a folder that the driver and all executors share, and logs made of whole, committed appends."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder below which tables are kept between jobs: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Without either a temporary folder serves a local session; on a cluster RuntimeError, as executors
    would each write to a disk of their own and what is read back would lack rows.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils

    def place(self) -> str:
        """The folder's whole path, without the file system's name."""
        return self._fs.makeQualified(self._paths(self.path)).toUri().getPath()

    def make(self) -> None:
        self._fs.mkdirs(self._paths(self.path))

    def names(self, below: str = "") -> list[str]:
        """What lies in the folder, or in one below it, but for checksums; nothing if there is no such folder."""
        at = self._paths(f"{self.path}/{below}" if below else self.path)
        if not self._fs.exists(at):
            return []
        if self._fs.getScheme() == "file":  # not a call for each name; a local disk has Hadoop's checksums beside the files
            return sorted(n for n in os.listdir(at.toUri().getPath()) if not (n.startswith(".") and n.endswith(".crc")))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at))

    def remove(self, name: str) -> None:
        self._fs.delete(self._paths(f"{self.path}/{name}" if name else self.path), True)

    def mark(self, name: str) -> bool:
        """Makes an empty file; False if there is one already."""
        at = self._paths(f"{self.path}/{name}")
        self._fs.mkdirs(at.getParent())
        return self._fs.createNewFile(at)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._paths(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        """The whole of a small text file."""
        opened = self._fs.open(self._paths(f"{self.path}/{name}"))
        try:
            return bytes(self._io.toByteArray(opened)).decode()
        finally:
            opened.close()

    def put(self, name: str, text: str) -> bool:
        """Makes a file with a text, whole at once; False if there is one already, whoever was first.

        The text is written beside and then given the name: by a link on a local disk, elsewhere by a rename,
        which the file system must refuse if the name is taken, as HDFS does.
        """
        at = self._paths(f"{self.path}/{name}")
        beside = self._paths(f"{self.path}/_beside/{uuid.uuid4().hex}")
        made = self._fs.create(beside, False)
        try:
            made.write(bytearray(text.encode()))
        finally:
            made.close()
        self._fs.mkdirs(at.getParent())
        if self._fs.getScheme() == "file":
            try:
                os.link(beside.toUri().getPath(), at.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(beside, False)
        if self._fs.exists(at) or not self._fs.rename(beside, at):
            self._fs.delete(beside, False)
            return False
        return True


_passing: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables ``stored`` within are removed at the end; what they were made for must be written by then."""
    made: list[str] = []
    _passing.append(made)
    try:
        yield
    finally:
        _passing.remove(made)
        remove_tables(spark, made)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        Folder(spark, path).remove("")


def passing_path(spark: SparkSession, name: str, into: list[str] | None = None) -> str:
    """A path below ``shared_dir`` for what is not to stay.

    It is removed when the driver's JVM ends, or with the innermost ``passing_tables``, unless ``into`` is
    given: a list that gets it.
    """
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if into is not None:
        into.append(path)
    elif _passing:
        _passing[-1].append(path)
    return path


def stored(df: DataFrame, name: str, into: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to a ``passing_path`` and read back: computed once, lineage cut. ``by`` names
    columns that get folders of their own.
    """
    path = passing_path(df.sparkSession, name, into)
    df.write.partitionBy(*by or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class AppendLog:
    """An append-only table: a folder of appends, each of which counts once its mark stands in ``_done``.

    An append is written under a name of its own, so writers, streams among them, never touch each
    other's rows, readers see whole appends only, and one that is repeated under its name after a failure
    replaces what was not marked and is left out if it was. Parquet files that lie in the folder itself are
    of an older layout and are read along.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.schema, self.folder = spark, schema, Folder(spark, path)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def done(self) -> list[str]:
        return self.folder.names("_done")

    def older(self) -> DataFrame | None:
        """The files of an older layout, with the columns that they have."""
        names = [n for n in self.folder.names() if n.endswith(".parquet") and n.startswith("part-")]
        names += [n for n in self.folder.names() if n.startswith("batch=")]
        if not names:
            return None
        found = None
        for name in names:
            part = self.spark.read.parquet(f"{self.folder.path}/{name}")
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        return found

    def read(self, adopt=None) -> DataFrame:
        """All rows; ``adopt`` brings those of an older layout into the schema."""
        whole = self._empty()
        older = self.older()
        if older is not None:
            whole = whole.unionByName(adopt(older) if adopt else older.select(*whole.columns))
        paths = [f"{self.folder.path}/{name}" for name in self.done()]
        return whole.unionByName(self.spark.read.schema(whole.schema).parquet(*paths)) if paths else whole

    def append(self, rows: DataFrame, name: str | None = None) -> DataFrame | None:
        """Writes and marks one append and returns it as stored; None if an append of that name was marked before."""
        name = name or f"append-{uuid.uuid4().hex}"
        if name in self.done():
            return None
        at = f"{self.folder.path}/{name}"
        rows.select(*self._empty().columns).write.mode("overwrite").parquet(at)
        self.folder.mark(f"_done/{name}")
        return self.spark.read.schema(self._empty().schema).parquet(at)
