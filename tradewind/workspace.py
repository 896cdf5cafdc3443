"""Where intermediate tables are written, and for how long."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SESSION_FOLDERS: dict[str, str] = {}


class Files:
    """Small work on files in whatever store holds them, done by the driver."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        store, target = self._at(path)
        return store.exists(target)

    def names(self, path: str) -> list[str]:
        """The names in a folder, sorted; none if there is no such folder."""
        store, target = self._at(path)
        return sorted(f.getPath().getName() for f in store.listStatus(target)) if store.exists(target) else []

    def make_folder(self, path: str) -> None:
        store, target = self._at(path)
        store.mkdirs(target)

    def move(self, source: str, target: str) -> None:
        """Rename in one step, where the store can."""
        store, old = self._at(source)
        _, new = self._at(target)
        store.mkdirs(new.getParent())
        if store.exists(new) or not store.rename(old, new):
            raise FileExistsError(f"cannot move {source} to {target}")

    def remove(self, path: str) -> None:
        store, target = self._at(path)
        store.delete(target, True)

    def remove_at_exit(self, path: str) -> None:
        """Remove an existing folder when the driver's session ends."""
        store, target = self._at(path)
        store.deleteOnExit(target)

    def write_json(self, path: str, value) -> None:
        """Write beside the place and rename, so the file is there whole or not at all."""
        part = f"{path.rpartition('/')[0]}/_{uuid4().hex}"
        store, target = self._at(part)
        out = store.create(target, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            self.move(part, path)
        except FileExistsError:
            self.remove(part)
            raise

    def read_json(self, path: str):
        """The value in a file, or None without one."""
        store, target = self._at(path)
        if not store.exists(target):
            return None
        stream = store.open(target)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one in the warehouse, which then has to be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, in a folder of this session that goes when the session's driver ends."""
    session = f"{spark.sparkContext.applicationId}|{shared_folder(spark)}"
    if session not in _SESSION_FOLDERS:
        folder = f"{shared_folder(spark)}/session-{uuid4().hex}"
        files = Files(spark)
        files.make_folder(folder)
        files.remove_at_exit(folder)
        _SESSION_FOLDERS[session] = folder
    return f"{_SESSION_FOLDERS[session]}/{label}-{uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    Files(spark).remove(path)


class Scratch:
    """Tables stored as Parquet in a folder of their own, which goes at the end of a ``with`` block.

    A stored table keeps its columns apart and its size and ranges known, so what reads it reads only
    the columns it needs, skips row groups, and is joined by measured size.  Without ``folder`` it
    lies in the shared folder.  Whatever reads a stored table has to run inside the block.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self._base = spark, folder
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/tables-{uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        files = Files(self.spark)
        files.remove(self.folder)
        # A folder named for scratch alone goes too, unless something else lies in it.
        if self._base and files.exists(self._base) and not files.names(self._base):
            files.remove(self._base)

    def store(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written once and read from there."""
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read from there, until the driver's session ends."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(spark, "checkpoints"))
    session = f"{context.applicationId}|checkpoints"
    if session not in _SESSION_FOLDERS:
        _SESSION_FOLDERS[session] = context.getCheckpointDir()
        Files(spark).remove_at_exit(context.getCheckpointDir())
    return rows.checkpoint()


def unstored(_: str, rows: DataFrame) -> DataFrame:
    """The store that keeps nothing: whatever reads a table runs it again."""
    return rows
