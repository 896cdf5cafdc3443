"""Exports that become visible as a whole, can be run again after a failure, and keep their cursors.

An export writes its datasets into a staging folder next to the output, which readers skip because of
its name.  A finished dataset gets a marker; one that fails is removed.  When all are there, one small
file is written: from that moment the export counts.  Then the datasets are renamed into place.  A
call that finds the staging folder of the same export goes on where it stopped: it writes what has no
marker, or, if the export already counts, only finishes the renames.

With an ``ExportLog`` that one small file is a record of the log, and holds the cursors too.  So rows
are exported and cursors moved in the same step, whenever the driver dies.

Renaming is one step per dataset on file systems; an object store copies instead.  One driver at a
time may work on an output folder or a log.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tradewind.workspace import Files


@dataclass(frozen=True)
class Export:
    """Written datasets by entity, their columns, and the last exported id of each root."""

    outputs: dict[str, str]
    cursors: dict[str, int] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)


class ExportLog:
    """The finished exports of a shop in a shared folder, one JSON record each, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._files = spark, folder.rstrip("/"), Files(spark)

    def _names(self) -> list[str]:
        return [n for n in self._files.names(self.folder) if n.startswith("export-")]

    def last(self) -> dict | None:
        """The newest record."""
        names = self._names()
        return self._files.read_json(f"{self.folder}/{names[-1]}") if names else None

    def cursors(self) -> dict[str, int]:
        """The last exported id of each root, over all exports so far."""
        return (self.last() or {}).get("cursors", {})

    def append(self, record: Mapping) -> None:
        """Add a record; its number must still be free."""
        number = (self.last() or {"number": 0})["number"] + 1
        self._files.write_json(f"{self.folder}/export-{number:012d}.json", {**record, "number": number})

    def records(self) -> DataFrame:
        """(number, path, cursors, outputs, columns) of every export; cursors as a map from root to id."""
        schema = (
            "number bigint, path string, cursors map<string,bigint>, outputs map<string,string>, "
            "columns map<string,array<string>>"
        )
        if not self._names():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.folder}/export-*.json")


class Staging:
    """The unfinished part of one export."""

    def __init__(self, spark: SparkSession, path: str, request: Mapping, tables: str | None = None):
        """``request`` is what makes two calls the same export; ``tables`` another folder for stored parents."""
        self.spark, self.path, self._files = spark, path.rstrip("/"), Files(spark)
        key = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.folder = f"{self.path}/_staging-{key}"
        self.tables = f"{(tables or self.folder).rstrip('/')}/tables-{key}"

    def begin(self, start: Mapping[str, int]) -> None:
        """Go on from what an earlier run left, unless that one started from other cursors."""
        place = f"{self.folder}/start.json"
        if (before := self._files.read_json(place)) != dict(start):
            if before is not None:
                self.drop()
            self._files.write_json(place, dict(start))

    def _marker(self, name: str) -> str:
        return f"{self.folder}/done/{name}.json"

    def keep(self, name: str, place: str, write: Callable[[str], dict | None]) -> dict:
        """What ``write`` tells of the dataset it wrote to ``place``, now or in a run before."""
        if (facts := self._files.read_json(self._marker(name))) is not None and self._files.exists(place):
            return facts
        self._files.remove(self._marker(name))
        self._files.remove(place)
        try:
            facts = write(place) or {}
        except BaseException:
            self._files.remove(place)
            raise
        self._files.write_json(self._marker(name), facts)
        return facts

    def dataset(self, name: str, write: Callable[[str], dict | None]) -> dict:
        return self.keep(name, f"{self.folder}/data/{name}", write)

    def store(self, name: str, rows: DataFrame) -> DataFrame:
        """A stored parent.  The next call of a failed export reads the same rows, so all its tables agree."""
        place = f"{self.tables}/{name}"
        self.keep(f"table-{name}", place, lambda p: rows.write.parquet(p))
        return self.spark.read.parquet(place)

    def drop(self) -> None:
        """Remove all that is staged, for a call that can never succeed as it is."""
        self._files.remove(self.tables)
        self._files.remove(self.folder)

    def refuse_to_replace(self, outputs: Mapping[str, str]) -> None:
        if there := sorted(n for n, p in outputs.items() if self._files.exists(p)):
            raise FileExistsError(f"already exported to {self.path}: {', '.join(there)}")

    def committed(self, log: ExportLog | None) -> dict | None:
        """The record of this export if it counts already."""
        if log is None:
            return self._files.read_json(f"{self.folder}/commit.json")
        last = log.last()
        return last if last and last["staging"] == self.folder else None

    def commit(self, done: Export, log: ExportLog | None, kept_cursors: Mapping[str, int]) -> Export:
        record = {"path": self.path, "staging": self.folder, "tables": self.tables, "outputs": done.outputs, "columns": done.columns}
        if log is None:
            self._files.write_json(f"{self.folder}/commit.json", {**record, "cursors": done.cursors})
        else:
            log.append({**record, "cursors": {**log.cursors(), **kept_cursors}, "exported": done.cursors})
        publish(self.spark, record)
        return done


def publish(spark: SparkSession, record: Mapping) -> None:
    """Rename the datasets of an export that counts into place, those that are not there yet."""
    files = Files(spark)
    for name, place in record["outputs"].items():
        if files.exists(staged := f"{record['staging']}/data/{name}"):
            files.move(staged, place)
    files.remove(record["tables"])
    files.remove(record["staging"])


def recover(spark: SparkSession, log: ExportLog | None) -> None:
    """Finish the last export of a log if its driver died behind the commit."""
    last = log.last() if log else None
    if last and Files(spark).exists(last["staging"]):
        publish(spark, last)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what failed exports left in an output folder; they start anew then."""
    files = Files(spark)
    for name in files.names(path):
        if name.startswith("_staging-") and not files.exists(f"{path}/{name}/commit.json"):
            files.remove(f"{path}/{name}")


def write_all(staging: Staging, datasets: Mapping[str, Callable[[str], dict | None]], at_once: int) -> dict[str, dict]:
    """Independent writes, some at a time.  All are tried, so a failed one costs only itself; then the first error is raised."""
    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(staging.dataset, name, write) for name, write in datasets.items()}
    return {name: r.result() for name, r in running.items()}
