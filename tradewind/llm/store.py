"""Intermediate results that outlive executors, and small summaries of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.workspace import Files

BITMAP_BITS = 23


_SESSIONS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder in that of ``spark.checkpoint.dir``; where that is unset, in the warehouse, which must be shared then.

    It goes when the driver's session ends.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext.applicationId not in _SESSIONS:
        _SESSIONS.add(spark.sparkContext.applicationId)
        Files(spark).remove_at_exit(spark.sparkContext.getCheckpointDir())
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """A checkpoint in partitions of about ``rows`` rows, and its number of rows.

    Small results then do not go through later shuffles in hundreds of tiny pieces.
    """
    out = checkpoint(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // rows))), n


def bitmap(values: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit for each value of a column of 64-bit hashes, ``2**bits`` bits whatever the rows.

    A filter without false negatives: a value that is absent may pass, never the reverse.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    packed = (
        values.select((slot / 64).cast("long").alias("word"), (slot % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.uint64)
    at = packed["word"].to_numpy()
    words[at] = packed["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(words))) + 6
    slot = values >> np.uint64(64 - bits)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def count_floor(counts: DataFrame, column: str, most: int, by: str | None = None) -> dict:
    """The least count so that at most ``most`` rows (of each ``by``) reach it, from a histogram of at most 1,024 bins."""
    bins = F.floor(F.log2(F.col(column)) * 16).alias("bin")
    keys = [F.col(by).alias("k")] if by else [F.lit(0).alias("k")]
    rows = counts.groupBy(*keys, bins).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low")).collect()
    floors: dict = {}
    for k in {r["k"] for r in rows}:
        taken, floor = 0, None
        for r in sorted((r for r in rows if r["k"] == k), key=lambda r: -r["bin"]):
            taken += r["n"]
            if taken > most:
                break
            floor = r["low"]
        floors[k] = floor
    return floors


class Counter:
    """Counts of 64-bit keys in bounded memory; full tables are handed on as partial counts."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, *weights: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(keys):
            self.parts.append(self._merge(keys, weights))
            self.size += len(self.parts[-1][0])
        if self.size > self.most:
            merged = self._all()
            self.parts, self.size = [merged], len(merged[0])
            if self.size > self.most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.parts:
            yield self._all()
        self.parts, self.size = [], 0

    @staticmethod
    def _merge(keys, weights):
        if not weights:
            return np.unique(keys, return_counts=True)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return (keys[first], *(np.add.reduceat(w[order], first) for w in weights))

    def _all(self):
        if len(self.parts) == 1:
            return self.parts[0]
        return self._merge(*(lambda c: (c[0], c[1:]))([np.concatenate(x) for x in zip(*self.parts)]))


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
