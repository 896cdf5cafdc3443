"""Bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows teach a classifier.
MOST_LABELLED = 1 << 16


def text_hash(column: str = "doc_id") -> Column:
    """CRC-32 of a value as text; null counts as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def labelled(labels: DataFrame, column: str, teach: Column, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Ids (ascending) and labels of at most ``most`` rows that ``teach`` admits, picked by a hash.

    Null ids and labels are left out; of a repeated id the largest label counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & teach)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    n = rows.count()
    if n > most:
        share = (most - 6 * most**0.5) / n
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = rows.limit(most).toArrow()
    ids, y = got["id"].to_numpy(), got["y"].to_numpy()
    order = np.argsort(ids)
    return ids[order], y[order]


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each key in ``sorted_keys``, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def id_places(ids, sorted_ids: np.ndarray) -> np.ndarray:
    """The same for a column of ids; a null id is in no table."""
    found = lookup(ids.fill_null(0).to_numpy(zero_copy_only=False), sorted_ids)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, found)
