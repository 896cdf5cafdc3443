"""Copies of a shop's tables laid out by order, so that joins by order need no shuffle of the lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from tradewind.sources.shop import Shop

#: All rows of one order lie in one bucket, which one task reads; an order with more rows is refused.
MOST_ROWS_OF_A_KEY = 10_000_000


def write_colocated(
    shop: Shop,
    database: str,
    names: Iterable[str],
    buckets: int,
    *,
    key: str = "id_order",
    prefix: str = "",
    path: str | None = None,
    most_rows: int = MOST_ROWS_OF_A_KEY,
) -> Shop:
    """Write tables that hold ``key`` as catalog tables, bucketed and sorted by it, and give the shop that reads them.

    Tables of one ``buckets`` number are joined by ``key`` bucket by bucket: a
    side that comes straight from such a table is not shuffled, and its sort meets
    rows in order.  ``Shop.from_catalog`` reads them too.  Choose
    ``buckets`` so that a bucket of the largest table is a few hundred MB.

    What cannot be split any more is one key: a key with more than ``most_rows``
    rows in a table raises ``ValueError``, and the table is better left as it is,
    where adaptive execution splits the key.  Tables lie below ``path``, by
    default in the database's own folder.
    """
    names = list(names)
    for name in names:
        largest = shop[name].groupBy(key).count().agg(F.max("count")).first()[0] or 0
        if largest > most_rows:
            raise ValueError(f"{name} has {largest} rows of one {key}; bucketed, one task would read them all")
    for name in names:
        rows = shop[name].repartition(buckets, key).sortWithinPartitions(key)
        writer = rows.write.bucketBy(buckets, key).sortBy(key).format("parquet")
        if path:
            writer = writer.option("path", f"{path.rstrip('/')}/{prefix}{name}")
        writer.saveAsTable(f"{database}.{prefix}{name}")
    return shop.replace(**{n: shop.spark.table(f"{database}.{prefix}{n}") for n in names})
