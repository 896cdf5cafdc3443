"""Key-ordered pages, incremental reads and columns or tables of a shop's own."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.cells import free_name
from tradewind.plans.entities import ENTITIES, NATIVE_COLUMNS, REFERENCE_TABLES
from tradewind.sources.shop import Shop

#: Parts of a key's range, parts of a large one, and its size: more than one row in so many.
PAGE_PARTS = 4096
PAGE_SUBPARTS = 64
PAGE_LARGE = 1024


def after(rows: DataFrame, key: str, cursor: int | None) -> DataFrame:
    """Rows beyond the cursor; 0 or ``None`` starts from the beginning."""
    return rows.where(F.col(key) > cursor) if cursor else rows


def scan_root(shop: Shop, table: str, cursor: int | None = None) -> DataFrame:
    """Any root table from a cursor on."""
    return after(shop[table], ENTITIES[table].pk, cursor)


def keyset_page(rows: DataFrame, key: str, cursor: int | None, limit: int) -> DataFrame:
    """The next ``limit`` rows by key: a distributed top-k, not a full sort."""
    return after(rows, key, cursor).orderBy(key).limit(limit)


def keyset_pages(rows: DataFrame, key: str, limit: int, cursor: int | None = None) -> DataFrame:
    """All pages at once: the rows with their ``page``, from 1; page n is what the n-th ``keyset_page`` gives.

    ``key`` is a whole number, unique and not null.  Its range is cut into equal
    parts, and a part with far more than its share of the rows once more, between
    its own lowest and highest key.  The parts' counts, a bounded number, are summed
    up by the driver; a row's place is what lies before its part and its place
    within the part.  So pages cost two passes over the key, three where keys are
    uneven, and one over the rows, whatever their number; no part holds much more
    than a thousandth of the rows unless the keys within it are uneven again.
    """
    rows = after(rows, key, cursor)
    spark = rows.sparkSession
    name = free_name("_part", rows.columns)
    n, low, high = rows.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return rows.withColumn("page", F.lit(None).cast("long"))

    def cut(low: int, high: int, parts: int) -> int:
        return -(-(high - low + 1) // parts)

    width = cut(low, high, PAGE_PARTS)
    first = F.expr(f"CAST((CAST(`{key}` AS DECIMAL(20,0)) - {low}) div {width} AS INT)")
    counts = rows.groupBy(first.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    large = {r.part: (r.low, cut(r.low, r.high, PAGE_SUBPARTS)) for r in counts if r.n * PAGE_LARGE > n and r.high > r.low}
    schema = "part int, low decimal(20,0), width decimal(20,0)"
    cuts = spark.createDataFrame([(p, Decimal(lo), Decimal(w)) for p, (lo, w) in large.items()], schema)
    placed = rows.withColumn(name, first)
    second = F.lit(0)
    if large:
        # At most PAGE_LARGE rows.
        cuts = F.broadcast(cuts.select(F.col("part").alias(name), F.struct("low", "width").alias(f"{name}_cut")))
        placed = placed.join(cuts, name, "left")
        second = F.coalesce(F.expr(f"CAST((CAST(`{key}` AS DECIMAL(20,0)) - `{name}_cut`.low) div `{name}_cut`.width AS INT)"), F.lit(0))
    placed = placed.withColumn(f"{name}_sub", second)
    if large:
        inner = placed.where(F.col(f"{name}_cut").isNotNull()).groupBy(F.col(name).alias("part"), F.col(f"{name}_sub").alias("sub")).count().collect()
    else:
        inner = []
    sizes = {(r.part, 0): r.n for r in counts if r.part not in large} | {(r.part, r.sub): r["count"] for r in inner}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((*part, before))
        before += sizes[part]
    # At most PAGE_PARTS + PAGE_LARGE * PAGE_SUBPARTS rows.
    offsets = F.broadcast(spark.createDataFrame(offsets, f"`{name}` int, `{name}_sub` int, `{name}_before` long"))
    within = Window.partitionBy(name, f"{name}_sub").orderBy(key)
    place = F.row_number().over(within) + F.col(f"{name}_before") - 1
    paged = placed.join(offsets, [name, f"{name}_sub"]).withColumn("page", F.floor(place / limit).cast("long") + 1)
    return paged.select(*[f"`{c}`" for c in rows.columns], "page")


def incremental_since(
    rows: DataFrame, key: str, watermark: int | None
) -> tuple[DataFrame, DataFrame]:
    """Rows newer than the watermark, and one row with the next ``watermark``.

    The watermark stays where it was when nothing is new.
    """
    fresh = after(rows, key, watermark)
    latest = F.coalesce(F.max(key), F.lit(watermark or 0)).alias("watermark")
    return fresh, fresh.agg(latest)


def custom_columns(
    rows: DataFrame, table: str, native: Sequence[str] | None = None, key: str | None = None
) -> DataFrame:
    """The key and the columns a shop added to a known table.

    All columns of a table without a native list count as added.
    """
    native = NATIVE_COLUMNS.get(table, ()) if native is None else native
    key = key or (ENTITIES[table].pk if table in ENTITIES else None)
    own = [c for c in rows.columns if c not in native and c != key]
    return rows.select(*([key] if key in rows.columns else []), *own)


def custom_tables(shop: Shop, fk: str) -> list[str]:
    """Tables that carry the foreign key and are neither in the known tree nor dimensions."""
    known = {*ENTITIES, *REFERENCE_TABLES, *(f"{name}_lang" for name in REFERENCE_TABLES)}
    return sorted(t for t in shop if t not in known and fk in shop[t].columns)
