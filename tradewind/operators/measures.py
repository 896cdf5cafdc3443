"""Counts, volume estimates and progress."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.operators.customers import select_customers
from tradewind.operators.orders import select_orders
from tradewind.plans.entities import Entity, planned_entities, sides
from tradewind.sources.shop import Shop

# Assumed child rows per root row, by words in the table name.
ROWS_PER_ROOT = 2
ROWS_PER_ROOT_BY_WORD = {"history": 5, "detail": 3}


def count_orders(shop: Shop, spec: FilterSpec | None = None, **options) -> DataFrame:
    return select_orders(shop, spec, **options).agg(F.count("*").alias("n"))


def count_customers(shop: Shop, spec: FilterSpec | None = None, **options) -> DataFrame:
    return select_customers(shop, spec, **options).agg(F.count("*").alias("n"))


def count_flat(shop: Shop, spec: FilterSpec | None = None, **options) -> DataFrame:
    """Rows of the flat export, from line counts per order instead of lines."""
    options.setdefault("department_by_prefix", True)
    orders = select_orders(shop, spec, **options).select("id_order")
    lines = shop["order_detail"].groupBy("id_order").agg(F.count("*").alias("_lines"))
    joined = orders.join(lines, "id_order", "left")
    return joined.agg(
        F.coalesce(F.sum(F.coalesce(F.col("_lines"), F.lit(1))), F.lit(0)).alias("n")
    )


def _ratio(table: str) -> int:
    for word, ratio in ROWS_PER_ROOT_BY_WORD.items():
        if word in table:
            return ratio
    return ROWS_PER_ROOT


def _selected_count(shop: Shop, side: str, spec: FilterSpec | None, options: dict) -> DataFrame:
    count = count_customers if side == "customers" else count_orders
    return count(shop, spec, **options)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def estimate_ratio(
    shop: Shop,
    export_type: str = "full",
    level: str = "essential",
    specs: Mapping[str, FilterSpec] | None = None,
    **options,
) -> DataFrame:
    """Estimated rows per entity, from the selected roots and fixed ratios.

    The roots are counted once per side, whatever the number of entities.
    """
    parts = []
    for side in sides(export_type):
        entities = [e for e in planned_entities(shop, export_type, level) if e.side == side]
        total = _selected_count(shop, side, (specs or {}).get(side), options)
        rows = [
            F.struct(
                F.lit(e.name).alias("entity"),
                (F.col("n") * (1 if e.is_root else _ratio(e.name))).alias("rows"),
            )
            for e in entities
        ]
        parts.append(total.select(F.inline(F.array(*rows))))
    return _union(parts)


def estimate_by_table(
    shop: Shop,
    export_type: str = "full",
    level: str = "essential",
    specs: Mapping[str, FilterSpec] | None = None,
    **options,
) -> DataFrame:
    """Rows per entity: selected rows of roots, all rows of the other tables."""

    def rows(e: Entity) -> DataFrame:
        if e.is_root:
            total = _selected_count(shop, e.side, (specs or {}).get(e.side), options)
            return total.select(F.lit(e.name).alias("entity"), F.col("n").alias("rows"))
        return shop[e.name].agg(F.count("*").alias("rows")).select(
            F.lit(e.name).alias("entity"), "rows"
        )

    return _union(rows(e) for e in planned_entities(shop, export_type, level))


def estimate_total(
    shop: Shop,
    export_type: str = "full",
    level: str = "essential",
    specs: Mapping[str, FilterSpec] | None = None,
    **options,
) -> DataFrame:
    """One row: the estimated rows of the whole export, from the rows per entity."""
    rows = estimate_by_table(shop, export_type, level, specs, **options)
    return rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def rows_per_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name and row count of every table."""
    return _union(
        t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows")
        for n, t in tables.items()
    )


def progress_percent(done: Column, total: Column) -> Column:
    """Share done in percent with one decimal, at most 100; 0 without a total."""
    share = F.round(done / F.nullif(total, F.lit(0)) * 100, 1)
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), share))
