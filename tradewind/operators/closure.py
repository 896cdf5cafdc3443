"""Follow keys from selected roots to everything that hangs below them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.keyfilter import ParentKeys, key_filter, passing
from tradewind.operators.membership import children_by_value, children_of, matched
from tradewind.plans.entities import (
    ENTITIES,
    REFERENCE_TABLES,
    Entity,
    dependency_order,
    planned_entities,
    sides,
)
from tradewind.sources.scans import custom_tables
from tradewind.sources.shop import Shop
from tradewind.workspace import checkpointed, unstored


def plan_export(
    shop: Shop, export_type: str = "full", level: str = "essential", include_custom: bool = False
) -> list[Entity]:
    """The entities of an export in dependency order."""
    custom = {}
    if include_custom:
        for side in sides(export_type):
            fk = "id_customer" if side == "customers" else "id_order"
            for name in custom_tables(shop, fk):
                custom.setdefault(name, fk)
    return dependency_order(planned_entities(shop, export_type, level, custom))


def scan_children(
    shop: Shop,
    entity: Entity,
    parents: DataFrame,
    known: ParentKeys | None = None,
) -> DataFrame:
    """Rows of a child table that belong to the given parents.

    ``known`` is what stored parents tell of their keys.  The lowest and highest
    one reach the child's scan, which skips the files and row groups outside
    them; a filter of fixed size over the keys drops most rows of other parents
    where the keys lie scattered.  Both act before anything is shuffled.
    """
    pk = ENTITIES[entity.parent].pk
    rows = shop[entity.name]
    key = entity.parent_key or pk
    if known is not None:
        if entity.parent_key is None:
            rows = rows.where(F.col(entity.fk).between(known.low, known.high))
        if known.filters and key in known.filters:
            rows = passing(rows, entity.fk, known.filters[key])
    if entity.parent_key is not None:
        return children_by_value(rows, parents, entity.fk, entity.parent_key, pk)
    return children_of(rows, parents, entity.fk, pk)


def parent_keys(
    parents: DataFrame, pk: str, referred: Iterable[str], store: Callable[[str, DataFrame], DataFrame], name: str
) -> ParentKeys:
    """Count and range of stored parents, and a stored filter of each column that children refer to."""
    count, low, high = parents.agg(F.count(pk), F.min(pk), F.max(pk)).first()
    known = ParentKeys(count, low, high)
    if not known.scattered:
        return known
    filters = {c: store(f"{name}_{c}_filter", key_filter(parents, c)) for c in sorted(set(referred))}
    return ParentKeys(count, low, high, filters)


def relational_closure(
    shop: Shop,
    plan: Iterable[Entity],
    roots: Mapping[str, DataFrame],
    store: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """One DataFrame per entity: the roots as given, children of kept rows only.

    ``store(name, rows)`` writes the rows of a parent and returns the written
    table, by default a checkpoint that lasts as long as the session.
    ``Scratch.store`` keeps it as Parquet for a ``with`` block, so that children
    read its key alone and joins know its size.  Children read the stored table instead of each running the parent's whole selection again, all
    see the same parents, their scans are cut to the parents' keys, and every
    join has an exchange on both sides, which splitting a very frequent parent
    needs.  With ``store=unstored`` nothing is written, and one query over all
    tables shares the exchange of a parent's keys.
    """
    store = store or (lambda _, rows: checkpointed(rows))
    plan = list(plan)
    referred: dict[str, list[str]] = {}
    for e in plan:
        if not e.is_root:
            referred.setdefault(e.parent, []).append(e.parent_key or ENTITIES[e.parent].pk)
    out: dict[str, DataFrame] = {}
    known: dict[str, ParentKeys] = {}
    for e in plan:
        if e.is_root:
            rows = roots[e.name]
        else:
            rows = scan_children(shop, e, out[e.parent], known.get(e.parent))
        if store is not unstored and (e.is_root or e.name in referred):
            rows = store(e.name, rows)
            if e.name in referred:
                known[e.name] = parent_keys(rows, e.pk, referred[e.name], store, e.name)
        out[e.name] = rows
    return out


def used_dimensions(shop: Shop, tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """Distinct ``(dimension, id)`` pairs that the tables hold, ids as text.

    Every table is read once, whatever the number of its keys, and its pairs are
    reduced before they meet those of other tables: a value shared by a third of
    the rows is one row per task in the shuffle.  ``None`` without any key.
    """
    parts = []
    for n, t in tables.items():
        held = [
            F.struct(F.lit(name).alias("dimension"), F.col(key).cast("string").alias("id"))
            for name, (key, _) in REFERENCE_TABLES.items()
            if name in shop and key in t.columns and n != name
        ]
        if held:
            pairs = t.select(F.inline(F.array(*held)))
            parts.append(pairs.where(F.col("id").isNotNull()).distinct())
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def reference_bundle(
    shop: Shop,
    tables: Mapping[str, DataFrame],
    store: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The dimension rows that the given tables use, with their label tables.

    A dimension is used when some table has its ``id_<dimension>`` column.  The
    used ids are gathered once and written by ``store``, by default as a
    checkpoint for the session; every dimension and label table joins its part of them.  With
    ``store=unstored`` nothing is written, and each dimension reads the distinct
    values of its own columns.
    """
    holders = {
        name: [t for n, t in tables.items() if key in t.columns and n != name]
        for name, (key, _) in REFERENCE_TABLES.items()
        if name in shop
    }
    holders = {name: held for name, held in holders.items() if held}
    if not holders:
        return {}
    used = None
    if store is not unstored:
        used = (store or (lambda _, rows: checkpointed(rows)))("used_dimensions", used_dimensions(shop, tables))
    out: dict[str, DataFrame] = {}
    for name, held in holders.items():
        key, has_labels = REFERENCE_TABLES[name]
        if used is None:
            parts = [t.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct() for t in held]
            own = reduce(DataFrame.unionByName, parts)
        else:
            own = used.where(F.col("dimension") == name)
        for table in (name, *([f"{name}_lang"] if has_labels else [])):
            if table in shop:
                ids = own.select(F.col("id").cast(shop[table].schema[key].dataType).alias(key))
                out[table] = matched(shop[table], ids, key)
    return out
