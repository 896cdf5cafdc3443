"""The three export shapes: one dataset per table, enriched, flat."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.operators.closure import plan_export, reference_bundle, relational_closure
from tradewind.operators.customers import select_customers
from tradewind.operators.orders import select_orders
from tradewind.operators.wide import enriched_orders, flat_orders
from tradewind.plans.entities import ENTITIES, NATIVE_COLUMNS, REFERENCE_TABLES
from tradewind.sinks.commit import Export, ExportLog, Staging, publish, recover, write_all
from tradewind.sinks.csvfiles import CsvOptions, write_csv
from tradewind.sources.scans import after, custom_columns
from tradewind.sources.shop import Shop


def _finished(shop: Shop, staging: Staging, log: ExportLog | None) -> Export | None:
    """The export if it counts already, its datasets in place."""
    if (record := staging.committed(log)) is None:
        return None
    publish(shop.spark, record)
    return Export(record["outputs"], record.get("exported", record["cursors"]), record["columns"])


def _writer(rows: DataFrame, options: CsvOptions) -> Callable[[str], None]:
    return lambda place: write_csv(rows, place, options)


def export_relational(
    shop: Shop,
    path: str,
    export_type: str = "full",
    level: str = "essential",
    specs: Mapping[str, FilterSpec] | None = None,
    *,
    options: CsvOptions = CsvOptions(),
    include_custom_tables: bool = False,
    include_custom_columns: bool = True,
    include_reference: bool = True,
    cursors: Mapping[str, int] | None = None,
    ordered: bool = False,
    scratch: str | None = None,
    log: ExportLog | None = None,
    **selection,
) -> Export:
    """Write one dataset per entity below ``path``.

    ``specs`` holds a filter specification per side, ``customers`` and
    ``orders``.  A specification with ``incremental`` set continues after the
    cursor of its root: the one in ``cursors``, else the one in ``log``, which
    then keeps the new ones.  Roots and other parents, and the ids of dimensions
    in use, are stored once as Parquet, in the staging folder or below
    ``scratch``; their datasets and children read that.  So a table without
    children runs at most twice: for its dataset and for the dimensions it uses.
    ``ordered`` sorts every dataset by its key over all part files.

    No dataset is visible before all are written (see ``commit``).  After a
    failure the same call goes on with the same stored parents and writes what is
    missing; nothing is left behind once it is through.  A path that holds one of
    the datasets already is refused, unless ``log`` has just that export last:
    then that one is returned.
    """
    specs = specs or {}
    plan = plan_export(shop, export_type, level, include_custom_tables)
    request = {
        "shape": "relational", "plan": [e.name for e in plan], "specs": {k: v.to_json() for k, v in specs.items()},
        "options": asdict(options), "custom_columns": include_custom_columns, "reference": include_reference,
        "cursors": cursors, "ordered": ordered, "selection": selection,
    }
    recover(shop.spark, log)
    staging = Staging(shop.spark, path, request, scratch)
    if (done := _finished(shop, staging, log)) is not None:
        return done
    if cursors is None:
        cursors = log.cursors() if log else {}
    roots, keys = {}, {}
    for e in plan:
        if not e.is_root:
            continue
        select = select_customers if e.side == "customers" else select_orders
        spec = specs.get(e.side, FilterSpec())
        rows = select(shop, spec, **selection)
        start = cursors.get(e.name)
        roots[e.name] = after(rows, e.pk, start) if spec.incremental else rows
        keys[e.name] = (e.pk, start or 0, spec.incremental)
    staging.refuse_to_replace({e.name: f"{staging.path}/{e.name}" for e in plan})
    staging.begin(cursors)
    store = staging.store

    tables = relational_closure(shop, plan, roots, store)
    if not include_custom_columns:
        for name, rows in tables.items():
            if name in NATIVE_COLUMNS:
                own = set(custom_columns(rows, name).columns) - {ENTITIES[name].pk}
                tables[name] = rows.drop(*own)
    sort_keys = {e.name: e.pk or e.fk for e in plan}
    if include_reference:
        bundle = reference_bundle(shop, tables, store)
        if clashes := sorted(set(bundle) & set(tables)):
            staging.drop()
            raise ValueError(f"two sources claim one dataset: {', '.join(clashes)}")
        tables.update(bundle)
        sort_keys |= {n: REFERENCE_TABLES[n.removesuffix("_lang")][0] for n in bundle}
    if ordered:
        tables = {name: rows.orderBy(sort_keys[name]) for name, rows in tables.items()}

    outputs = {name: f"{staging.path}/{name}" for name in tables}
    try:
        staging.refuse_to_replace(outputs)
    except FileExistsError:
        staging.drop()
        raise
    write_all(staging, {name: _writer(rows, options) for name, rows in tables.items()}, options.writes_at_once)
    last = {
        name: tables[name].agg(F.coalesce(F.max(key), F.lit(start))).first()[0]
        for name, (key, start, _) in keys.items()
    }
    done = Export(outputs, last, {name: rows.columns for name, rows in tables.items()})
    return staging.commit(done, log, {name: last[name] for name, (*_, goes_on) in keys.items() if goes_on})


def _after_cursor(shop: Shop, spec: FilterSpec | None, cursor: int | None) -> Shop:
    """The shop whose orders start after the cursor, for an incremental export."""
    if spec is None or not spec.incremental:
        return shop
    return shop.replace(orders=after(shop["orders"], "id_order", cursor))


def _write_wide(
    shop: Shop,
    path: str,
    name: str,
    spec: FilterSpec | None,
    options: CsvOptions,
    cursor: int | None,
    log: ExportLog | None,
    ordered: bool,
    selection: Mapping,
    rows_after: Callable[[int | None], DataFrame],
) -> Export:
    """Write one wide dataset; the highest order id is observed on the way."""
    request = {
        "shape": name, "spec": spec.to_json() if spec else None, "options": asdict(options), "cursor": cursor,
        "ordered": ordered, "selection": selection,
    }
    recover(shop.spark, log)
    staging = Staging(shop.spark, path, request)
    if (done := _finished(shop, staging, log)) is not None:
        return done
    if cursor is None and log:
        cursor = log.cursors().get("main")
    outputs = {name: f"{staging.path}/{name}"}
    staging.refuse_to_replace(outputs)
    staging.begin({"main": cursor or 0})
    rows = rows_after(cursor)

    def write(place: str) -> dict:
        seen = Observation()
        write_csv(rows.observe(seen, F.max("id_order").alias("last")), place, options)
        return {"last": seen.get.get("last")}

    last = write_all(staging, {name: write}, 1)[name]["last"]
    done = Export(outputs, {"main": (cursor or 0) if last is None else last}, {name: rows.columns})
    return staging.commit(done, log, done.cursors if spec and spec.incremental else {})


def export_enriched(
    shop: Shop,
    path: str,
    spec: FilterSpec | None = None,
    *,
    options: CsvOptions = CsvOptions(),
    ordered: bool = False,
    cursor: int | None = None,
    log: ExportLog | None = None,
    **selection,
) -> Export:
    """One row per order.  ``ordered`` sorts by order over all part files; ``log`` keeps the cursor ``main``.

    Visible as a whole, and run again after a failure, like a relational export.
    """

    def rows_after(start: int | None) -> DataFrame:
        rows = enriched_orders(_after_cursor(shop, spec, start), spec, **selection)
        return rows.orderBy("id_order") if ordered else rows

    return _write_wide(shop, path, "orders_enriched", spec, options, cursor, log, ordered, selection, rows_after)


def export_flat(
    shop: Shop,
    path: str,
    spec: FilterSpec | None = None,
    *,
    options: CsvOptions = CsvOptions(),
    ordered: bool = False,
    cursor: int | None = None,
    log: ExportLog | None = None,
    **selection,
) -> Export:
    """One row per order line.  ``ordered`` sorts by order, then line; ``log`` keeps the cursor ``main``.

    Visible as a whole, and run again after a failure, like a relational export.
    """

    def rows_after(start: int | None) -> DataFrame:
        rows = flat_orders(_after_cursor(shop, spec, start), spec, with_line_id=ordered, **selection)
        return rows.orderBy("id_order", "id_order_detail").drop("id_order_detail") if ordered else rows

    return _write_wide(shop, path, "export_complet", spec, options, cursor, log, ordered, selection, rows_after)
