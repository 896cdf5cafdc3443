"""Every operator as a named query over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.functions import cells, masking
from tradewind.functions.geography import department_of
from tradewind.operators import closure, integrity, listing, measures, wide
from tradewind.operators.customers import select_customers
from tradewind.operators.geo import customers_by_address, matching_addresses
from tradewind.operators.membership import ChildTest, where_children
from tradewind.operators.orders import select_orders
from tradewind.operators.value import add_customer_value
from tradewind.plans.entities import ENTITIES
from tradewind.sinks.commit import ExportLog
from tradewind.sinks.csvfiles import CsvOptions, project_columns, read_csv, write_csv
from tradewind.sinks.exports import export_enriched, export_flat, export_relational
from tradewind.sinks.manifest import file_facts, file_manifest
from tradewind.sources import scans
from tradewind.sources.colocated import write_colocated
from tradewind.sources.shop import Shop
from tradewind.sources.standin import SampleShop, sample_table
from tradewind.streaming.resumable import resume_export
from tradewind.workspace import scratch_dir, unstored

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2001-08-01 00:00:00"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"

ORDER_COLUMNS = ["id_order", "id_customer", "current_state", "total_paid_tax_incl"]
CUSTOMER_COLUMNS = ["id_customer", "id_default_group", "email", "active"]

# Filters on orders, each as the arguments of one specification.
ORDER_FILTERS: dict[str, dict] = {
    "f_shop": {"id_shop": 2},
    "f_shop_multi": {"id_shop_multi": [1, 3]},
    "f_date_add": {"date_add_from": "1997-03-01", "date_add_to": "1998-02-28"},
    "f_date_add_open": {"date_add_from": "1999-03-01", "date_add_to": "9999-12-31"},
    "f_date_upd": {"date_upd_from": "1999-01-01", "date_upd_to": "1999-06-30"},
    "f_id_range": {"id_min": 100, "id_max": 900},
    "f_currency": {"id_currency": 3},
    "f_lang": {"id_lang": 2},
    "f_amounts": {
        "total_paid_tax_incl_min": 50000.5,
        "total_paid_tax_incl_max": 400000.0,
        "total_paid_tax_excl_min": 45000.0,
        "total_paid_tax_excl_max": 300000.0,
        "total_products_min": 40000.0,
        "total_products_max": 280000.0,
        "total_shipping_min": 1.0,
        "total_shipping_max": 3.0,
        "total_discounts_min": 5.0,
        "total_discounts_max": 45.0,
    },
    "f_amount_zero_bound": {"total_paid_tax_incl_min": 0.0, "total_paid_tax_incl_max": 90000.0},
    "f_current_state": {"current_state": ["F", "P"]},
    "f_has_had_state": {"has_had_state": ["purchase", "signup"]},
    "f_never_had_state": {"never_had_state": ["error", "view"]},
    "f_state_history": {"has_had_state": ["purchase"], "never_had_state": ["error"]},
    "f_late": {"order_late_days": 300, "order_late_exclude_states": ["F"]},
    "f_payment": {"payment": "2-HIGH"},
    "f_payment_contains": {"payment_contains": "GE"},
    "f_module": {"module": "urgent"},
    "f_has_payment": {"has_payment": True},
    "f_has_no_payment": {"has_payment": False},
    "f_carrier": {"id_carrier": [2, 5]},
    "f_free_shipping": {"free_shipping": True},
    "f_paid_shipping": {"free_shipping": False},
    "f_has_tracking": {"has_tracking": True},
    "f_has_no_tracking": {"has_tracking": False},
    "f_has_invoice": {"has_invoice": True},
    "f_has_no_invoice": {"has_invoice": False},
    "f_has_slip": {"has_slip": True},
    "f_has_no_slip": {"has_slip": False},
    "f_has_return": {"has_return": True},
    "f_has_no_return": {"has_return": False},
    "f_different_addresses": {"different_addresses": True},
    "f_has_product": {"has_product": [3, 17, 42, 101, 150]},
    "f_has_product_attribute": {"has_product_attribute": [7]},
    "f_product_reference": {"product_reference": "P17-A"},
    "f_product_reference_contains": {"product_reference_contains": "99-R"},
    "f_product_ean": {"product_ean": "0000000000042"},
    "f_product_discount": {"has_product_discount": True},
    "f_products_together": {"has_product_attribute": [7], "product_reference_contains": "9-A"},
    "f_manufacturer": {"id_manufacturer": ["Brand#3", "Brand#8"]},
    "f_category": {"id_category": ["SMALL"]},
    "f_has_coupon": {"has_coupon": True},
    "f_has_no_coupon": {"has_coupon": False},
    "f_coupon_code": {"coupon_code": "Brand#11"},
    "f_coupon_code_contains": {"coupon_code_contains": "#2"},
    "f_coupon_discount_min": {"coupon_discount_min": 6500.0},
    "f_coupon_discount_max": {"coupon_discount_max": 900.0},
    "f_coupon_count_min": {"coupon_count_min": 3},
    "f_coupons_together": {"coupon_code_contains": "#1", "coupon_count_min": 2},
    "geo_delivery": {"address_type": "delivery", "id_country": [3, 7]},
    "geo_invoice": {"address_type": "invoice", "id_country": [3, 7]},
    "geo_both": {"address_type": "both", "id_country": [3, 7, 12, 15], "postcode_prefix": "05"},
    "geo_country": {"id_country": [1, 20]},
    "geo_country_iso": {"country_iso": ["4", "11"]},
    "geo_state": {"id_state": [5]},
    "geo_state_iso": {"state_iso": ["S6", "S9"]},
    "geo_zone": {"id_zone": [2]},
    "geo_postcode": {"postcode": "00670"},
    "geo_postcode_prefix": {"postcode_prefix": "08"},
    "geo_postcode_range": {"postcode_range_from": "02000", "postcode_range_to": "06999"},
    "geo_department": {"dept_code": ["03", "05", "973"]},
    "geo_region": {"region_code": ["OCC", "REU"]},
    "geo_department_region": {"dept_code": ["01", "02", "03"], "region_code": ["ARA"]},
}

CUSTOMER_FILTERS: dict[str, dict] = {
    "c_base": {
        "id_shop": 1,
        "date_add_from": "1995-01-10",
        "date_add_to": "1998-12-31",
        "id_min": 5,
        "id_max": 1200,
    },
    "c_active": {"customer_active": False},
    "c_newsletter": {"newsletter": True},
    "c_optin": {"optin": False},
    "c_default_group": {"id_default_group": ["BUILDING", "MACHINERY"]},
    "c_lang": {"customer_id_lang": 2},
    "c_email": {"customer_email": "c33@household.example"},
    "c_email_contains": {"customer_email_contains": "@f"},
    "c_in_group": {"in_group": ["1-URGENT", "5-LOW"]},
    "c_has_company": {"has_company": True},
    "c_has_siret": {"has_siret": True},
    "c_has_phone": {"has_phone": True},
    "c_has_no_phone": {"has_phone": False},
    "c_has_postcode": {"has_postcode": True, "newsletter": True},
    "c_has_vat_number": {"has_vat_number": True},
    "c_complete_address": {"has_complete_address": True},
    "c_incomplete_address": {"has_complete_address": False},
    "c_reachable": {"has_phone": True, "has_vat_number": False},
}


def _shop(spark: SparkSession, sf_dir: str) -> SampleShop:
    return SampleShop(spark, sf_dir)


def _orders(**filters) -> Query:
    spec = FilterSpec(**filters)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select_orders(_shop(spark, sf_dir), spec, as_of=AS_OF).select(ORDER_COLUMNS)

    return run


def _customers(**filters) -> Query:
    spec = FilterSpec(**filters)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select_customers(_shop(spark, sf_dir), spec).select(CUSTOMER_COLUMNS)

    return run


def _over(build: Callable[[SampleShop], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_shop(spark, sf_dir))


PERIOD = FilterSpec(date_add_from="1997-01-01", date_add_to="1998-12-31")
WIDE = FilterSpec(
    date_add_from="1997-01-01", date_add_to="1999-12-31", current_state=["F", "P"]
)
FILTERED = FilterSpec(date_add_from="1998-01-01", has_product_discount=True, has_return=True)
ACTIVE = FilterSpec(customer_active=True, has_company=True)


def _tagged(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """``entity, id`` over several tables."""
    parts = [
        tables[name].select(F.lit(name).alias("entity"), F.col(key).cast("long").alias("id"))
        for name, key in keys.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _rows_as_text(tables: dict[str, DataFrame]) -> DataFrame:
    """``entity, row`` over several tables: all columns of a row, joined."""
    parts = []
    for name, rows in tables.items():
        cells_ = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
        parts.append(rows.select(F.lit(name).alias("entity"), F.concat_ws("|", *cells_).alias("row")))
    return reduce(DataFrame.unionByName, parts)


def _as_exported(tables: dict[str, DataFrame]) -> DataFrame:
    return _rows_as_text({name: cells.csv_safe_cells(rows) for name, rows in tables.items()})


def _closure(shop: Shop) -> DataFrame:
    """All columns of all tables below the orders of two years."""
    plan = closure.plan_export(shop, "orders", "ultra")
    roots = {"orders": select_orders(shop, PERIOD)}
    return _as_exported(closure.relational_closure(shop, plan, roots, unstored))


def _closure_by_customer(shop: Shop) -> DataFrame:
    """All columns of all tables below the active customers."""
    plan = closure.plan_export(shop, "customers", "ultra")
    roots = {"customer": select_customers(shop, ACTIVE)}
    return _as_exported(closure.relational_closure(shop, plan, roots, unstored))


def _reference_bundle(shop: Shop) -> DataFrame:
    """The dimensions that orders, addresses and the orders' coupons use."""
    plan = closure.plan_export(shop, "full", "complete")
    roots = {"orders": select_orders(shop, PERIOD), "customer": select_customers(shop, ACTIVE)}
    tables = closure.relational_closure(shop, plan, roots, unstored)
    used = ("orders", "address", "order_cart_rule", "customer_group", "order_history")
    return _as_exported(closure.reference_bundle(shop, {n: tables[n] for n in used}, unstored))


def _custom_table_closure(shop: Shop) -> DataFrame:
    plan = closure.plan_export(shop, "customers", "essential", include_custom=True)
    tables = closure.relational_closure(shop, plan, {"customer": select_customers(shop, ACTIVE)}, unstored)
    custom = [e.name for e in plan if e.custom]
    return _tagged(tables, {n: tables[n].columns[0] for n in ["customer", "address", *custom]})


def _prospects(shop: Shop) -> DataFrame:
    """All orders, dealt to every third customer."""
    dealt = shop["orders"].withColumn("id_customer", F.expr("id_customer - id_customer % 3"))
    spec = FilterSpec(is_prospect=True)
    return select_customers(shop.replace(orders=dealt), spec).select(CUSTOMER_COLUMNS)


def _last_visit(shop: Shop) -> DataFrame:
    spec = FilterSpec(last_visit_days_ago=3)
    return select_customers(shop, spec, as_of="2024-01-31 00:00:00").select(CUSTOMER_COLUMNS)


def _geo_customer(shop: Shop) -> DataFrame:
    spec = FilterSpec(id_country=[2, 4, 9, 15, 18], postcode_prefix="05")
    return customers_by_address(shop["customer"], shop, spec).select(CUSTOMER_COLUMNS)


def _value_output(rows: DataFrame, *measures_: str) -> DataFrame:
    output = {
        "order_count": F.col("order_count").cast("long"),
        "ltv": F.col("ltv").cast("double"),
        "avg_basket": F.round("avg_basket", 2).cast("double"),
    }
    return rows.select("id_customer", *[output[m].alias(m) for m in measures_])


def _customer_value(shop: Shop) -> DataFrame:
    rows = add_customer_value(shop["customer"], shop)
    return _value_output(rows, "order_count", "ltv", "avg_basket")


def _value_filter(*measures_: str, **filters) -> Query:
    spec = FilterSpec(**filters)
    return _over(lambda shop: _value_output(select_customers(shop, spec), *measures_))


def _department_of(shop: Shop) -> DataFrame:
    postcode = F.col("postcode")
    return shop["address"].select(
        "id_address",
        department_of(postcode).alias("department"),
        department_of(postcode, corsica=True).alias("department_corsica"),
    )


def _geo_corsica(shop: Shop) -> DataFrame:
    spec = FilterSpec(region_code=["COR"])
    return select_orders(shop, spec, corsica=True).select(ORDER_COLUMNS)


def _with_france(shop: Shop) -> Shop:
    """The shop with nations below 6 as country "FR"."""
    iso = F.when(F.col("id_country") < 6, F.lit("FR")).otherwise(F.col("iso_code"))
    return shop.replace(country=shop["country"].withColumn("iso_code", iso))


def _geo_guarded(shop: Shop) -> DataFrame:
    """Departments count only in country "FR"."""
    guarded = _with_france(shop)
    spec = FilterSpec(region_code=["OCC", "ARA", "IDF", "NAQ"])
    return matching_addresses(guarded, spec, country_guard=True).select("id_address", "postcode")


def _ignore_case(shop: Shop) -> DataFrame:
    spec = FilterSpec(payment_contains="uRgEnT", product_reference_contains="p1")
    return select_orders(shop, spec, ignore_case=True).select(ORDER_COLUMNS)


def _late_default(shop: Shop) -> DataFrame:
    """Numeric states and the default finished state."""
    state = F.when(F.col("current_state") == "F", 5).when(F.col("current_state") == "O", 2)
    numeric = shop.replace(orders=shop["orders"].withColumn("current_state", state))
    spec = FilterSpec(order_late_days=1000)
    return select_orders(numeric, spec, as_of=AS_OF).select(ORDER_COLUMNS)


def _job_progress(shop: SampleShop) -> DataFrame:
    lines = sample_table(shop.spark, shop.sample_dir, "lineitem")
    done = lines.groupBy(F.col("l_orderkey").alias("id_export_job")).agg(
        F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done")
    )
    percent = measures.progress_percent(F.col("done"), F.col("total"))
    return done.select("id_export_job", percent.alias("percent"))


def _retention(shop: Shop) -> DataFrame:
    jobs = shop["export_job"]
    parts = integrity.retention_split(
        jobs, shop["export_file"], key="id_export_job", time="date_add", as_of=AS_OF, days=900
    )
    keys = {"kept": "id_export_job", "expired": "id_export_job"}
    keys |= {"kept_children": "id_export_file", "expired_children": "id_export_file"}
    return _tagged(parts._asdict(), keys)


def _recent_parents(shop: Shop) -> DataFrame:
    return select_orders(shop, FilterSpec(date_add_from="1998-01-01"))


LINE_COLUMNS = ["id_order", "id_order_detail", "product_id"]


def _mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address in the texts; for odd documents with a second ``@``."""
    documents = sample_table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    found = documents.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), 0)).alias("email")
    )
    odd = F.when(F.col("doc_id") % 2 == 1, F.concat("email", F.lit("@b"))).otherwise(F.col("email"))
    return found.select("doc_id", masking.mask_email(odd).alias("masked"))


def _mask_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), 0)).alias("phone")
    )
    short = F.when(F.col("doc_id") % 5 == 0, F.substring("phone", 1, 4)).otherwise(F.col("phone"))
    return found.select("doc_id", masking.mask_phone(short).alias("masked"))


def _mask_secret(shop: Shop) -> DataFrame:
    return shop["customer"].select(
        "id_customer",
        masking.mask_secret(F.col("passwd")).alias("passwd"),
        masking.mask_secret(F.col("company")).alias("company"),
    )


def _mask_hash(shop: Shop) -> DataFrame:
    return shop["address"].select(
        "id_address",
        masking.mask_hash(F.col("address1")).alias("address1"),
        masking.mask_hash(F.col("address2")).alias("address2"),
    )


def _anonymize(shop: Shop) -> DataFrame:
    return masking.anonymize(
        shop["customer"].select(
            "id_customer", "firstname", "lastname", "email", "passwd", "secure_key", "company"
        )
    )


def _anonymize_address(shop: Shop) -> DataFrame:
    return masking.anonymize(
        shop["address"].select(
            "id_address", "address1", "address2", "phone", "phone_mobile", "vat_number", "city"
        )
    )


def _log_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts made of event properties and private keys in mixed case."""
    context = F.concat(
        F.lit('{"Email": "u'),
        F.col("user_id").cast("string"),
        F.lit('@x.fr", "props": '),
        F.col("props"),
        F.lit(', "type": "'),
        F.col("event_type"),
        F.lit('", "PHONE": 1}'),
    )
    only_private = F.concat(F.lit('{"lastname": "'), F.col("event_type"), F.lit('"}'))
    text = F.when(F.col("event_id") % 4 == 0, only_private).otherwise(context)
    events = sample_table(spark, sf_dir, "events")
    return events.select("event_id", masking.log_redact(text).alias("context"))


def _risky_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts behind a control and, mostly, a formula character."""
    lead = F.expr("concat(char(1 + doc_id % 3), substring('=+-@a', 1 + doc_id % 5, 1))")
    documents = sample_table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.concat(lead, F.col("text")).alias("text"))


def _csv_safe_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _risky_texts(spark, sf_dir).select(
        "doc_id",
        cells.csv_safe_value(text).alias("safe"),
        cells.csv_safe_value(text, legacy_order=True).alias("legacy"),
    )


def _csv_safe_cells(shop: Shop) -> DataFrame:
    """Text, whole numbers, and money from far below 0.001 to above 10 million."""
    balance = F.col("acctbal")
    rows = shop["customer"].select(
        "id_customer",
        F.col("company").alias("_dirty"),
        F.round(balance).cast("long").alias("balance"),
        (F.round(balance) * 10_000.5).alias("large"),
        (F.round(balance) / 1_048_576).alias("small"),
    )
    return cells.csv_safe_cells(rows)


def _csv_header_clean(shop: Shop) -> DataFrame:
    return cells.csv_header_clean(
        shop["orders"].select(
            "id_order",
            F.col("total_paid_tax_incl").alias("total (€)"),
            F.col("payment").alias("mode-paiement"),
        )
    )


def _column_projection(shop: Shop) -> DataFrame:
    return project_columns(shop["customer"], ["email", "birthday", "id_customer"])


def _sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with line breaks and quotes, through CSV and back."""
    path = scratch_dir(spark, "sink_csv")
    documents = sample_table(spark, sf_dir, "documents")
    write_csv(documents.select("doc_id", "text", "lang", "n_chars"), path)
    rows = read_csv(spark, path)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "n_chars")})


def _csv_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every written file starts with the byte order mark."""
    path = scratch_dir(spark, "csv_bom")
    write_csv(_shop(spark, sf_dir)["orders"], path, CsvOptions(rows_per_file=5000))
    return file_facts(spark, path).agg(F.bool_and("marked").alias("marked"))


def _sink_csv_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "sink_csv_masked")
    options = CsvOptions(anonymize=True, compression="gzip", rows_per_file=500, sep=",")
    rows = _shop(spark, sf_dir)["customer"].select("id_customer", "email", "lastname", "company")
    write_csv(rows, path, options)
    back = read_csv(spark, path, options)
    return back.withColumn("id_customer", F.col("id_customer").cast("long"))


def _export_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset with all its columns, as text, as it stands in the files."""
    path = scratch_dir(spark, "export_relational")
    specs = {"orders": FILTERED, "customers": ACTIVE}
    done = export_relational(
        _shop(spark, sf_dir), path, "full", "complete", specs, include_custom_tables=True
    )
    read = {n: read_csv(spark, p, columns=done.columns[n]) for n, p in done.outputs.items()}
    return _rows_as_text(read)


def _export_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that continues after a cursor, and the next one, which finds nothing."""
    shop = _shop(spark, sf_dir)
    spec = {"orders": FilterSpec(incremental=True, current_state=["O"])}
    parts = []
    cursors = {"orders": 1000}
    for run in range(2):
        path = scratch_dir(spark, "export_incremental")
        done = export_relational(shop, path, "orders", specs=spec, cursors=cursors)
        cursors = done.cursors
        back = read_csv(spark, done.outputs["orders"], columns=done.columns["orders"])
        parts.append(
            back.select(
                F.lit(run).alias("run"), F.col("id_order").cast("long").alias("id_order")
            )
        )
    return parts[0].unionByName(parts[1])


def _export_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs that a log ties together: orders up to 4000, what came since, and nothing new."""
    whole = _shop(spark, sf_dir)
    folder = scratch_dir(spark, "export_continued")
    log = ExportLog(spark, f"{folder}/log")
    spec = {"orders": FilterSpec(incremental=True, current_state=["O"])}
    early = whole.replace(orders=whole["orders"].where("id_order <= 4000"))
    parts = []
    for run, shop in enumerate((early, whole, whole)):
        done = export_relational(shop, f"{folder}/{run}", "orders", specs=spec, log=log)
        for table in ("orders", "order_detail"):
            back = read_csv(spark, done.outputs[table], columns=done.columns[table])
            parts.append(
                back.select(F.lit(run).alias("run"), F.lit(table).alias("entity"), F.col("id_order").cast("long").alias("id_order"))
            )
    return reduce(DataFrame.unionByName, parts)


def _file_manifest_any_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of datasets in folders whose names a URI writes in another way."""
    base, options = scratch_dir(spark, "file_manifest_any_path"), CsvOptions(rows_per_file=4000)
    orders = _shop(spark, sf_dir)["orders"].select(ORDER_COLUMNS)
    outputs = {}
    for k, name in enumerate(("größe", "a%20b", "a b", "a#b")):
        outputs[name] = f"{base}/{name}"
        write_csv(orders.where(F.col("id_order") % 4 == k), outputs[name], options)
    files = file_manifest(spark, outputs, options)
    return files.groupBy("entity_name").agg(F.sum("row_count").alias("row_count"))


def _scan_children_scattered(shop: Shop) -> DataFrame:
    """Lines of orders that are few and lie all over the key range: a key filter acts before the shuffle."""
    chosen = select_orders(shop, FilterSpec(current_state=["P"], id_shop=2, id_lang=1, id_currency=3))
    known = closure.parent_keys(chosen, "id_order", ["id_order"], unstored, "orders")
    return closure.scan_children(shop, ENTITIES["order_detail"], chosen, known)


def _flat_orders_colocated(shop: Shop) -> DataFrame:
    """Flat rows from bucketed copies of orders and lines, where lines meet their orders without a shuffle."""
    folder = scratch_dir(shop.spark, "colocated")
    copies = write_colocated(
        shop, "default", ["orders", "order_detail"], 16, path=folder, prefix=folder.rpartition("/")[2].replace("-", "_") + "_"
    )
    return wide.flat_orders(copies, WIDE)


def _export_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "export_enriched")
    done = export_enriched(_shop(spark, sf_dir), path, WIDE, ordered=True)
    return read_csv(spark, done.outputs["orders_enriched"], columns=list(wide.ENRICHED))


def _export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "export_flat")
    done = export_flat(_shop(spark, sf_dir), path, WIDE)
    return read_csv(spark, done.outputs["export_complet"], columns=list(wide.FLAT))


def _file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity: rows over its files, and whether every file is described."""
    path = scratch_dir(spark, "file_manifest")
    options = CsvOptions(rows_per_file=2000)
    shop = _shop(spark, sf_dir)
    spec = {"orders": FilterSpec(date_add_from="1999-01-01")}
    done = export_relational(
        shop, path, "orders", "essential", spec, options=options, include_reference=False
    )
    files = file_manifest(spark, done.outputs, options)
    described = (F.length("checksum") == 64) & (F.col("filesize") > 0)
    return files.groupBy("entity_name").agg(
        F.sum("row_count").alias("row_count"),
        F.bool_and(described & F.col("filename").startswith("part-")).alias("described"),
    )


def _resume_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arriving as a stream; the second run finds nothing new."""
    shop = _shop(spark, sf_dir)
    columns = shop["orders"].columns
    work = scratch_dir(spark, "resume_export")
    schema = sample_table(spark, sf_dir, "orders").schema
    for _ in range(2):
        arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders*.parquet")

        def select(batch: DataFrame) -> DataFrame:
            orders = shop.view("orders", batch).select(columns)
            return select_orders(shop.replace(orders=orders), WIDE).select(ORDER_COLUMNS)

        resume_export(arriving, select, f"{work}/out", f"{work}/progress").awaitTermination()
    back = read_csv(spark, f"{work}/out")
    return back.select(
        F.col("id_order").cast("long").alias("id_order"),
        F.col("id_customer").cast("long").alias("id_customer"),
        "current_state",
        F.col("total_paid_tax_incl").cast("double").alias("total_paid_tax_incl"),
    )


QUERIES: dict[str, Query] = {
    # Scans.
    "scan_orders": _over(lambda s: scans.after(select_orders(s, PERIOD), "id_order", 20)),
    "scan_customers": _over(lambda s: select_customers(s, ACTIVE)),
    "scan_generic_root": _over(lambda s: scans.scan_root(s, "customer", 70)),
    "scan_children": _over(
        lambda s: closure.scan_children(s, ENTITIES["order_detail"], select_orders(s, PERIOD))
    ),
    "scan_children_scattered": _over(_scan_children_scattered),
    "keyset_pages": _over(
        lambda s: scans.keyset_pages(select_orders(s, PERIOD), "id_order", 100, 300).select("page", *ORDER_COLUMNS)
    ),
    "keyset_page": _over(
        lambda s: scans.keyset_page(select_orders(s, PERIOD), "id_order", 300, 100).select(
            ORDER_COLUMNS
        )
    ),
    "incremental_since": _over(
        lambda s: scans.incremental_since(s["orders"], "id_order", 1000)[0].select(ORDER_COLUMNS)
    ),
    "incremental_watermark": _over(
        lambda s: scans.incremental_since(s["orders"], "id_order", 1000)[1]
    ),
    "custom_columns": _over(lambda s: scans.custom_columns(s["customer"], "customer")),
    "custom_table_closure": _over(_custom_table_closure),
    # Sinks.
    "sink_csv": _sink_csv,
    "sink_csv_masked": _sink_csv_masked,
    "csv_header_clean": _over(_csv_header_clean),
    "csv_safe_cells": _over(_csv_safe_cells),
    "csv_bom": _csv_bom,
    "column_projection": _over(_column_projection),
    "export_relational": _export_relational,
    "export_incremental": _export_incremental,
    "export_continued": _export_continued,
    "export_enriched": _export_enriched,
    "export_flat": _export_flat,
    "file_manifest": _file_manifest,
    "file_manifest_any_path": _file_manifest_any_path,
    "resume_export": _resume_export,
    # Projections and wide joins.
    "project_all": _over(lambda s: select_orders(s)),
    "project_enriched": _over(lambda s: wide.enriched_orders(s, WIDE, label_lang=2)),
    "project_flat": _over(lambda s: wide.flat_orders(s, FILTERED, label_lang=2)),
    "enriched_orders": _over(lambda s: wide.enriched_orders(s)),
    "flat_orders": _over(lambda s: wide.flat_orders(s, WIDE)),
    "flat_orders_colocated": _over(_flat_orders_colocated),
    "flat_orders_by_department": _over(
        lambda s: wide.flat_orders(s, FilterSpec(dept_code=["20", "05", "973"]))
    ),
    "flat_orders_corsica": _over(
        lambda s: wide.flat_orders(s, FilterSpec(dept_code=["2A", "05"]), corsica=True)
    ),
    "flat_orders_guarded": _over(
        lambda s: wide.flat_orders(
            _with_france(s), FilterSpec(dept_code=["20", "05", "06", "07", "973"]), country_guard=True
        )
    ),
    # Filters.
    **{name: _orders(**filters) for name, filters in ORDER_FILTERS.items()},
    **{name: _customers(**filters) for name, filters in CUSTOMER_FILTERS.items()},
    "f_late_default_state": _over(_late_default),
    "f_ignore_case": _over(_ignore_case),
    "c_prospect": _over(_prospects),
    "c_last_visit": _over(_last_visit),
    "geo_customer": _over(_geo_customer),
    "geo_corsica": _over(_geo_corsica),
    "geo_country_guard": _over(_geo_guarded),
    # Joins.
    "semi_join": _over(
        lambda s: where_children(
            s["orders"], s["order_slip"], "id_order", [ChildTest(at_least=2)]
        ).select(ORDER_COLUMNS)
    ),
    "anti_join": _over(
        lambda s: where_children(
            s["orders"], s["order_detail"], "id_order", [ChildTest(wanted=False)]
        ).select(ORDER_COLUMNS)
    ),
    "relational_closure": _over(_closure),
    "relational_closure_customers": _over(_closure_by_customer),
    "closure_by_reference": _over(
        lambda s: closure.scan_children(s, ENTITIES["order_payment"], select_orders(s, FILTERED))
    ),
    "job_owner_join": _over(lambda s: listing.with_owner(s["export_job"], s["employee"])),
    "reference_bundle": _over(_reference_bundle),
    # Aggregates.
    "count_orders": _over(lambda s: measures.count_orders(s, FILTERED)),
    "count_customers": _over(lambda s: measures.count_customers(s, ACTIVE)),
    "count_customers_in_group": _over(
        lambda s: measures.count_customers(s, FilterSpec(in_group=["2-HIGH"], ltv_min=900000.0))
    ),
    "count_flat": _over(lambda s: measures.count_flat(s, WIDE)),
    "v_order_count": _value_filter("order_count", order_count_min=2, order_count_max=3),
    "v_ltv": _value_filter("ltv", ltv_min=200000.0, ltv_max=1500000.0),
    "v_avg_basket": _value_filter(
        "avg_basket", avg_basket_min=100000.0, avg_basket_max=300000.0
    ),
    "customer_value": _over(_customer_value),
    "estimate_ratio": _over(
        lambda s: measures.estimate_ratio(
            s, "full", "ultra", {"orders": PERIOD, "customers": ACTIVE}
        )
    ),
    "estimate_by_table": _over(
        lambda s: measures.estimate_by_table(
            s, "full", "complete", {"orders": PERIOD, "customers": ACTIVE}
        )
    ),
    "estimate_total": _over(
        lambda s: measures.estimate_total(
            s, "full", "complete", {"orders": PERIOD, "customers": ACTIVE}
        )
    ),
    "job_progress": _over(_job_progress),
    "rows_per_table": lambda spark, sf_dir: measures.rows_per_table(
        {n: sample_table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "events")}
    ),
    # Scalar functions.
    "department_of": _over(_department_of),
    "mask_email": _mask_email,
    "mask_phone": _mask_phone,
    "mask_secret": _over(_mask_secret),
    "mask_hash": _over(_mask_hash),
    "anonymize": _over(_anonymize),
    "anonymize_address": _over(_anonymize_address),
    "csv_safe_value": _csv_safe_value,
    "log_redact": _log_redact,
    # Short lists.
    "top_recent_jobs": _over(
        lambda s: listing.top_recent_jobs(s["export_job"], s["employee"], 50)
    ),
    "jobs_by_status": _over(
        lambda s: listing.jobs_by_status(s["export_job"], ["pending", "running", "paused"], 20)
    ),
    "recent_logs": _over(lambda s: listing.recent_logs(s["export_log"], 8, 15)),
    "job_files": _over(
        lambda s: listing.job_files(s["export_file"], 7).select("id_export_job", "entity_name")
    ),
    "order_by_key": _over(
        lambda s: select_orders(s, FILTERED).select(ORDER_COLUMNS).orderBy("id_order")
    ),
    "flat_sort": _over(
        lambda s: wide.flat_orders(s, FILTERED, with_line_id=True)
        .select("id_order", "id_order_detail", "product_id")
        .orderBy("id_order", "id_order_detail", "product_id")
    ),
    "facet_payments": _over(lambda s: listing.facet_payments(s["orders"])),
    "facet_regions": _over(lambda s: listing.facet_regions(s.geo_map(), s["address"])),
    "facet_departments": _over(lambda s: listing.facet_departments(s.geo_map(), s["address"])),
    # Integrity and retention.
    "orphan_rows": _over(
        lambda s: integrity.orphan_rows(s["order_detail"], _recent_parents(s), "id_order").select(
            LINE_COLUMNS
        )
    ),
    "drop_orphans": _over(
        lambda s: integrity.drop_orphans(s["order_detail"], _recent_parents(s), "id_order").select(
            LINE_COLUMNS
        )
    ),
    "mark_stuck": _over(
        lambda s: integrity.mark_stuck(s["export_job"], "1998-01-01 00:00:00").select(
            "id_export_job", "status", "error_message"
        )
    ),
    "retention_split": _over(_retention),
    "drop_expired": _over(
        lambda s: integrity.drop_expired(s["export_file"], "download_expires", AS_OF)
    ),
    "valid_links": _over(
        lambda s: integrity.valid_links(
            s["export_file"], "download_expires", "2000-01-01 00:00:00"
        )
    ),
}
