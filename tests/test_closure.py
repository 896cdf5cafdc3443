import pytest

from tradewind.filters import FilterSpec
from tradewind.operators.closure import plan_export, reference_bundle, relational_closure
from tradewind.operators.customers import select_customers
from tradewind.operators.integrity import (
    drop_expired, drop_orphans, mark_stuck, orphan_rows, retention_split, valid_links,
)
from tradewind.operators.listing import facet_payments, facet_regions, newest, with_owner
from tradewind.operators.measures import (
    estimate_by_table, estimate_ratio, progress_percent, rows_per_table,
)
from tradewind.operators.orders import select_orders
from tradewind.plans.entities import ENTITIES, planned_entities
from tradewind.sources import scans
from pyspark.sql import functions as F


def ids(df, key):
    return sorted(r[0] for r in df.select(key).collect())


def test_levels_grow():
    names = [
        {e.name for e in planned_entities(ENTITIES, "full", level)}
        for level in ("essential", "complete", "ultra")
    ]
    assert list(map(len, names)) == [4, 11, 23]
    assert names[0] < names[1] < names[2]
    assert {e.name for e in planned_entities(ENTITIES, "full", "?")} == names[0]
    with pytest.raises(ValueError):
        planned_entities(ENTITIES, "everything")


def test_parents_come_first(shop):
    plan = plan_export(shop, "full", "ultra", include_custom=True)
    seen = set()
    for e in plan:
        assert e.is_root or e.parent in seen
        seen.add(e.name)
    assert "wishlist" in seen and "guest" not in seen


def test_closure_reaches_two_levels(shop):
    plan = plan_export(shop, "orders", "ultra")
    chosen = select_orders(shop, FilterSpec(id_max=2))
    tables = relational_closure(shop, plan, {"orders": chosen})
    assert ids(tables["order_detail"], "id_order_detail") == [1, 2, 3, 4]
    assert ids(tables["order_slip"], "id_order_slip") == [1]
    assert ids(tables["order_slip_detail"], "id_order_slip_detail") == [1, 2]
    assert ids(tables["order_payment"], "id_order_payment") == [1, 2]
    assert tables["order_payment"].columns == shop["order_payment"].columns


def test_closure_of_customers_with_a_custom_table(shop):
    plan = plan_export(shop, "customers", "ultra", include_custom=True)
    tables = relational_closure(shop, plan, {"customer": select_customers(shop)})
    assert ids(tables["cart_product"], "id_product") == [100, 200]
    assert ids(tables["wishlist"], "id_wishlist") == [1]
    assert ids(tables["customer_group"], "id_group") == [1, 2, 2]


def test_reference_rows_in_use(shop):
    bundle = reference_bundle(shop, {"address": shop["address"].where("id_country = 9")})
    assert ids(bundle["country"], "id_country") == [9]
    assert ids(bundle["country_lang"], "id_lang") == [1]
    assert ids(bundle["state"], "id_state") == [2]
    assert set(bundle) == {"country", "country_lang", "state"}


def test_custom_columns(spark, shop):
    customer = shop["customer"].withColumn("tier", F.lit("gold"))
    assert scans.custom_columns(customer, "customer").columns == ["id_customer", "tier"]
    assert scans.custom_columns(shop["wishlist"], "wishlist").columns == [
        "id_wishlist", "id_customer"
    ]
    assert scans.custom_tables(shop, "id_customer") == ["wishlist"]


def test_pages_cover_the_scan(shop):
    seen, cursor = [], None
    while True:
        page = ids(scans.keyset_page(shop["orders"], "id_order", cursor, 2), "id_order")
        if not page:
            break
        seen += page
        cursor = page[-1]
    assert seen == [1, 2, 3, 4, 5]


def test_watermark(shop):
    fresh, mark = scans.incremental_since(shop["orders"], "id_order", 3)
    assert ids(fresh, "id_order") == [4, 5] and mark.first().watermark == 5
    fresh, mark = scans.incremental_since(shop["orders"], "id_order", 50)
    assert ids(fresh, "id_order") == [] and mark.first().watermark == 50


def test_estimates(shop):
    specs = {"orders": FilterSpec(id_max=2)}
    got = dict(map(tuple, estimate_ratio(shop, "orders", "ultra", specs).collect()))
    assert got["orders"] == 2 and got["order_history"] == 10 and got["order_detail"] == 6
    assert got["order_slip"] == 4 and got["order_slip_detail"] == 6
    got = dict(map(tuple, estimate_by_table(shop, "orders", "essential", specs).collect()))
    assert got == {"orders": 2, "order_detail": 5}
    got = dict(map(tuple, rows_per_table({"c": shop["cart"], "o": shop["orders"]}).collect()))
    assert got == {"c": 3, "o": 5}


def test_progress(spark):
    df = spark.createDataFrame(
        [(0, 5, 0), (1, 1, 3), (2, 9, 3), (3, 3, 3), (4, 5, -1)], "i int, done long, total long"
    )
    rows = df.select("i", progress_percent(F.col("done"), F.col("total")).alias("p")).collect()
    assert [r.p for r in sorted(rows)] == [0.0, 33.3, 100.0, 100.0, 0.0]


def test_lists(spark, shop):
    assert [r[0] for r in facet_payments(shop["orders"]).collect()] == ["Carte", "Virement 100%"]
    regions = [r.region_name for r in facet_regions(shop.geo_map()).collect()]
    assert len(regions) == 18 and regions == sorted(regions)
    assert [r.id_order for r in newest(shop["orders"], "date_add", "id_order", 2).collect()] == [2, 1]
    jobs = spark.createDataFrame([(1, 7), (2, None)], "id_export_job long, id_employee long")
    names = spark.createDataFrame(
        [(7, "A", "B")], "id_employee long, firstname string, lastname string"
    )
    assert sorted(map(tuple, with_owner(jobs, names).collect())) == [
        (1, 7, "A", "B"), (2, None, None, None)
    ]


def test_orphans(spark):
    children = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, job int")
    parents = spark.createDataFrame([(1,)], "id int")
    assert ids(orphan_rows(children, parents, "job", "id"), "id") == [2, 3]
    assert ids(drop_orphans(children, parents, "job", "id"), "id") == [1]


JOBS = "id int, status string, date_upd timestamp_ntz"


def test_stuck_and_retention(spark):
    jobs = spark.sql(
        """
        SELECT * FROM VALUES
          (1, 'running', timestamp_ntz'2024-01-01 00:00:00'),
          (2, 'running', timestamp_ntz'2024-01-09 12:00:00'),
          (3, 'completed', timestamp_ntz'2024-01-01 00:00:00'),
          (4, 'running', CAST(NULL AS timestamp_ntz))
        AS t(id, status, date_upd)
        """
    )
    as_of = "2024-01-10 00:00:00"
    marked = {r.id: (r.status, r.error_message) for r in mark_stuck(jobs, as_of).collect()}
    assert marked[1][0] == "failed" and "24h" in marked[1][1]
    assert marked[2] == ("running", None) and marked[3] == ("completed", None)
    assert marked[4] == ("running", None)

    files = spark.createDataFrame([(10, 1), (11, 2), (12, 99), (13, None)], "f int, id int")
    parts = retention_split(jobs, files, key="id", time="date_upd", as_of=as_of)
    assert ids(parts.kept, "id") == [2, 4] and ids(parts.expired, "id") == [1, 3]
    assert ids(parts.kept_children, "f") == [11, 12, 13]
    assert ids(parts.expired_children, "f") == [10]
    assert ids(drop_expired(jobs, "date_upd", as_of), "id") == [2, 4]
    assert ids(valid_links(jobs, "date_upd", "2024-01-05 00:00:00"), "id") == [2]


def test_last_day_is_whole(spark, shop):
    def dated(text):
        return shop.replace(orders=shop["orders"].withColumn("date_add", F.to_timestamp_ntz(F.lit(text))))

    spec = FilterSpec(date_add_from="2024-02-28", date_add_to="2024-02-29")
    assert select_orders(dated("2024-02-29 23:59:59.5"), spec).count() == 5
    assert select_orders(dated("2024-02-29 23:59:59.999999"), spec).count() == 5
    assert select_orders(dated("2024-03-01 00:00:00"), spec).count() == 0
    assert select_orders(dated("2024-02-28 00:00:00"), spec).count() == 5


def test_own_columns_survive_a_region_filter(shop):
    from tradewind.operators.geo import matching_addresses

    own = shop.replace(address=shop["address"].withColumn("_department", F.lit("own")))
    rows = matching_addresses(own, FilterSpec(region_code=["IDF"]), country_guard=True).collect()
    assert {r._department for r in rows} == {"own"} and {r.postcode for r in rows} == {"75001"}


def test_wide_departments_follow_corsica_and_guard(shop):
    from tradewind.operators.wide import enriched_orders

    corsican = shop.replace(address=shop["address"].withColumn("postcode", F.lit("20090")))
    def rows(code, **o):
        return enriched_orders(corsican, FilterSpec(dept_code=[code]), **o).count()

    assert [rows("2A"), rows("2A", corsica=True), rows("20"), rows("20", corsica=True)] == [0, 4, 4, 0]
    assert rows("20", country_guard=True) == 0
    assert rows("2A", corsica=True, country_guard=True) == select_orders(
        corsican, FilterSpec(dept_code=["2A"]), corsica=True, country_guard=True
    ).count()


def test_an_address_column_named_country(shop):
    from tradewind.operators.wide import enriched_orders, flat_orders

    own = shop.replace(address=shop["address"].withColumn("country", F.lit("own")))
    for build in (enriched_orders, flat_orders):
        got = {r.delivery_country for r in build(own).collect()}
        assert got <= {"France", "Belgique", None} and "France" in got


def test_newest_runs_stay_in_order(spark):
    from tradewind.operators.listing import top_recent_jobs

    jobs = spark.range(200).selectExpr("id AS id_export_job", "id * 7 % 50 AS id_employee", "id * 13 % 200 AS date_add")
    names = spark.range(50).selectExpr("id AS id_employee", "'a' AS firstname", "'b' AS lastname")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [r.date_add for r in top_recent_jobs(jobs, names, 60).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == list(range(199, 139, -1))


def test_total_estimate(shop):
    from tradewind.operators.measures import estimate_total

    assert estimate_total(shop, "orders", "essential", {"orders": FilterSpec(id_max=2)}).first().rows == 7


def test_department_map_rows(shop):
    rows = {r.dept_code: (r.dept_name, r.region_code) for r in shop.geo_map().collect()}
    assert len(rows) == 101
    assert rows["2A"] == ("Corse-du-Sud", "COR") and rows["75"] == ("Paris", "IDF")
    assert rows["974"][1] == "REU" and rows["01"] == ("Ain", "ARA")
