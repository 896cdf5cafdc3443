"""Plans that have to hold when tables are too big to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.operators.closure import (
    plan_export, reference_bundle, relational_closure, used_dimensions,
)
from tradewind.operators.customers import select_customers
from tradewind.operators.membership import children_by_value, children_of
from tradewind.operators.measures import count_flat
from tradewind.operators.orders import select_orders
from tradewind.operators.wide import enriched_orders, flat_orders
from tradewind.registry.queries import QUERIES
from tradewind.sources.standin import SampleShop
from tests.conftest import SMALL

SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def big_world(spark):
    before = {k: spark.conf.get(k) for k in SKEWED}
    for k, v in SKEWED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def executed(df):
    """The plan as adaptive execution left it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_huge_order_are_split(big_world):
    shop = SampleShop(big_world, SMALL)
    lines = shop["order_detail"].repartition(8)
    hot = F.when(F.col("product_id") % 3 == 0, F.lit(7)).otherwise(F.col("id_order"))
    shop = shop.replace(order_detail=lines.withColumn("id_order", hot))
    df = flat_orders(shop)
    assert "skew=true" in executed(df)
    assert df.count() == count_flat(shop).first().n
    assert df.where("id_order = 7").count() == shop["order_detail"].where("id_order = 7").count()


def test_orders_of_one_huge_customer_are_split(big_world):
    shop = SampleShop(big_world, SMALL)
    hot = F.when(F.col("id_order") % 3 == 0, F.lit(7)).otherwise(F.col("id_customer"))
    orders = shop["orders"].repartition(8).withColumn("id_customer", hot)
    chosen = shop["customer"].where("active = 1")
    df = children_of(orders, chosen, "id_customer")
    assert "skew=true" in executed(df)
    active = {r.id_customer for r in chosen.collect()}
    assert df.count() == sum(r.id_customer in active for r in orders.collect())


def test_rows_of_one_huge_value_are_split(big_world):
    shop = SampleShop(big_world, SMALL)
    hot = F.when(F.col("id_order_payment") % 3 == 0, F.lit("R7")).otherwise(
        F.col("order_reference")
    )
    payments = shop["order_payment"].repartition(8).withColumn("order_reference", hot)
    orders = shop["orders"].withColumn(
        "reference", F.when(F.col("id_order") % 3 == 0, F.lit("R7")).otherwise(F.col("reference"))
    )
    df = children_by_value(payments, orders, "order_reference", "reference", "id_order")
    assert "skew=true" in executed(df)
    known = {r.reference for r in orders.collect()}
    assert df.count() == sum(r.order_reference in known for r in payments.collect())


def test_tests_on_one_child_table_share_one_scan(big_world):
    spec = FilterSpec(has_product=[3], product_reference_contains="9", has_product_discount=True)
    plan = planned(select_orders(SampleShop(big_world, SMALL), spec))
    assert len(re.findall(r"FileScan parquet", plan)) == 2
    assert "partial_count" in plan


def test_filters_and_columns_reach_the_scan(spark):
    spec = FilterSpec(date_add_from="1997-01-01", total_paid_tax_incl_min=100.5, payment="5-LOW")
    plan = planned(select_orders(SampleShop(spark, SMALL), spec).select("id_order"))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in plan
    assert "GreaterThanOrEqual(o_totalprice,100.5)" in plan
    assert "EqualTo(o_orderpriority,5-LOW)" in plan
    assert "o_custkey" not in plan


def test_key_range_of_stored_parents_reaches_the_child_scan(spark, tmp_path):
    shop = SampleShop(spark, SMALL)

    def store(name, rows):
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    plan = plan_export(shop, "orders")
    roots = {"orders": select_orders(shop, FilterSpec(id_min=200, id_max=300, payment="5-LOW"))}
    tables = relational_closure(shop, plan, roots, store)
    low, high = tables["orders"].selectExpr("min(id_order)", "max(id_order)").first()
    scan = planned(tables["order_detail"])
    assert f"GreaterThanOrEqual(l_orderkey,{low})" in scan
    assert f"LessThanOrEqual(l_orderkey,{high})" in scan
    lazy = relational_closure(shop, plan, roots, lambda _, rows: rows)
    assert tables["order_detail"].count() == lazy["order_detail"].count() > 0

    none = {"orders": select_orders(shop, FilterSpec(id_min=10**9))}
    empty = relational_closure(shop, plan, none, lambda n, rows: store(n + "_none", rows))
    assert empty["order_detail"].count() == 0


def test_closure_runs_its_selection_once(big_world):
    """Children read the stored orders, not the filters again."""
    shop = SampleShop(big_world, SMALL)
    spec = FilterSpec(payment="5-LOW", has_return=True)
    plan = plan_export(shop, "orders", "ultra")
    tables = relational_closure(shop, plan, {"orders": select_orders(shop, spec)})
    for name in ("orders", "order_detail", "order_slip_detail", "order_payment"):
        assert "o_orderpriority" not in planned(tables[name])


def test_dimension_ids_are_read_once_per_table(big_world):
    """A leaf runs for its dataset and once more for all the dimensions it uses."""
    shop = SampleShop(big_world, SMALL)
    plan = plan_export(shop, "customers", "essential")
    tables = relational_closure(shop, plan, {"customer": select_customers(shop, FilterSpec(customer_active=True))})
    gathered = planned(used_dimensions(shop, tables))
    assert len(re.findall("FileScan parquet", gathered)) == 1
    for rows in reference_bundle(shop, tables).values():
        assert "c_nationkey" not in planned(rows)


def _hot_customer(shop):
    hot = F.when(F.col("id_order") % 3 == 0, F.lit(7)).otherwise(F.col("id_customer"))
    return shop.replace(orders=shop["orders"].repartition(8).withColumn("id_customer", hot))


def _hot_address(shop, key):
    hot = F.when(F.col("id_order") % 3 == 0, F.lit(7)).otherwise(F.col(key))
    return shop.replace(orders=shop["orders"].repartition(8).withColumn(key, hot))


@pytest.mark.parametrize("key", ["id_customer", "id_address_delivery", "id_address_invoice"])
def test_orders_of_one_hot_side_are_split_in_wide_joins(big_world, key):
    shop = SampleShop(big_world, SMALL)
    shop = _hot_customer(shop) if key == "id_customer" else _hot_address(shop, key)
    df = enriched_orders(shop)
    assert "skew=true" in executed(df)
    assert df.count() == shop["orders"].count()


def test_orders_of_one_hot_address_are_split_by_geography(big_world):
    shop = _hot_address(SampleShop(big_world, SMALL), "id_address_delivery")
    df = select_orders(shop, FilterSpec(id_country=list(range(0, 25, 2)), address_type="both"))
    assert "skew=true" in executed(df)


JOINING = [
    n for n in QUERIES
    if n[:2] in ("f_", "c_", "v_") or n.startswith(("geo_", "count_", "enriched_", "flat_", "relational_", "reference_", "estimate_"))
]


@pytest.mark.parametrize("name", [*JOINING, "customer_value"])
def test_no_cross_join_and_no_python(spark, name):
    plan = planned(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "Pandas" not in plan
