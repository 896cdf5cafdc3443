import pytest

from tradewind.sources.shop import Shop


def test_tables_open_on_first_use(spark):
    opened = []

    def table():
        opened.append(1)
        return spark.range(3)

    shop = Shop(spark, {"a": table, "b": lambda: 1 / 0})
    assert list(shop) == ["a", "b"] and len(shop) == 2 and "b" in shop and "c" not in shop
    assert shop["a"].count() == shop["a"].count() == 3
    assert opened == [1]
    with pytest.raises(KeyError):
        shop["c"]


def test_replace_leaves_the_original(spark):
    shop = Shop(spark, {"a": spark.range(3)})
    assert shop.replace(a=spark.range(1))["a"].count() == 1 and shop["a"].count() == 3


def test_from_parquet(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/orders.parquet")
    assert Shop.from_parquet(spark, str(tmp_path), ["orders"])["orders"].count() == 4


def test_from_catalog(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shopdb LOCATION '{tmp_path}/db'")
    try:
        spark.range(2).write.saveAsTable("shopdb.x_orders")
        spark.range(1).write.saveAsTable("shopdb.other")
        shop = Shop.from_catalog(spark, "shopdb", prefix="x_")
        assert list(shop) == ["orders"] and shop["orders"].count() == 2
    finally:
        spark.sql("DROP DATABASE shopdb CASCADE")


def test_own_department_map_wins(spark):
    own = spark.sql("SELECT 'BE' AS country_iso, '10' AS dept_code")
    assert Shop(spark, {"geo_map": own}).geo_map().count() == 1
    assert Shop(spark, {}).geo_map().count() == 101
