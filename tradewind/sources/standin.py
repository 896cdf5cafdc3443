"""The sample tables seen as a shop.

Each shop table is a projection of one sample table, so that filters and column
pruning reach its Parquet scan.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession

from tradewind.sources.shop import Shop

# Shop table -> (sample table, condition or None, column expressions).
_VIEWS: dict[str, tuple[str, str | None, list[str]]] = {
    "orders": (
        "orders",
        None,
        [
            "o_orderkey AS id_order",
            "concat('R', o_orderkey) AS reference",
            "o_custkey % 3 + 1 AS id_shop",
            "o_custkey % 7 + 1 AS id_carrier",
            "o_orderkey % 2 + 1 AS id_lang",
            "o_custkey AS id_customer",
            "o_custkey % 4 + 1 AS id_currency",
            "o_custkey AS id_address_delivery",
            "o_custkey + o_orderkey % 3 AS id_address_invoice",
            "o_orderstatus AS current_state",
            "o_orderpriority AS payment",
            "lower(substring(o_orderpriority, 3)) AS module",
            "CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN concat('T', o_orderkey) END"
            " AS shipping_number",
            "CAST(o_orderkey % 50 AS DOUBLE) AS total_discounts_tax_incl",
            "o_totalprice AS total_paid_tax_incl",
            "o_totalprice * 0.8D AS total_paid_tax_excl",
            "o_totalprice * 0.75D AS total_products",
            "CAST(o_orderkey % 5 AS DOUBLE) AS total_shipping_tax_incl",
            "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_orderkey END"
            " AS invoice_number",
            "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS valid",
            "o_orderdate AS date_add",
            "o_orderdate + INTERVAL '2' DAY AS date_upd",
        ],
    ),
    "order_detail": (
        "lineitem",
        None,
        [
            "l_orderkey * 8 + l_linenumber AS id_order_detail",
            "l_orderkey AS id_order",
            "l_partkey AS product_id",
            "l_linenumber AS product_attribute_id",
            "concat('Part ', l_partkey) AS product_name",
            "concat('P', l_partkey, '-', l_returnflag) AS product_reference",
            "lpad(CAST(l_partkey AS STRING), 13, '0') AS product_ean13",
            "CAST(l_quantity AS BIGINT) AS product_quantity",
            "CASE WHEN l_discount >= 0.09D THEN l_discount * 100 ELSE 0 END AS reduction_percent",
            "CASE WHEN l_quantity >= 49 THEN 5.0D ELSE 0.0D END AS reduction_amount",
            "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_price_tax_incl",
            "l_extendedprice * (1 - l_discount) AS total_price_tax_excl",
        ],
    ),
    "customer": (
        "customer",
        None,
        [
            "c_custkey AS id_customer",
            "c_custkey % 3 + 1 AS id_shop",
            "c_mktsegment AS id_default_group",
            "c_custkey % 2 + 1 AS id_lang",
            "CASE c_custkey % 3 WHEN 1 THEN '' WHEN 2 THEN c_name END AS company",
            "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''"
            " ELSE lpad(CAST(c_custkey AS STRING), 14, '0') END AS siret",
            "substring(c_name, 1, 8) AS firstname",
            "substring(c_name, 10) AS lastname",
            "concat('c', c_custkey, '@', lower(c_mktsegment), '.example') AS email",
            "concat('pw', c_custkey) AS passwd",
            "c_custkey % 2 AS newsletter",
            "CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS optin",
            "concat('key', c_custkey) AS secure_key",
            "CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS active",
            "CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS deleted",
            "timestamp_ntz'1995-01-01 00:00:00'"
            " + make_dt_interval(CAST(c_custkey % 2000 AS INT)) AS date_add",
            "c_acctbal AS acctbal",
            "c_nationkey AS home_nation",
        ],
    ),
    "address": (
        "customer",
        None,
        [
            "c_custkey AS id_address",
            "c_nationkey AS id_country",
            "c_nationkey AS id_state",
            "c_custkey AS id_customer",
            "CASE c_custkey % 3 WHEN 1 THEN '' WHEN 2 THEN c_name END AS company",
            "substring(c_name, 10) AS lastname",
            "substring(c_name, 1, 8) AS firstname",
            "concat(c_custkey % 300, ' rue du Port') AS address1",
            "CASE c_custkey % 2 WHEN 1 THEN 'Escalier B' END AS address2",
            "lpad(CAST(c_custkey * 67 % 99000 AS STRING), 5, '0') AS postcode",
            "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('Ville ', c_nationkey) END AS city",
            "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''"
            " ELSE concat('06 ', lpad(CAST(c_custkey AS STRING), 8, '0')) END AS phone",
            "CASE c_custkey % 6 WHEN 0 THEN concat('+33', c_custkey) END AS phone_mobile",
            "CASE c_custkey % 5 WHEN 0 THEN concat('FR', c_custkey) WHEN 1 THEN '' END"
            " AS vat_number",
        ],
    ),
    "country": (
        "nation",
        None,
        [
            "n_nationkey AS id_country",
            "substring(n_name, 8) AS iso_code",
            "n_regionkey AS id_zone",
        ],
    ),
    "country_lang": (
        "nation",
        None,
        [
            "n_nationkey AS id_country",
            "explode(array(1, 2)) AS id_lang",
            "n_name AS name",
        ],
    ),
    "state": (
        "nation",
        None,
        ["n_nationkey AS id_state", "concat('S', n_nationkey) AS iso_code"],
    ),
    "zone": ("region", None, ["r_regionkey AS id_zone", "r_name AS name"]),
    "currency": ("region", None, ["r_regionkey AS id_currency", "r_name AS name"]),
    "lang": ("region", None, ["r_regionkey AS id_lang", "r_name AS name"]),
    "carrier_lang": (
        "supplier",
        None,
        ["s_suppkey AS id_carrier", "explode(array(1, 2)) AS id_lang", "s_name AS delay"],
    ),
    "cart_rule_lang": (
        "part",
        None,
        ["p_partkey AS id_cart_rule", "explode(array(1, 2)) AS id_lang", "p_name AS name"],
    ),
    "guest": (
        "events",
        "event_type = 'view'",
        ["event_id AS id_guest", "user_id AS id_customer", "ts AS date_add"],
    ),
    "order_message": (
        "conversations",
        "turn = 1",
        ["conv_id AS id_order_message", "conv_id AS id_order", "role AS name"],
    ),
    "order_return_detail": (
        "lineitem",
        "l_returnflag = 'R'",
        [
            "l_orderkey * 8 + l_linenumber AS id_order_return",
            "l_partkey AS id_order_detail",
            "CAST(l_quantity AS BIGINT) AS product_quantity",
        ],
    ),
    "carrier": ("supplier", None, ["s_suppkey AS id_carrier", "s_name AS name"]),
    "product": (
        "part",
        None,
        [
            "p_partkey AS id_product",
            "p_brand AS id_manufacturer",
            "p_type AS id_category_default",
        ],
    ),
    "cart_rule": ("part", None, ["p_partkey AS id_cart_rule", "p_brand AS code"]),
    "order_cart_rule": (
        "lineitem",
        "l_discount >= 0.08D",
        [
            "l_orderkey * 8 + l_linenumber AS id_order_cart_rule",
            "l_orderkey AS id_order",
            "l_partkey AS id_cart_rule",
            "l_extendedprice * l_discount AS value",
        ],
    ),
    "order_history": (
        "events",
        None,
        [
            "event_id AS id_order_history",
            "event_id DIV 3 AS id_order",
            "event_type AS id_order_state",
        ],
    ),
    "order_payment": (
        "lineitem",
        "l_linestatus = 'F'",
        [
            "l_orderkey * 8 + l_linenumber AS id_order_payment",
            "concat('R', l_orderkey) AS order_reference",
            "l_extendedprice AS amount",
        ],
    ),
    "order_carrier": (
        "orders",
        "o_orderstatus <> 'P'",
        ["o_orderkey AS id_order_carrier", "o_orderkey AS id_order", "o_custkey % 7 + 1 AS id_carrier"],
    ),
    "order_invoice": (
        "orders",
        "o_orderstatus = 'F'",
        ["o_orderkey AS id_order_invoice", "o_orderkey AS id_order", "o_totalprice AS total"],
    ),
    "order_invoice_payment": (
        "lineitem",
        "l_linestatus = 'F'",
        ["l_orderkey AS id_order_invoice", "l_orderkey * 8 + l_linenumber AS id_order_payment"],
    ),
    "order_slip": (
        "lineitem",
        "l_returnflag = 'A'",
        ["l_orderkey * 8 + l_linenumber AS id_order_slip", "l_orderkey AS id_order"],
    ),
    "order_slip_detail": (
        "lineitem",
        None,
        [
            "l_partkey AS id_order_slip_detail",
            "l_orderkey * 8 + l_linenumber AS id_order_slip",
            "l_quantity AS product_quantity",
        ],
    ),
    "order_return": (
        "lineitem",
        "l_returnflag = 'R'",
        ["l_orderkey * 8 + l_linenumber AS id_order_return", "l_orderkey AS id_order"],
    ),
    "message": (
        "documents",
        None,
        ["doc_id AS id_message", "doc_id AS id_order", "text AS message"],
    ),
    "customer_group": (
        "orders",
        None,
        ["o_custkey AS id_customer", "o_orderpriority AS id_group"],
    ),
    "cart": ("orders", None, ["o_orderkey AS id_cart", "o_custkey AS id_customer"]),
    "cart_product": (
        "lineitem",
        None,
        ["l_orderkey AS id_cart", "l_partkey AS id_product", "l_quantity AS quantity"],
    ),
    "customer_thread": (
        "conversations",
        "turn = 0",
        ["conv_id AS id_customer_thread", "conv_id AS id_customer"],
    ),
    "customer_message": (
        "conversations",
        None,
        [
            "conv_id * 1000 + turn AS id_customer_message",
            "conv_id AS id_customer_thread",
            "text AS message",
        ],
    ),
    "connections": (
        "events",
        "event_type = 'purchase'",
        ["event_id AS id_connections", "user_id AS id_customer", "ts AS date_add"],
    ),
    "loyalty": (
        "events",
        "event_type = 'signup'",
        ["event_id AS id_loyalty", "user_id AS id_customer", "value AS points"],
    ),
    "employee": (
        "customer",
        None,
        [
            "c_custkey AS id_employee",
            "substring(c_name, 1, 8) AS firstname",
            "substring(c_name, 10) AS lastname",
        ],
    ),
    "export_job": (
        "orders",
        None,
        [
            "o_orderkey AS id_export_job",
            "o_custkey AS id_employee",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'"
            " ELSE 'pending' END AS status",
            "o_orderdate AS date_add",
            "o_orderdate + INTERVAL '2' DAY AS date_upd",
        ],
    ),
    "export_file": (
        "lineitem",
        None,
        [
            "l_orderkey * 8 + l_linenumber AS id_export_file",
            "l_orderkey AS id_export_job",
            "concat('entity_', l_linenumber) AS entity_name",
            "l_shipdate AS download_expires",
        ],
    ),
    "export_log": (
        "events",
        None,
        [
            "event_id AS id_log",
            "user_id AS id_export_job",
            "event_type AS level",
            "props AS context_json",
            "ts AS date_add",
        ],
    ),
}


def sample_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _distinct(source: str, *columns: str) -> str:
    names = ", ".join(columns)
    return f"SELECT DISTINCT {names} FROM {{{source}}}"


# Small dimensions: the distinct values of a sample column, as SQL over it.
_DIMENSIONS: dict[str, tuple[str, str]] = {
    "group": ("orders", _distinct("orders", "o_orderpriority AS id_group", "0D AS reduction")),
    "group_lang": (
        "orders",
        _distinct("orders", "o_orderpriority AS id_group", "2 AS id_lang", "substr(o_orderpriority, 3) AS name"),
    ),
    "order_state": (
        "events",
        _distinct("events", "event_type AS id_order_state", "length(event_type) AS position"),
    ),
}


def _order_state_lang(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT * FROM VALUES
            ('F', 1, 'Livrée'), ('O', 1, 'Ouverte'), ('P', 1, 'En cours'),
            ('F', 2, 'Delivered'), ('O', 2, 'Open')
        AS t(id_order_state, id_lang, name)
        """
    )


class SampleShop(Shop):
    """A shop over the sample tables of one scale."""

    def __init__(self, spark: SparkSession, sample_dir: str):
        @cache
        def sample(source: str) -> DataFrame:
            return sample_table(spark, sample_dir, source)

        def opened(name: str) -> DataFrame:
            return self.view(name, sample(_VIEWS[name][0]))

        tables = {name: partial(opened, name) for name in _VIEWS}
        for name, (source, query) in _DIMENSIONS.items():
            tables[name] = lambda s=source, q=query: spark.sql(q, **{s: sample(s)})
        tables["order_state_lang"] = partial(_order_state_lang, spark)
        super().__init__(spark, tables)
        self.sample_dir = sample_dir

    def view(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a sample table in the shape of a shop table."""
        _, condition, columns = _VIEWS[name]
        if condition is not None:
            rows = rows.where(condition)
        return rows.selectExpr(*columns)
