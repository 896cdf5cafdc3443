"""One enriched row per order, or one flat row per order line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.operators.orders import select_orders
from tradewind.sources.shop import Shop

# The published columns of the two wide exports, each with the
# source column it shows.  "c." is the customer, "d." and "i." the delivery and
# invoice address, "l." the order line, "state" the label of the order's state.
ENRICHED = {
    "id_order": "id_order",
    "reference": "reference",
    "id_customer": "id_customer",
    "current_state": "current_state",
    "payment": "payment",
    "total_paid_tax_incl": "total_paid_tax_incl",
    "total_paid_tax_excl": "total_paid_tax_excl",
    "total_products": "total_products",
    "total_shipping_tax_incl": "total_shipping_tax_incl",
    "date_add": "date_add",
    "valid": "valid",
    "order_status_name": "state",
    "customer_email": "c.email",
    "customer_firstname": "c.firstname",
    "customer_lastname": "c.lastname",
    "customer_company": "c.company",
    "customer_siret": "c.siret",
    "delivery_company": "d.company",
    "delivery_firstname": "d.firstname",
    "delivery_lastname": "d.lastname",
    "delivery_address1": "d.address1",
    "delivery_address2": "d.address2",
    "delivery_postcode": "d.postcode",
    "delivery_city": "d.city",
    "delivery_country": "d.country",
    "delivery_phone": "d.phone",
    "delivery_phone_mobile": "d.phone_mobile",
    "invoice_company": "i.company",
    "invoice_firstname": "i.firstname",
    "invoice_lastname": "i.lastname",
    "invoice_address1": "i.address1",
    "invoice_address2": "i.address2",
    "invoice_postcode": "i.postcode",
    "invoice_city": "i.city",
    "invoice_country": "i.country",
    "invoice_phone": "i.phone",
}
FLAT = {
    "id_order": "id_order",
    "order_reference": "reference",
    "order_date": "date_add",
    "order_status": "state",
    "payment_method": "payment",
    "total_paid_tax_incl": "total_paid_tax_incl",
    "total_paid_tax_excl": "total_paid_tax_excl",
    "total_products": "total_products",
    "total_shipping": "total_shipping_tax_incl",
    "customer_id": "c.id_customer",
    "customer_email": "c.email",
    "customer_firstname": "c.firstname",
    "customer_lastname": "c.lastname",
    "customer_company": "c.company",
    "customer_newsletter": "c.newsletter",
    "delivery_firstname": "d.firstname",
    "delivery_lastname": "d.lastname",
    "delivery_company": "d.company",
    "delivery_address1": "d.address1",
    "delivery_address2": "d.address2",
    "delivery_postcode": "d.postcode",
    "delivery_city": "d.city",
    "delivery_country": "d.country",
    "delivery_phone": "d.phone",
    "invoice_firstname": "i.firstname",
    "invoice_lastname": "i.lastname",
    "invoice_company": "i.company",
    "invoice_address1": "i.address1",
    "invoice_address2": "i.address2",
    "invoice_postcode": "i.postcode",
    "invoice_city": "i.city",
    "invoice_country": "i.country",
    "invoice_phone": "i.phone",
    "product_id": "l.product_id",
    "product_name": "l.product_name",
    "product_reference": "l.product_reference",
    "product_quantity": "l.product_quantity",
    "product_price_tax_incl": "l.total_price_tax_incl",
    "product_price_tax_excl": "l.total_price_tax_excl",
}


def _labels(shop: Shop, table: str, key: str, language: int) -> DataFrame:
    rows = shop[table].where(F.col("id_lang") == language)
    return rows.select(key, F.col("name").alias("_label"))


def _sides(
    shop: Shop, columns: dict[str, str], language: int
) -> list[tuple[DataFrame, str]]:
    """The tables that a layout shows next to the order, each with its join key.

    Every key is unique there, so a customer or pick-up address with very many
    orders sits on the orders' side, which adaptive execution can split.
    Country labels join the addresses, not the orders, under a name that no
    address column has.  The state's label comes first, while rows are narrow.
    """
    countries = _labels(shop, "country_lang", "id_country", language)
    states = _labels(shop, "order_state_lang", "id_order_state", language)
    sources = [
        ("c", shop["customer"], "id_customer", "id_customer"),
        ("d", shop["address"], "id_address", "id_address_delivery"),
        ("i", shop["address"], "id_address", "id_address_invoice"),
    ]
    states = states.selectExpr("id_order_state AS current_state", "_label AS state")
    sides = [(states, "current_state")]
    for alias, table, key, order_key in sources:
        wanted = [c.split(".")[1] for c in columns.values() if c.startswith(f"{alias}.")]
        labelled = "country" in wanted
        renamed = [f"`{c}` AS `{alias}.{c}`" for c in wanted if c != "country"]
        home = ["id_country AS _home"] if labelled else []
        table = table.selectExpr(f"{key} AS {order_key}", *renamed, *home)
        if labelled:
            names = countries.selectExpr("id_country AS _home", f"_label AS `{alias}.country`")
            table = table.join(names, "_home", "left").drop("_home")
        sides.append((table, order_key))
    return sides


def _decorate(orders: DataFrame, sides: list[tuple[DataFrame, str]]) -> DataFrame:
    for side, key in sides:
        orders = orders.join(side, key, "left")
    return orders


def _layout(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.selectExpr(*[f"`{source}` AS `{name}`" for name, source in columns.items()])


def enriched_orders(
    shop: Shop, spec: FilterSpec | None = None, *, label_lang: int = 1, **options
) -> DataFrame:
    """One row per selected order with customer, addresses and labels.

    ``label_lang`` chooses the language of labels only; it never filters.
    Departments are compared by postcode prefix in the wide exports.
    """
    options.setdefault("department_by_prefix", True)
    orders = select_orders(shop, spec, **options)
    return _layout(_decorate(orders, _sides(shop, ENRICHED, label_lang)), ENRICHED)


def flat_orders(
    shop: Shop,
    spec: FilterSpec | None = None,
    *,
    label_lang: int = 1,
    with_line_id: bool = False,
    **options,
) -> DataFrame:
    """One row per line of the selected orders; one row for an order without.

    Orders are decorated before they meet their lines, so the many line rows
    are shuffled once.  The outer join is written as an inner join plus the
    orders without a line: the lines of one huge order can then be split over
    tasks, which the optional side of an outer join does not allow.
    """
    options.setdefault("department_by_prefix", True)
    orders = select_orders(shop, spec, **options)
    columns = dict(FLAT)
    if with_line_id:
        columns["id_order_detail"] = "l.id_order_detail"
    wanted = [c.split(".")[1] for c in columns.values() if c.startswith("l.")]
    lines = shop["order_detail"]
    keys = lines.select("id_order").distinct()
    lines = lines.selectExpr("id_order", *[f"`{c}` AS `l.{c}`" for c in wanted])
    sides = _sides(shop, columns, label_lang)
    with_lines = _decorate(orders, sides).join(lines, "id_order")
    without = _decorate(orders.join(keys, "id_order", "left_anti"), sides)
    return _layout(with_lines.unionByName(without, allowMissingColumns=True), columns)
