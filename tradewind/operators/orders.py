"""Selection of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.operators.geo import orders_by_address
from tradewind.operators.membership import ChildTest, children_by_value, where_children
from tradewind.operators.predicates import Match, ago, between, day_range, filled
from tradewind.sources.shop import Shop

# Fixed value: the state of a delivered order, never late.
DELIVERED = 5

_AMOUNTS = {
    "total_paid_tax_incl": "total_paid_tax_incl",
    "total_paid_tax_excl": "total_paid_tax_excl",
    "total_products": "total_products",
    "total_shipping": "total_shipping_tax_incl",
    "total_discounts": "total_discounts_tax_incl",
}


def order_predicates(spec: FilterSpec, as_of=None, match: Match | None = None) -> list[Column]:
    """The filters that read only the order row itself."""
    match = match or Match()
    given = spec.given
    out: list[Column] = []

    if (shop_id := given("id_shop")) is not None:
        out.append(F.col("id_shop") == shop_id)
    elif (shops := given("id_shop_multi")) is not None:
        out.append(F.col("id_shop").isin(shops))
    out += day_range(F.col("date_add"), given("date_add_from"), given("date_add_to"))
    out += day_range(F.col("date_upd"), given("date_upd_from"), given("date_upd_to"))
    out += between(F.col("id_order"), given("id_min"), given("id_max"))
    for name in ("id_currency", "id_lang"):
        if (value := given(name)) is not None:
            out.append(F.col(name) == value)
    for name, column in _AMOUNTS.items():
        out += between(F.col(column), given(f"{name}_min"), given(f"{name}_max"))

    state = F.col("current_state")
    if (states := given("current_state")) is not None:
        out.append(state.isin(states))
    if (days := given("order_late_days")) is not None:
        finished = given("order_late_exclude_states") or [DELIVERED]
        out += [F.col("date_add") < ago(as_of, days=days), ~state.isin(finished)]

    if (payment := given("payment")) is not None:
        out.append(match.eq(F.col("payment"), payment))
    if (part := given("payment_contains")) is not None:
        out.append(match.contains(F.col("payment"), part))
    if (module := given("module")) is not None:
        out.append(match.eq(F.col("module"), module))
    if (carriers := given("id_carrier")) is not None:
        out.append(F.col("id_carrier").isin(carriers))

    shipping = F.col("total_shipping_tax_incl")
    if spec.free_shipping is not None:
        out.append(shipping == 0 if spec.free_shipping else shipping > 0)
    tracking = F.col("shipping_number")
    if spec.has_tracking is not None:
        out.append(filled(tracking) if spec.has_tracking else tracking.isNull() | (tracking == ""))
    invoice = F.col("invoice_number")
    if spec.has_invoice is not None:
        out.append(invoice > 0 if spec.has_invoice else invoice.isNull() | (invoice == 0))
    if given("different_addresses"):
        out.append(F.col("id_address_delivery") != F.col("id_address_invoice"))
    return out


def select_orders(
    shop: Shop,
    spec: FilterSpec | None = None,
    *,
    as_of=None,
    ignore_case: bool = False,
    **geo_options,
) -> DataFrame:
    """Orders that pass every filter, with all their columns.

    Child tables are read only when a filter names them, and once each.
    """
    spec = spec or FilterSpec()
    match = Match(ignore_case)
    orders = shop["orders"]
    for predicate in order_predicates(spec, as_of, match):
        orders = orders.where(predicate)

    orders = _by_history(orders, shop, spec)
    orders = _by_payment(orders, shop, spec)
    for name, table in (("has_slip", "order_slip"), ("has_return", "order_return")):
        wanted = getattr(spec, name)
        if wanted is not None:
            tests = [ChildTest(wanted=wanted)]
            orders = where_children(orders, shop[table], "id_order", tests)
    orders = _by_lines(orders, shop, spec, match)
    orders = _by_coupons(orders, shop, spec, match)
    return orders_by_address(orders, shop, spec, ignore_case=ignore_case, **geo_options)


def _by_history(orders: DataFrame, shop: Shop, spec: FilterSpec) -> DataFrame:
    tests = []
    for name, wanted in (("has_had_state", True), ("never_had_state", False)):
        if (states := spec.given(name)) is not None:
            tests.append(ChildTest(F.col("id_order_state").isin(states), wanted=wanted))
    return where_children(orders, shop["order_history"], "id_order", tests) if tests else orders


def _by_payment(orders: DataFrame, shop: Shop, spec: FilterSpec) -> DataFrame:
    """Payments name the order's reference, which orders may share."""
    if spec.has_payment is None:
        return orders
    return children_by_value(
        orders,
        shop["order_payment"],
        "reference",
        "order_reference",
        "id_order_payment",
        "left_semi" if spec.has_payment else "left_anti",
    )


def _by_lines(orders: DataFrame, shop: Shop, spec: FilterSpec, match: Match) -> DataFrame:
    given = spec.given
    tests: list[Column] = []
    if (products := given("has_product")) is not None:
        tests.append(F.col("product_id").isin(products))
    if (variants := given("has_product_attribute")) is not None:
        tests.append(F.col("product_attribute_id").isin(variants))
    if (reference := given("product_reference")) is not None:
        tests.append(match.eq(F.col("product_reference"), reference))
    if (part := given("product_reference_contains")) is not None:
        tests.append(match.contains(F.col("product_reference"), part))
    if (ean := given("product_ean")) is not None:
        tests.append(match.eq(F.col("product_ean13"), ean))
    if given("has_product_discount"):
        tests.append((F.col("reduction_percent") > 0) | (F.col("reduction_amount") > 0))

    makers, categories = given("id_manufacturer"), given("id_category")
    if not tests and makers is None and categories is None:
        return orders
    lines = shop["order_detail"]
    if makers is not None or categories is not None:
        products = shop["product"].select(
            F.col("id_product").alias("product_id"), "id_manufacturer", "id_category_default"
        )
        lines = lines.join(products, "product_id", "left")
        if makers is not None:
            tests.append(F.col("id_manufacturer").isin(makers))
        if categories is not None:
            tests.append(F.col("id_category_default").isin(categories))
    return where_children(orders, lines, "id_order", [ChildTest(t) for t in tests])


def _by_coupons(orders: DataFrame, shop: Shop, spec: FilterSpec, match: Match) -> DataFrame:
    given = spec.given
    tests = []
    if spec.has_coupon is not None:
        tests.append(ChildTest(wanted=spec.has_coupon))
    if (code := given("coupon_code")) is not None:
        tests.append(ChildTest(match.eq(F.col("code"), code)))
    if (part := given("coupon_code_contains")) is not None:
        tests.append(ChildTest(match.contains(F.col("code"), part)))
    for low, high in ((given("coupon_discount_min"), None), (None, given("coupon_discount_max"))):
        tests += [ChildTest(p) for p in between(F.col("value"), low, high)]
    if (least := given("coupon_count_min")) is not None:
        tests.append(ChildTest(at_least=least))
    if not tests:
        return orders
    used = shop["order_cart_rule"]
    if spec.any_given("coupon_code", "coupon_code_contains"):
        used = used.join(shop["cart_rule"].select("id_cart_rule", "code"), "id_cart_rule", "left")
    return where_children(orders, used, "id_order", tests)
