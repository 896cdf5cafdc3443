"""Selection of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.operators.geo import customers_by_address
from tradewind.operators.membership import ChildTest, matched, where_children
from tradewind.operators.predicates import Match, ago, between, day_range, filled
from tradewind.operators.value import where_customer_value
from tradewind.sources.shop import Shop


def customer_predicates(spec: FilterSpec, match: Match | None = None) -> list[Column]:
    """The filters that read only the customer row; deleted ones never pass."""
    match = match or Match()
    given = spec.given
    out = [F.col("deleted") == 0]
    if (shop_id := given("id_shop")) is not None:
        out.append(F.col("id_shop") == shop_id)
    out += day_range(F.col("date_add"), given("date_add_from"), given("date_add_to"))
    out += between(F.col("id_customer"), given("id_min"), given("id_max"))
    for name, column in (("customer_active", "active"), ("newsletter",) * 2, ("optin",) * 2):
        wanted = getattr(spec, name)
        if wanted is not None:
            out.append(F.col(column) == int(wanted))
    if (groups := given("id_default_group")) is not None:
        out.append(F.col("id_default_group").isin(groups))
    if (language := given("customer_id_lang")) is not None:
        out.append(F.col("id_lang") == language)
    if (email := given("customer_email")) is not None:
        out.append(match.eq(F.col("email"), email))
    if (part := given("customer_email_contains")) is not None:
        out.append(match.contains(F.col("email"), part))
    for name, column in (("has_company", "company"), ("has_siret", "siret")):
        if given(name):
            out.append(filled(F.col(column)))
    return out


def _address_tests(spec: FilterSpec) -> list[ChildTest]:
    conditions = {
        "has_phone": filled(F.col("phone")) | filled(F.col("phone_mobile")),
        "has_postcode": filled(F.col("postcode")),
        "has_vat_number": filled(F.col("vat_number")),
        "has_complete_address": filled(F.col("address1"))
        & filled(F.col("postcode"))
        & filled(F.col("city")),
    }
    return [
        ChildTest(condition, wanted=getattr(spec, name))
        for name, condition in conditions.items()
        if getattr(spec, name) is not None
    ]


def select_customers(
    shop: Shop,
    spec: FilterSpec | None = None,
    *,
    as_of=None,
    ignore_case: bool = False,
    by_address: bool = False,
    **geo_options,
) -> DataFrame:
    """Customers that pass every filter, with all their columns.

    Geographic filters concern orders; ``by_address`` applies them to the
    customers' own addresses as well.
    """
    spec = spec or FilterSpec()
    customers = shop["customer"]
    for predicate in customer_predicates(spec, Match(ignore_case)):
        customers = customers.where(predicate)

    if (groups := spec.given("in_group")) is not None:
        tests = [ChildTest(F.col("id_group").isin(groups))]
        customers = where_children(customers, shop["customer_group"], "id_customer", tests)
    if spec.given("is_prospect"):
        tests = [ChildTest(wanted=False)]
        customers = where_children(customers, shop["orders"], "id_customer", tests)
    tests = _address_tests(spec)
    if tests:
        customers = where_children(customers, shop["address"], "id_customer", tests)
    if (days := spec.given("last_visit_days_ago")) is not None:
        last = shop["connections"].groupBy("id_customer").agg(F.max("date_add").alias("_last"))
        stale = last.where(F.col("_last") < ago(as_of, days=days)).select("id_customer")
        customers = matched(customers, stale, "id_customer")
    if by_address:
        customers = customers_by_address(
            customers, shop, spec, ignore_case=ignore_case, **geo_options
        )
    return where_customer_value(customers, shop, spec)
