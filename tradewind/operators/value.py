"""Customer value: number of valid orders, lifetime value, average basket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.operators.predicates import between
from tradewind.sources.shop import Shop

MEASURES = {
    "order_count": ("order_count_min", "order_count_max"),
    "ltv": ("ltv_min", "ltv_max"),
    "avg_basket": ("avg_basket_min", "avg_basket_max"),
}


def add_customer_value(customers: DataFrame, shop: Shop, measures=tuple(MEASURES)) -> DataFrame:
    """Add the measures; customers without a valid order get zeros.

    One aggregate serves all three.  Money is summed as decimal, so the result
    does not depend on the order in which tasks finish.
    """
    paid = F.col("total_paid_tax_incl").cast("decimal(20,6)")
    measure = {"order_count": F.count("*"), "ltv": F.sum(paid), "avg_basket": F.avg(paid)}
    values = (
        shop["orders"]
        .where(F.col("valid") == 1)
        .groupBy("id_customer")
        .agg(*[measure[m].alias(m) for m in measures])
    )
    return customers.join(values, "id_customer", "left").select(
        *customers.columns, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures]
    )


def where_customer_value(customers: DataFrame, shop: Shop, spec: FilterSpec) -> DataFrame:
    """Apply the value bounds; measures that have a bound stay as columns."""
    wanted = [m for m, bounds in MEASURES.items() if spec.any_given(*bounds)]
    if not wanted:
        return customers
    customers = add_customer_value(customers, shop, wanted)
    for m in wanted:
        low, high = (spec.given(b) for b in MEASURES[m])
        for predicate in between(F.col(m), low, high):
            customers = customers.where(predicate)
    return customers
