import pytest

from tradewind.filters import FilterSpec
from tradewind.operators.customers import select_customers
from tradewind.operators.measures import count_customers
from tradewind.operators.value import add_customer_value

AS_OF = "2024-01-31 00:00:00"


def ids(df, key="id_customer"):
    return sorted(r[0] for r in df.select(key).collect())


CASES = [
    (dict(), [1, 2, 3, 5]),
    (dict(customer_active=False), [3]),
    (dict(newsletter=True), [1, 5]),
    (dict(newsletter=False), [2, 3]),
    (dict(optin=True), [2]),
    (dict(id_default_group=[4]), [3]),
    (dict(customer_id_lang=2), [2]),
    (dict(customer_email="ana@x.fr"), []),
    (dict(customer_email_contains="@x"), [1, 2]),
    (dict(is_prospect=True), [5]),
    (dict(is_prospect=False), [1, 2, 3, 5]),
    (dict(in_group=[1, 2]), [1, 2]),
    (dict(has_company=True), [1]),
    (dict(has_siret=True), [1]),
    (dict(has_company=False), [1, 2, 3, 5]),
    (dict(has_phone=True), [1, 3]),
    (dict(has_phone=False), [2, 5]),
    (dict(has_vat_number=True), [1]),
    (dict(has_vat_number=False, has_phone=True), [3]),
    (dict(has_postcode=False), [5]),
    (dict(has_complete_address=True), [1, 2, 3]),
    (dict(last_visit_days_ago=10), [2]),
    (dict(order_count_min=2), [1]),
    (dict(order_count_max=1), [2, 3, 5]),
    (dict(ltv_min=75.0, ltv_max=150.0), [1, 2]),
    (dict(avg_basket_min=75.0), [1, 2]),
    (dict(avg_basket_max=10.0, order_count_max=5), [3, 5]),
]


@pytest.mark.parametrize("filters, want", CASES, ids=[str(c[0]) for c in CASES])
def test_customer_filters(shop, filters, want):
    spec = FilterSpec(**filters)
    assert ids(select_customers(shop, spec, as_of=AS_OF)) == want
    assert count_customers(shop, spec, as_of=AS_OF).first().n == len(want)


def test_email_ignoring_case(shop):
    spec = FilterSpec(customer_email="ana@x.fr")
    assert ids(select_customers(shop, spec, ignore_case=True)) == [2]


def test_addresses_only_when_asked(shop):
    spec = FilterSpec(id_country=[9])
    assert ids(select_customers(shop, spec)) == [1, 2, 3, 5]
    assert ids(select_customers(shop, spec, by_address=True)) == [1, 3]


def test_value_is_zero_without_valid_orders(shop):
    rows = {r.id_customer: r for r in add_customer_value(shop["customer"], shop).collect()}
    assert (rows[3].order_count, float(rows[3].ltv), float(rows[3].avg_basket)) == (0, 0.0, 0.0)
    assert (rows[1].order_count, float(rows[1].ltv), float(rows[1].avg_basket)) == (2, 150.0, 75.0)


def test_bounded_measures_stay_as_columns(shop):
    df = select_customers(shop, FilterSpec(ltv_min=1.0))
    assert df.columns == [*shop["customer"].columns, "ltv"]
