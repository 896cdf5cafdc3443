import pytest

from tradewind.filters import FilterSpec
from tradewind.operators.geo import matching_addresses
from tradewind.operators.measures import count_flat, count_orders
from tradewind.operators.orders import select_orders
from tradewind.operators.wide import ENRICHED, FLAT, enriched_orders, flat_orders

AS_OF = "2024-01-31 00:00:00"


def ids(df, key="id_order"):
    return sorted(r[0] for r in df.select(key).collect())


CASES = [
    (dict(), [1, 2, 3, 4, 5]),
    (dict(date_add_to="2024-01-10", date_add_from="2024-01-10"), [1]),
    (dict(date_add_from="2024-01-11"), [2]),
    (dict(total_paid_tax_incl_min=0.0), [1, 2, 3, 4, 5]),
    (dict(total_paid_tax_incl_min=50.0, total_paid_tax_incl_max=75.0), [2, 3]),
    (dict(id_shop=2, id_shop_multi=[1]), [5]),
    (dict(id_shop_multi=[1]), [1, 2, 3, 4]),
    (dict(current_state=[2, 5]), [1, 2, 5]),
    (dict(order_late_days=10), [2, 4, 5]),
    (dict(order_late_days=10, order_late_exclude_states=[2]), [1, 4]),
    (dict(has_had_state=[6]), [3]),
    (dict(never_had_state=[6]), [1, 2, 4, 5]),
    (dict(has_had_state=[2], never_had_state=[5]), [2]),
    (dict(has_payment=True), [1, 2, 3]),
    (dict(has_payment=False), [4, 5]),
    (dict(payment_contains="0%"), [3]),
    (dict(payment_contains="C_rte"), []),
    (dict(free_shipping=True), [1, 3, 4, 5]),
    (dict(free_shipping=False), [2]),
    (dict(has_tracking=True), [3]),
    (dict(has_tracking=False), [1, 2, 4, 5]),
    (dict(has_invoice=True), [3]),
    (dict(has_invoice=False), [1, 2, 4, 5]),
    (dict(different_addresses=True), [2, 3]),
    (dict(different_addresses=False), [1, 2, 3, 4, 5]),
    (dict(has_slip=True), [1, 3, 4]),
    (dict(has_return=True), [3]),
    (dict(has_product=[100]), [1]),
    (dict(has_product_attribute=[1]), [1]),
    (dict(product_reference="REF_1"), [1]),
    (dict(product_reference_contains="REF_"), [1]),
    (dict(product_reference_contains="REF"), [1, 2]),
    (dict(product_ean="222"), [2]),
    (dict(has_product_discount=True), [1]),
    (dict(has_product=[100], product_reference="REFX2"), []),
    (dict(id_manufacturer=[7]), [1, 3]),
    (dict(id_category=[80]), [2]),
    (dict(id_manufacturer=[7], product_reference_contains="O"), [3]),
    (dict(has_coupon=True), [1, 2, 4]),
    (dict(has_coupon=False), [3, 5]),
    (dict(coupon_code="NOEL_10"), [1, 2]),
    (dict(coupon_code_contains="E20"), [1]),
    (dict(coupon_discount_min=8.0), [1, 4]),
    (dict(coupon_discount_max=4.0), [2]),
    (dict(coupon_discount_min=10.0, coupon_discount_max=5.0), [1]),
    (dict(coupon_count_min=2), [1]),
    (dict(coupon_count_min=1, coupon_code="ETE20"), [1]),
    (dict(has_coupon=False, coupon_code="ETE20"), []),
    (dict(id_country=[9]), [4]),
    (dict(id_country=[9], address_type="invoice"), [2, 4]),
    (dict(id_country=[9], address_type="both"), [2, 4]),
    (dict(id_country=[8], address_type="both"), [1, 2, 3]),
    (dict(country_iso=["BE"], address_type="both", postcode_prefix="01"), [2]),
    (dict(id_zone=[2]), [4]),
    (dict(state_iso=["BB"], address_type="both"), [2]),
    (dict(postcode="75001"), [1, 2]),
    (dict(postcode_range_from="75002", postcode_range_to="80000"), [4]),
    (dict(postcode_range_from="75002"), [1, 2, 3, 4, 5]),
    (dict(dept_code=["75"]), [1, 2, 4]),
    (dict(dept_code=["974"]), [3]),
    (dict(dept_code=["20"], address_type="invoice"), []),
    (dict(dept_code=["01"], address_type="invoice"), [2]),
    (dict(region_code=["IDF", "REU"]), [1, 2, 3, 4]),
    (dict(dept_code=["75", "974"], region_code=["REU"]), [3]),
]


@pytest.mark.parametrize("filters, want", CASES, ids=[str(c[0]) for c in CASES])
def test_order_filters(shop, filters, want):
    assert ids(select_orders(shop, FilterSpec(**filters), as_of=AS_OF)) == want


@pytest.mark.parametrize(
    "name",
    ["has_payment", "free_shipping", "has_tracking", "has_invoice", "has_slip", "has_return",
     "has_coupon"],
)
def test_both_answers_cover_everything(shop, name):
    yes = ids(select_orders(shop, FilterSpec(**{name: True})))
    no = ids(select_orders(shop, FilterSpec(**{name: False})))
    assert sorted(yes + no) == [1, 2, 3, 4, 5]


def test_unknown_state_is_never_late(shop):
    late = select_orders(shop, FilterSpec(order_late_days=1), as_of=AS_OF)
    assert 3 not in ids(late)


def test_ignore_case(shop):
    spec = FilterSpec(payment="carte", coupon_code="noel_10")
    assert ids(select_orders(shop, spec)) == []
    assert ids(select_orders(shop, spec, ignore_case=True)) == [1, 2]


def test_corsica_and_country_guard(shop):
    spec = FilterSpec(region_code=["COR"], address_type="invoice")
    assert ids(select_orders(shop, spec)) == []
    assert ids(select_orders(shop, spec, corsica=True)) == [3]
    paris = FilterSpec(dept_code=["75"])
    assert ids(matching_addresses(shop, paris), "id_address") == [10, 14]
    assert ids(matching_addresses(shop, paris, country_guard=True), "id_address") == [10]


def test_column_order_is_kept(shop):
    spec = FilterSpec(
        has_payment=True, has_product=[100], id_country=[8], address_type="both", has_slip=True
    )
    assert select_orders(shop, spec).columns == shop["orders"].columns


def test_enriched_has_one_row_per_order_and_labels_in_one_language(shop):
    rows = {r.id_order: r for r in enriched_orders(shop, label_lang=2).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and len(ENRICHED) == 36
    assert rows[1].delivery_country == "Frankreich" and rows[1].order_status_name == "Delivered"
    assert rows[2].invoice_country is None and rows[2].order_status_name is None
    assert rows[5].customer_email is None and rows[5].delivery_city is None


def test_flat_keeps_orders_without_lines(shop):
    df = flat_orders(shop)
    assert df.columns == list(FLAT) and len(FLAT) == 39
    rows = df.collect()
    assert sorted(r.id_order for r in rows) == [1, 1, 1, 2, 3, 4, 5]
    assert {r.id_order for r in rows if r.product_id is None} == {4, 5}
    assert {r.customer_id for r in rows if r.id_order == 5} == {None}


@pytest.mark.parametrize("filters", [{}, {"has_product": [100]}, {"has_coupon": False},
                                     {"current_state": [77]}])
def test_flat_count_is_the_number_of_flat_rows(shop, filters):
    spec = FilterSpec(**filters)
    assert count_flat(shop, spec).first().n == flat_orders(shop, spec).count()
    assert count_orders(shop, spec).first().n == enriched_orders(shop, spec).count()


def test_wide_departments_compare_the_prefix(shop):
    spec = FilterSpec(dept_code=["20"], address_type="invoice")
    assert ids(enriched_orders(shop, spec)) == [3]
    assert ids(enriched_orders(shop, FilterSpec(dept_code=["97"]))) == [3]
    assert ids(enriched_orders(shop, FilterSpec(dept_code=["974"]))) == [3]
