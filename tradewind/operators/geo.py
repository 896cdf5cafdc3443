"""Address, department and region filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.filters import FilterSpec
from tradewind.functions.cells import free_name
from tradewind.functions.geography import department_of, postcode_ranges, within_ranges
from tradewind.operators.membership import ChildTest, matched, where_children
from tradewind.operators.predicates import Match
from tradewind.sources.shop import Shop

GEO_FILTERS = (
    "id_country",
    "country_iso",
    "id_state",
    "state_iso",
    "id_zone",
    "postcode",
    "postcode_prefix",
    "dept_code",
    "region_code",
)


#: A department map of more rows is not read by the driver, and postcodes get no ranges in front.
MOST_CODES = 1000


def has_geo(spec: FilterSpec) -> bool:
    """Whether any geographic filter acts; a postcode range needs both ends."""
    return spec.any_given(*GEO_FILTERS) or _range(spec) is not None


def _range(spec: FilterSpec) -> tuple[str, str] | None:
    low, high = spec.given("postcode_range_from"), spec.given("postcode_range_to")
    return (low, high) if low and high else None


def matching_addresses(
    shop: Shop,
    spec: FilterSpec,
    *,
    ignore_case: bool = False,
    department_by_prefix: bool = False,
    country_guard: bool = False,
    corsica: bool = False,
) -> DataFrame:
    """Addresses that satisfy every geographic filter.

    Departments go through the department map, so a code the map does not
    list matches nothing; the ranges of the postcodes they can have stand in
    front, where files and row groups are skipped by them.  ``department_by_prefix`` compares the postcode's
    leading characters instead, three of them with a code of three, as the wide
    exports do.  ``country_guard`` accepts a department only in the map's own
    country, ``corsica`` reads Corsican postcodes as ``2A`` and ``2B``.
    """
    match = Match(ignore_case)
    addresses = shop["address"]
    postcode = F.col("postcode")
    given = spec.given

    if (countries := given("id_country")) is not None:
        addresses = addresses.where(F.col("id_country").isin(countries))
    if (states := given("id_state")) is not None:
        addresses = addresses.where(F.col("id_state").isin(states))
    if (code := given("postcode")) is not None:
        addresses = addresses.where(match.eq(postcode, code))
    if (prefix := given("postcode_prefix")) is not None:
        addresses = addresses.where(match.startswith(postcode, prefix))
    if (ends := _range(spec)) is not None:
        addresses = addresses.where(postcode.between(*ends))

    if spec.any_given("country_iso", "id_zone"):
        countries = shop["country"]
        if (isos := given("country_iso")) is not None:
            countries = countries.where(match.isin(F.col("iso_code"), isos))
        if (zones := given("id_zone")) is not None:
            countries = countries.where(F.col("id_zone").isin(zones))
        addresses = matched(addresses, countries.select("id_country"), "id_country")
    if (isos := given("state_iso")) is not None:
        states = shop["state"].where(match.isin(F.col("iso_code"), isos))
        addresses = matched(addresses, states.select("id_state"), "id_state")

    departments, regions = given("dept_code"), given("region_code")
    if departments is not None and department_by_prefix:
        leading = [d for d in departments if len(d) != 3]
        overseas = [d for d in departments if len(d) == 3]
        start = F.substring(postcode, 1, 2)
        if corsica:
            named = department_of(postcode, corsica)
            start = F.when(named.isin("2A", "2B"), named).otherwise(start)
        three = F.substring(postcode, 1, 3)
        addresses = addresses.where(within_ranges(postcode, postcode_ranges(departments, corsica)))
        addresses = addresses.where(start.isin(leading) | three.isin(overseas))
        if country_guard:
            code = F.when(three.isin(overseas), three).otherwise(start)
            addresses = _in_map(shop, addresses, shop.geo_map(), code, country_guard)
        departments = None
    if departments is not None or regions is not None:
        wanted = shop.geo_map()
        if departments is not None:
            wanted = wanted.where(F.col("dept_code").isin(departments))
        if regions is not None:
            wanted = wanted.where(F.col("region_code").isin(regions))
        codes = [r.dept_code for r in wanted.select("dept_code").distinct().limit(MOST_CODES + 1).collect()]
        if len(codes) <= MOST_CODES:
            addresses = addresses.where(within_ranges(postcode, postcode_ranges(codes, corsica)))
        addresses = _in_map(shop, addresses, wanted, department_of(postcode, corsica), country_guard)
    return addresses


def _in_map(
    shop: Shop, addresses: DataFrame, wanted: DataFrame, code: Column, country_guard: bool
) -> DataFrame:
    """Addresses whose department, and with a guard whose country too, is in ``wanted``."""
    columns = addresses.columns
    department = free_name("_department", columns)
    addresses = addresses.withColumn(department, code)
    keys, pairs = [department], [F.col("dept_code").alias(department)]
    if country_guard:
        iso = free_name("_country_iso", columns)
        isos = shop["country"].select("id_country", F.col("iso_code").alias(iso))
        addresses = addresses.join(isos, "id_country", "left")
        keys.append(iso)
        pairs.append(F.col("country_iso").alias(iso))
    return matched(addresses, wanted.select(*pairs), keys).select(*[f"`{c}`" for c in columns])


def orders_by_address(orders: DataFrame, shop: Shop, spec: FilterSpec, **options) -> DataFrame:
    """Orders whose delivery, invoice or either address matches.

    "Either" flags each order twice by a left join on the unique address key;
    no order is copied, and a hot address stays on the splittable left side.
    """
    if not has_geo(spec):
        return orders
    found = matching_addresses(shop, spec, **options).select("id_address")
    kind = spec.address_type or "delivery"
    if kind != "both":
        key = f"id_address_{kind}"
        return matched(orders, found.withColumnRenamed("id_address", key), key)

    columns = orders.columns
    for key in ("id_address_delivery", "id_address_invoice"):
        flags = found.select(F.col("id_address").alias(key), F.lit(True).alias(f"_{key}"))
        orders = orders.join(flags, key, "left")
    either = F.coalesce(F.col("_id_address_delivery"), F.col("_id_address_invoice"))
    return orders.where(either.isNotNull()).select(columns)


def customers_by_address(customers: DataFrame, shop: Shop, spec: FilterSpec, **options):
    """Customers with any matching address."""
    if not has_geo(spec):
        return customers
    found = matching_addresses(shop, spec, **options)
    return where_children(customers, found, "id_customer", [ChildTest()])
