"""The filter specification: 85 typed, optional filters.

A ``FilterSpec`` is the argument of every selection in the package.  Build it
directly with keyword arguments, or with :meth:`FilterSpec.parse` /
:meth:`FilterSpec.from_dict` from loosely typed input such as a web form or a
JSON document, in which case every value is validated against its kind.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import date, datetime
from typing import Any

ADDRESS_TYPES = ("delivery", "invoice", "both")

_NUMBER = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z")
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}\Z")


class FilterError(ValueError):
    """Raised by ``from_dict``; ``errors`` holds one message per bad filter."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def _filter(kind: str, group: str):
    return field(default=None, metadata={"kind": kind, "group": group})


@dataclass(frozen=True, kw_only=True)
class FilterSpec:
    """All filters; ``None`` means absent.  Present filters are ANDed."""

    # The names of all filters below, part of the published settings.
    # Dates (whole days, both ends inclusive), scope and id range.
    date_add_from: str | None = _filter("date", "common")
    date_add_to: str | None = _filter("date", "common")
    date_upd_from: str | None = _filter("date", "common")
    date_upd_to: str | None = _filter("date", "common")
    id_shop: int | None = _filter("int", "common")
    id_shop_multi: list | None = _filter("int_array", "common")
    id_lang: int | None = _filter("int", "common")
    id_currency: int | None = _filter("int", "common")
    id_min: int | None = _filter("int", "common")
    id_max: int | None = _filter("int", "common")
    incremental: bool | None = _filter("bool", "common")

    # Order amounts.
    total_paid_tax_incl_min: float | None = _filter("float", "amounts")
    total_paid_tax_incl_max: float | None = _filter("float", "amounts")
    total_paid_tax_excl_min: float | None = _filter("float", "amounts")
    total_paid_tax_excl_max: float | None = _filter("float", "amounts")
    total_products_min: float | None = _filter("float", "amounts")
    total_products_max: float | None = _filter("float", "amounts")
    total_shipping_min: float | None = _filter("float", "amounts")
    total_shipping_max: float | None = _filter("float", "amounts")
    total_discounts_min: float | None = _filter("float", "amounts")
    total_discounts_max: float | None = _filter("float", "amounts")

    # Order states.
    current_state: list | None = _filter("int_array", "status")
    has_had_state: list | None = _filter("int_array", "status")
    never_had_state: list | None = _filter("int_array", "status")
    order_late_days: int | None = _filter("int", "status")
    order_late_exclude_states: list | None = _filter("int_array", "status")

    # Payment and transport.
    payment: str | None = _filter("string", "payment")
    payment_contains: str | None = _filter("string", "payment")
    module: str | None = _filter("string", "payment")
    has_payment: bool | None = _filter("bool", "payment")
    id_carrier: list | None = _filter("int_array", "payment")
    free_shipping: bool | None = _filter("bool", "payment")
    has_tracking: bool | None = _filter("bool", "payment")
    has_invoice: bool | None = _filter("bool", "payment")
    has_slip: bool | None = _filter("bool", "payment")
    has_return: bool | None = _filter("bool", "payment")
    different_addresses: bool | None = _filter("bool", "payment")

    # Order lines.
    has_product: list | None = _filter("int_array", "products")
    has_product_attribute: list | None = _filter("int_array", "products")
    product_reference: str | None = _filter("string", "products")
    product_reference_contains: str | None = _filter("string", "products")
    product_ean: str | None = _filter("string", "products")
    id_manufacturer: list | None = _filter("int_array", "products")
    id_category: list | None = _filter("int_array", "products")
    has_product_discount: bool | None = _filter("bool", "products")

    # Coupons used on the order.
    has_coupon: bool | None = _filter("bool", "coupons")
    coupon_code: str | None = _filter("string", "coupons")
    coupon_code_contains: str | None = _filter("string", "coupons")
    coupon_discount_min: float | None = _filter("float", "coupons")
    coupon_discount_max: float | None = _filter("float", "coupons")
    coupon_count_min: int | None = _filter("int", "coupons")

    # Geography of the delivery or invoice address.
    address_type: str | None = _filter("string", "geo")
    id_country: list | None = _filter("int_array", "geo")
    country_iso: list | None = _filter("string_array", "geo")
    id_state: list | None = _filter("int_array", "geo")
    state_iso: list | None = _filter("string_array", "geo")
    id_zone: list | None = _filter("int_array", "geo")
    postcode: str | None = _filter("string", "geo")
    postcode_prefix: str | None = _filter("string", "geo")
    postcode_range_from: str | None = _filter("string", "geo")
    postcode_range_to: str | None = _filter("string", "geo")
    dept_code: list | None = _filter("string_array", "geo")
    region_code: list | None = _filter("string_array", "geo")

    # Customer profile.
    customer_active: bool | None = _filter("bool", "customers")
    id_default_group: list | None = _filter("int_array", "customers")
    in_group: list | None = _filter("int_array", "customers")
    newsletter: bool | None = _filter("bool", "customers")
    optin: bool | None = _filter("bool", "customers")
    is_prospect: bool | None = _filter("bool", "customers")
    customer_email: str | None = _filter("string", "customers")
    customer_email_contains: str | None = _filter("string", "customers")
    customer_id_lang: int | None = _filter("int", "customers")
    last_visit_days_ago: int | None = _filter("int", "customers")
    has_phone: bool | None = _filter("bool", "customers")
    has_postcode: bool | None = _filter("bool", "customers")
    has_complete_address: bool | None = _filter("bool", "customers")

    # Companies and customer value.
    has_company: bool | None = _filter("bool", "b2b")
    has_siret: bool | None = _filter("bool", "b2b")
    has_vat_number: bool | None = _filter("bool", "b2b")
    order_count_min: int | None = _filter("int", "b2b")
    order_count_max: int | None = _filter("int", "b2b")
    ltv_min: float | None = _filter("float", "b2b")
    ltv_max: float | None = _filter("float", "b2b")
    avg_basket_min: float | None = _filter("float", "b2b")
    avg_basket_max: float | None = _filter("float", "b2b")

    def __post_init__(self):
        if self.address_type not in (None, *ADDRESS_TYPES):
            raise FilterError([f"address_type must be one of {', '.join(ADDRESS_TYPES)}"])

    def given(self, name: str) -> Any:
        """The value when it counts as present, else ``None``.

        Zero, ``"0"``, empty text, empty lists and ``False`` are absent here:
        a bound of 0 does not filter.
        """
        value = getattr(self, name)
        if value in (None, "", "0", 0, False) or value == [] or value == ():
            return None
        return value

    def any_given(self, *names: str) -> bool:
        return any(self.given(name) is not None for name in names)

    @classmethod
    def groups(cls) -> dict[str, list[str]]:
        """Filter names by group, in declaration order."""
        out: dict[str, list[str]] = {}
        for f in fields(cls):
            out.setdefault(f.metadata["group"], []).append(f.name)
        return out

    @classmethod
    def kinds(cls) -> dict[str, str]:
        """Filter name to kind."""
        return {f.name: f.metadata["kind"] for f in fields(cls)}

    @classmethod
    def parse(cls, data: Mapping[str, Any]) -> tuple[FilterSpec, list[str]]:
        """Validate loose input; returns the usable filters and all errors.

        Unknown names are ignored, ``""`` and ``None`` are absent, a bad
        scalar is an error, and bad items of a list are dropped.
        """
        values: dict[str, Any] = {}
        errors: list[str] = []
        for name, kind in cls.kinds().items():
            raw = data.get(name)
            if raw is None or (isinstance(raw, str) and raw == ""):
                continue
            try:
                value = _READERS[kind](raw)
                if name == "address_type" and value not in ADDRESS_TYPES:
                    raise ValueError(f"must be one of {', '.join(ADDRESS_TYPES)}")
            except ValueError as problem:
                errors.append(f"{name}: {problem}")
                continue
            if value is not None:
                values[name] = value
        return cls(**values), errors

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> FilterSpec:
        spec, errors = cls.parse(data)
        if errors:
            raise FilterError(errors)
        return spec

    def to_json(self) -> str:
        """The present filters as a JSON object."""
        present = {f.name: getattr(self, f.name) for f in fields(self)}
        return json.dumps({k: v for k, v in present.items() if v is not None}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> FilterSpec:
        data = json.loads(text)
        if not isinstance(data, dict):
            raise FilterError(["filters must be a JSON object"])
        return cls.from_dict(data)


def _is_number(value: Any) -> bool:
    if isinstance(value, bool):
        return False
    if isinstance(value, float):
        return value == value and abs(value) != float("inf")
    return isinstance(value, int) or (isinstance(value, str) and bool(_NUMBER.match(value)))


def _whole(value: Any) -> int:
    try:
        return int(value)
    except ValueError:
        return int(float(value))


def _read_int(value: Any) -> int:
    if not _is_number(value) or _whole(value) < 0:
        raise ValueError("must be a non-negative integer")
    return _whole(value)


def _read_float(value: Any) -> float:
    if not _is_number(value):
        raise ValueError("must be a number")
    return float(value)


def _read_bool(value: Any) -> bool:
    return bool(value) and value != "0"


def _read_string(value: Any) -> str | None:
    if not isinstance(value, str):
        raise ValueError("must be text")
    return value.strip() or None


def _read_date(value: Any) -> str:
    if isinstance(value, date):
        return value.strftime("%Y-%m-%d")
    text = str(value)
    try:
        if not _DAY.match(text):
            raise ValueError
        datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        raise ValueError("must be a date, YYYY-MM-DD") from None
    return text


def _items(value: Any) -> list:
    if isinstance(value, (list, tuple)):
        return list(value)
    return str(value).split(",")


def _read_int_array(value: Any) -> list[int] | None:
    items = [v.strip() if isinstance(v, str) else v for v in _items(value)]
    return [_whole(v) for v in items if _is_number(v) and _whole(v) >= 0] or None


def _read_string_array(value: Any) -> list[str] | None:
    return [t for t in (str(v).strip() for v in _items(value)) if t] or None


_READERS = {
    "int": _read_int,
    "float": _read_float,
    "bool": _read_bool,
    "string": _read_string,
    "date": _read_date,
    "int_array": _read_int_array,
    "string_array": _read_string_array,
}
