"""The known tables, how they hang together, and at which level they export."""

from __future__ import annotations

from dataclasses import dataclass

# Each level includes the ones before it.
LEVELS = ("essential", "complete", "ultra")
TYPES = ("customers", "orders", "full")
MODES = ("relational", "enriched", "flat")


@dataclass(frozen=True)
class Entity:
    """One exported table.

    A child names its parent table, its own foreign key and, when that is not
    the parent's primary key, the parent column it refers to.
    """

    name: str
    side: str
    level: str
    pk: str | None
    parent: str | None = None
    fk: str | None = None
    parent_key: str | None = None
    custom: bool = False

    @property
    def is_root(self) -> bool:
        return self.parent is None


def _customers(name, level, pk, parent="customer", fk="id_customer"):
    return Entity(name, "customers", level, pk, parent, fk)


def _orders(name, level, pk, parent="orders", fk="id_order", parent_key=None):
    return Entity(name, "orders", level, pk, parent, fk, parent_key)


# Fixed values, in dependency order: a parent always precedes its children.
_TREE = [
    Entity("customer", "customers", "essential", "id_customer"),
    _customers("address", "essential", "id_address"),
    _customers("customer_group", "complete", None),
    _customers("cart", "ultra", "id_cart"),
    _customers("customer_thread", "ultra", "id_customer_thread"),
    _customers("connections", "ultra", "id_connections"),
    _customers("guest", "ultra", "id_guest"),
    _customers("cart_product", "ultra", None, "cart", "id_cart"),
    _customers(
        "customer_message", "ultra", "id_customer_message", "customer_thread", "id_customer_thread"
    ),
    Entity("orders", "orders", "essential", "id_order"),
    _orders("order_detail", "essential", "id_order_detail"),
    _orders("order_history", "complete", "id_order_history"),
    _orders(
        "order_payment",
        "complete",
        "id_order_payment",
        fk="order_reference",
        parent_key="reference",
    ),
    _orders("order_carrier", "complete", "id_order_carrier"),
    _orders("order_invoice", "complete", "id_order_invoice"),
    _orders("order_slip", "complete", "id_order_slip"),
    _orders("order_cart_rule", "complete", "id_order_cart_rule"),
    _orders("order_return", "ultra", "id_order_return"),
    _orders("order_message", "ultra", "id_order_message"),
    _orders("message", "ultra", "id_message"),
    _orders("order_invoice_payment", "ultra", None, "order_invoice", "id_order_invoice"),
    _orders("order_slip_detail", "ultra", "id_order_slip_detail", "order_slip", "id_order_slip"),
    _orders("order_return_detail", "ultra", None, "order_return", "id_order_return"),
]
ENTITIES = {e.name: e for e in _TREE}

ROOT_KEYS = {"customers": ("customer", "id_customer"), "orders": ("orders", "id_order")}

# Dimension tables, their key, and whether a "<name>_lang" table
# holds their labels.
REFERENCE_TABLES = {
    "country": ("id_country", True),
    "state": ("id_state", False),
    "zone": ("id_zone", False),
    "group": ("id_group", True),
    "carrier": ("id_carrier", True),
    "order_state": ("id_order_state", True),
    "cart_rule": ("id_cart_rule", True),
    "currency": ("id_currency", False),
    "lang": ("id_lang", False),
}

# The columns these tables have in every shop.
NATIVE_COLUMNS = {
    "customer": """
        id_customer id_shop_group id_shop id_gender id_default_group id_lang id_risk company
        siret ape firstname lastname email passwd last_passwd_gen birthday newsletter
        ip_registration_newsletter newsletter_date_add optin website outstanding_allow_amount
        show_public_prices max_payment_days secure_key note active is_guest deleted date_add
        date_upd reset_password_token reset_password_validity
    """.split(),
    "address": """
        id_address id_country id_state id_customer id_manufacturer id_supplier id_warehouse alias
        company lastname firstname address1 address2 postcode city other phone phone_mobile
        vat_number dni date_add date_upd active deleted
    """.split(),
    "orders": """
        id_order reference id_shop_group id_shop id_carrier id_lang id_customer id_cart
        id_currency id_address_delivery id_address_invoice current_state secure_key payment
        conversion_rate module recyclable gift gift_message mobile_theme shipping_number
        total_discounts total_discounts_tax_incl total_discounts_tax_excl total_paid
        total_paid_tax_incl total_paid_tax_excl total_paid_real total_products total_products_wt
        total_shipping total_shipping_tax_incl total_shipping_tax_excl carrier_tax_rate
        total_wrapping total_wrapping_tax_incl total_wrapping_tax_excl round_mode round_type
        invoice_number delivery_number invoice_date delivery_date valid date_add date_upd
    """.split(),
    "order_detail": """
        id_order_detail id_order id_order_invoice id_warehouse id_shop product_id
        product_attribute_id id_customization product_name product_quantity
        product_quantity_in_stock product_quantity_refunded product_quantity_return
        product_quantity_reinjected product_quantity_discount product_price reduction_percent
        reduction_amount reduction_amount_tax_incl reduction_amount_tax_excl group_reduction
        product_ean13 product_isbn product_upc product_mpn product_reference
        product_supplier_reference product_weight id_tax_rules_group tax_computation_method
        tax_name tax_rate ecotax ecotax_tax_rate discount_quantity_applied download_hash
        download_nb download_deadline total_price_tax_incl total_price_tax_excl
        unit_price_tax_incl unit_price_tax_excl total_shipping_price_tax_incl
        total_shipping_price_tax_excl purchase_supplier_price original_product_price
        original_wholesale_price total_refunded_tax_excl total_refunded_tax_incl
    """.split(),
}


def sides(export_type: str) -> tuple[str, ...]:
    if export_type not in TYPES:
        raise ValueError(f"export type must be one of {', '.join(TYPES)}")
    return ("customers", "orders") if export_type == "full" else (export_type,)


def planned_entities(
    available, export_type: str = "full", level: str = "essential", custom: dict | None = None
) -> list[Entity]:
    """Entities to export, parents first, limited to the available tables.

    An unknown level means ``essential``.  A child whose parent table is not
    available cannot be selected and is left out.  ``custom`` maps the name of
    a shop's own table to the root key it carries.
    """
    depth = LEVELS.index(level) if level in LEVELS else 0
    plan: list[Entity] = []
    for e in ENTITIES.values():
        wanted = e.side in sides(export_type) and LEVELS.index(e.level) <= depth
        reachable = e.is_root or e.parent in {p.name for p in plan}
        if wanted and reachable and e.name in available:
            plan.append(e)
    for side in sides(export_type):
        root, key = ROOT_KEYS[side]
        if root not in available:
            continue
        plan += [
            Entity(name, side, level, None, root, key, custom=True)
            for name, fk in (custom or {}).items()
            if fk == key
        ]
    return plan


def dependency_order(entities: list[Entity]) -> list[Entity]:
    """Roots, then their children, then the children of children."""
    roots = {e.name for e in entities if e.is_root}
    rank = {e.name: 0 if e.is_root else 1 if e.parent in roots else 2 for e in entities}
    return sorted(entities, key=lambda e: rank[e.name])
