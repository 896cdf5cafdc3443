"""The same results in plain SQL, written apart from the operators.

Existence is a correlated EXISTS here, values are correlated aggregates, and
wide rows are one chain of outer joins.
"""

from __future__ import annotations

import re

from tradewind.functions.geomap import DEPARTMENTS, REGIONS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GEO_ROWS = ", ".join(
    f"('FR', {_quote(code)}, {_quote(name)}, {_quote(region)}, {_quote(REGIONS[region])})"
    for code, name, region in DEPARTMENTS
)

# Shop tables over the sample tables.
VIEWS = {
    "s_orders": """
        SELECT o_orderkey AS id_order, 'R' || o_orderkey AS reference,
               o_custkey % 3 + 1 AS id_shop, o_custkey % 7 + 1 AS id_carrier,
               o_orderkey % 2 + 1 AS id_lang, o_custkey AS id_customer,
               o_custkey % 4 + 1 AS id_currency, o_custkey AS id_address_delivery,
               o_custkey + o_orderkey % 3 AS id_address_invoice,
               o_orderstatus AS current_state, o_orderpriority AS payment,
               lower(substr(o_orderpriority, 3)) AS module,
               CASE WHEN o_orderkey % 3 = 1 THEN '' WHEN o_orderkey % 3 = 2
                    THEN 'T' || o_orderkey END AS shipping_number,
               CAST(o_orderkey % 50 AS DOUBLE) AS total_discounts_tax_incl,
               o_totalprice AS total_paid_tax_incl,
               o_totalprice * CAST(0.8 AS DOUBLE) AS total_paid_tax_excl,
               o_totalprice * CAST(0.75 AS DOUBLE) AS total_products,
               CAST(o_orderkey % 5 AS DOUBLE) AS total_shipping_tax_incl,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0
                    ELSE o_orderkey END AS invoice_number,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS valid,
               o_orderdate AS date_add, o_orderdate + INTERVAL 2 DAY AS date_upd
        FROM orders""",
    "s_detail": """
        SELECT l_orderkey * 8 + l_linenumber AS id_order_detail, l_orderkey AS id_order,
               l_partkey AS product_id, l_linenumber AS product_attribute_id,
               'Part ' || l_partkey AS product_name,
               'P' || l_partkey || '-' || l_returnflag AS product_reference,
               lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS product_ean13,
               CAST(l_quantity AS BIGINT) AS product_quantity,
               CASE WHEN l_discount >= CAST(0.09 AS DOUBLE) THEN l_discount * 100
                    ELSE 0 END AS reduction_percent,
               CAST(CASE WHEN l_quantity >= 49 THEN 5.0 ELSE 0.0 END AS DOUBLE)
                   AS reduction_amount,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_price_tax_incl,
               l_extendedprice * (1 - l_discount) AS total_price_tax_excl
        FROM lineitem""",
    "s_customer": """
        SELECT c_custkey AS id_customer, c_custkey % 3 + 1 AS id_shop,
               c_mktsegment AS id_default_group, c_custkey % 2 + 1 AS id_lang,
               CASE WHEN c_custkey % 3 = 1 THEN '' WHEN c_custkey % 3 = 2 THEN c_name END
                   AS company,
               CASE WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 > 1
                    THEN lpad(CAST(c_custkey AS VARCHAR), 14, '0') END AS siret,
               substr(c_name, 1, 8) AS firstname, substr(c_name, 10) AS lastname,
               'c' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS email,
               'pw' || c_custkey AS passwd, c_custkey % 2 AS newsletter,
               CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS optin,
               'key' || c_custkey AS secure_key,
               CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS active,
               CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS deleted,
               TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS date_add,
               c_acctbal AS acctbal, c_nationkey AS home_nation
        FROM customer""",
    "s_address": """
        SELECT c_custkey AS id_address, c_nationkey AS id_country, c_nationkey AS id_state,
               c_custkey AS id_customer,
               CASE WHEN c_custkey % 3 = 1 THEN '' WHEN c_custkey % 3 = 2 THEN c_name END
                   AS company,
               substr(c_name, 10) AS lastname, substr(c_name, 1, 8) AS firstname,
               (c_custkey % 300) || ' rue du Port' AS address1,
               CASE WHEN c_custkey % 2 = 1 THEN 'Escalier B' END AS address2,
               lpad(CAST(c_custkey * 67 % 99000 AS VARCHAR), 5, '0') AS postcode,
               CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Ville ' || c_nationkey END AS city,
               CASE WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 > 1
                    THEN '06 ' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
               CASE WHEN c_custkey % 6 = 0 THEN '+33' || c_custkey END AS phone_mobile,
               CASE WHEN c_custkey % 5 = 0 THEN 'FR' || c_custkey
                    WHEN c_custkey % 5 = 1 THEN '' END AS vat_number
        FROM customer""",
    "s_country": """
        SELECT n_nationkey AS id_country, substr(n_name, 8) AS iso_code,
               n_regionkey AS id_zone FROM nation""",
    "s_country_lang": """
        SELECT n_nationkey AS id_country, 1 AS id_lang, n_name AS name FROM nation
        UNION ALL SELECT n_nationkey, 2, n_name FROM nation""",
    "s_state_lang": """
        SELECT * FROM (VALUES ('F', 1, 'Livrée'), ('O', 1, 'Ouverte'), ('P', 1, 'En cours'),
                              ('F', 2, 'Delivered'), ('O', 2, 'Open'))
        AS t(id_order_state, id_lang, name)""",
    "s_history": """
        SELECT event_id // 3 AS id_order, event_type AS id_order_state FROM events""",
    "s_payment": """
        SELECT l_orderkey * 8 + l_linenumber AS id_order_payment,
               'R' || l_orderkey AS order_reference, l_extendedprice AS amount
        FROM lineitem WHERE l_linestatus = 'F'""",
    "s_coupon": """
        SELECT l_orderkey * 8 + l_linenumber AS id_order_cart_rule, l_orderkey AS id_order,
               l_partkey AS id_cart_rule, l_extendedprice * l_discount AS value
        FROM lineitem WHERE l_discount >= CAST(0.08 AS DOUBLE)""",
    "s_cart_rule": "SELECT p_partkey AS id_cart_rule, p_brand AS code FROM part",
    "s_cart_rule_lang": """
        SELECT p_partkey AS id_cart_rule, l AS id_lang, p_name AS name
        FROM part, (VALUES (1), (2)) AS t(l)""",
    "s_carrier": "SELECT s_suppkey AS id_carrier, s_name AS name FROM supplier",
    "s_carrier_lang": """
        SELECT s_suppkey AS id_carrier, l AS id_lang, s_name AS delay
        FROM supplier, (VALUES (1), (2)) AS t(l)""",
    "s_state": "SELECT n_nationkey AS id_state, 'S' || n_nationkey AS iso_code FROM nation",
    "s_currency": "SELECT r_regionkey AS id_currency, r_name AS name FROM region",
    "s_lang": "SELECT r_regionkey AS id_lang, r_name AS name FROM region",
    "s_group": "SELECT DISTINCT o_orderpriority AS id_group, CAST(0 AS DOUBLE) AS reduction FROM orders",
    "s_group_lang": """
        SELECT DISTINCT o_orderpriority AS id_group, 2 AS id_lang,
               substr(o_orderpriority, 3) AS name FROM orders""",
    "s_order_state": """
        SELECT DISTINCT event_type AS id_order_state, length(event_type) AS position FROM events""",
    "s_full_history": """
        SELECT event_id AS id_order_history, event_id // 3 AS id_order,
               event_type AS id_order_state FROM events""",
    "s_order_carrier": """
        SELECT o_orderkey AS id_order_carrier, o_orderkey AS id_order,
               o_custkey % 7 + 1 AS id_carrier FROM orders WHERE o_orderstatus <> 'P'""",
    "s_invoice": """
        SELECT o_orderkey AS id_order_invoice, o_orderkey AS id_order, o_totalprice AS total
        FROM orders WHERE o_orderstatus = 'F'""",
    "s_invoice_payment": """
        SELECT l_orderkey AS id_order_invoice, l_orderkey * 8 + l_linenumber AS id_order_payment
        FROM lineitem WHERE l_linestatus = 'F'""",
    "s_slip_detail": """
        SELECT l_partkey AS id_order_slip_detail, l_orderkey * 8 + l_linenumber AS id_order_slip,
               l_quantity AS product_quantity FROM lineitem""",
    "s_full_return": """
        SELECT l_orderkey * 8 + l_linenumber AS id_order_return, l_orderkey AS id_order
        FROM lineitem WHERE l_returnflag = 'R'""",
    "s_return_detail": """
        SELECT l_orderkey * 8 + l_linenumber AS id_order_return, l_partkey AS id_order_detail,
               CAST(l_quantity AS BIGINT) AS product_quantity
        FROM lineitem WHERE l_returnflag = 'R'""",
    "s_message": "SELECT doc_id AS id_message, doc_id AS id_order, text AS message FROM documents",
    "s_order_message": """
        SELECT conv_id AS id_order_message, conv_id AS id_order, role AS name
        FROM conversations WHERE turn = 1""",
    "s_customer_group": "SELECT o_custkey AS id_customer, o_orderpriority AS id_group FROM orders",
    "s_cart": "SELECT o_orderkey AS id_cart, o_custkey AS id_customer FROM orders",
    "s_cart_product": """
        SELECT l_orderkey AS id_cart, l_partkey AS id_product, l_quantity AS quantity
        FROM lineitem""",
    "s_thread": """
        SELECT conv_id AS id_customer_thread, conv_id AS id_customer
        FROM conversations WHERE turn = 0""",
    "s_customer_message": """
        SELECT conv_id * 1000 + turn AS id_customer_message, conv_id AS id_customer_thread,
               text AS message FROM conversations""",
    "s_connections": """
        SELECT event_id AS id_connections, user_id AS id_customer, ts AS date_add
        FROM events WHERE event_type = 'purchase'""",
    "s_guest": """
        SELECT event_id AS id_guest, user_id AS id_customer, ts AS date_add
        FROM events WHERE event_type = 'view'""",
    "s_loyalty": """
        SELECT event_id AS id_loyalty, user_id AS id_customer, value AS points
        FROM events WHERE event_type = 'signup'""",
    "s_slip": """
        SELECT l_orderkey * 8 + l_linenumber AS id_order_slip, l_orderkey AS id_order
        FROM lineitem WHERE l_returnflag = 'A'""",
    "s_return": "SELECT l_orderkey AS id_order FROM lineitem WHERE l_returnflag = 'R'",
    "s_job": """
        SELECT o_orderkey AS id_export_job, o_custkey AS id_employee,
               CASE WHEN o_orderstatus = 'F' THEN 'completed'
                    WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status,
               o_orderdate AS date_add, o_orderdate + INTERVAL 2 DAY AS date_upd
        FROM orders""",
    "s_file": """
        SELECT l_orderkey * 8 + l_linenumber AS id_export_file, l_orderkey AS id_export_job,
               'entity_' || l_linenumber AS entity_name, l_shipdate AS download_expires
        FROM lineitem""",
    "geo_map": f"""
        SELECT * FROM (VALUES {_GEO_ROWS})
        AS t(country_iso, dept_code, dept_name, region_code, region_name)""",
}


def _sql(body: str) -> str:
    """The body with the views it names, directly or through another one."""
    names: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in names and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                names.append(name)

    add(body)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {views}\n{body}" if names else body


def _orders(where: str) -> str:
    return f"""
        SELECT id_order, id_customer, current_state, total_paid_tax_incl
        FROM s_orders o WHERE {where}"""


def _customers(where: str) -> str:
    return f"""
        SELECT id_customer, id_default_group, email, active
        FROM s_customer c WHERE c.deleted = 0 AND {where}"""


def _line(where: str) -> str:
    return f"EXISTS (SELECT 1 FROM s_detail d WHERE d.id_order = o.id_order AND ({where}))"


def _coupon(where: str) -> str:
    return f"""EXISTS (SELECT 1 FROM s_coupon u JOIN s_cart_rule r USING (id_cart_rule)
                       WHERE u.id_order = o.id_order AND {where})"""


def _had(states: str) -> str:
    return f"""EXISTS (SELECT 1 FROM s_history h WHERE h.id_order = o.id_order
                       AND h.id_order_state IN ({states}))"""


def _delivered(where: str, extra: str = "", key: str = "id_address_delivery") -> str:
    return f"""EXISTS (SELECT 1 FROM s_address a {extra}
                       WHERE a.id_address = o.{key} AND {where})"""


def _home(where: str) -> str:
    return f"EXISTS (SELECT 1 FROM s_address a WHERE a.id_customer = c.id_customer AND ({where}))"


_DEPARTMENT = """left(a.postcode, CASE WHEN left(a.postcode, 2) IN ('97', '98')
                 THEN 3 ELSE 2 END)"""
_MAP = f"JOIN geo_map g ON g.dept_code = {_DEPARTMENT}"
_COUNTRY = "JOIN s_country k ON k.id_country = a.id_country"
_PERIOD = "o.date_add >= '1997-01-01' AND o.date_add < '1999-01-01'"
_WIDE = "o.date_add >= '1997-01-01' AND o.date_add < '2000-01-01' AND o.current_state <> 'O'"
_DISCOUNTED = _line("d.reduction_percent > 0 OR d.reduction_amount > 0")
_RETURNED = "EXISTS (SELECT 1 FROM s_return x WHERE x.id_order = o.id_order)"
_SLIPPED = "EXISTS (SELECT 1 FROM s_slip x WHERE x.id_order = o.id_order)"
_PAID = "EXISTS (SELECT 1 FROM s_payment p WHERE p.order_reference = o.reference)"
_FILTERED = f"o.date_add >= '1998-01-01' AND {_DISCOUNTED} AND {_RETURNED}"
_ACTIVE = "c.deleted = 0 AND c.active = 1 AND c.company <> ''"
_PHONE = "a.phone <> '' OR a.phone_mobile <> ''"
_COMPLETE = "a.address1 <> '' AND a.postcode <> '' AND a.city <> ''"


def _wide_joins(language: int, lines: bool) -> str:
    return f"""
        FROM s_orders o
        {"LEFT JOIN s_detail d ON d.id_order = o.id_order" if lines else ""}
        LEFT JOIN s_customer c ON c.id_customer = o.id_customer
        LEFT JOIN s_address ad ON ad.id_address = o.id_address_delivery
        LEFT JOIN s_address ai ON ai.id_address = o.id_address_invoice
        LEFT JOIN s_country_lang kd ON kd.id_country = ad.id_country AND kd.id_lang = {language}
        LEFT JOIN s_country_lang ki ON ki.id_country = ai.id_country AND ki.id_lang = {language}
        LEFT JOIN s_state_lang st
            ON st.id_order_state = o.current_state AND st.id_lang = {language}"""


def _address(prefix: str, alias: str, country: str, mobile: bool = False) -> str:
    names = ["company", "firstname", "lastname", "address1", "address2", "postcode", "city"]
    names += ["phone", "phone_mobile"] if mobile else ["phone"]
    columns = [f"{alias}.{n} AS {prefix}_{n}" for n in names]
    return ", ".join([*columns, f"{country}.name AS {prefix}_country"])


def _enriched(language: int, where: str) -> str:
    return f"""
        SELECT o.id_order, o.reference, o.id_customer, o.current_state, o.payment,
               o.total_paid_tax_incl, o.total_paid_tax_excl, o.total_products,
               o.total_shipping_tax_incl, o.date_add, o.valid, st.name AS order_status_name,
               c.email AS customer_email, c.firstname AS customer_firstname,
               c.lastname AS customer_lastname, c.company AS customer_company,
               c.siret AS customer_siret,
               {_address("delivery", "ad", "kd", mobile=True)}, {_address("invoice", "ai", "ki")}
        {_wide_joins(language, lines=False)} WHERE {where}"""


def _flat(language: int, where: str) -> str:
    return f"""
        SELECT o.id_order, o.reference AS order_reference, o.date_add AS order_date,
               st.name AS order_status, o.payment AS payment_method, o.total_paid_tax_incl,
               o.total_paid_tax_excl, o.total_products,
               o.total_shipping_tax_incl AS total_shipping, c.id_customer AS customer_id,
               c.email AS customer_email, c.firstname AS customer_firstname,
               c.lastname AS customer_lastname, c.company AS customer_company,
               c.newsletter AS customer_newsletter,
               {_address("delivery", "ad", "kd")}, {_address("invoice", "ai", "ki")},
               d.product_id, d.product_name, d.product_reference, d.product_quantity,
               d.total_price_tax_incl AS product_price_tax_incl,
               d.total_price_tax_excl AS product_price_tax_excl
        {_wide_joins(language, lines=True)} WHERE {where}"""


def _value(outer: str) -> str:
    """Values in whole cents, so that the average rounds exactly."""
    return f"""
        SELECT {outer} FROM (
            SELECT c.id_customer, c.deleted,
                   (SELECT count(*) FROM s_orders o
                    WHERE o.id_customer = c.id_customer AND o.valid = 1) AS order_count,
                   (SELECT coalesce(sum(CAST(round(o.total_paid_tax_incl * 100) AS BIGINT)), 0)
                    FROM s_orders o
                    WHERE o.id_customer = c.id_customer AND o.valid = 1) AS cents
            FROM s_customer c) v"""


_ENRICHED_NAMES = """id_order reference id_customer current_state payment total_paid_tax_incl
    total_paid_tax_excl total_products total_shipping_tax_incl date_add valid order_status_name
    customer_email customer_firstname customer_lastname customer_company customer_siret
    delivery_company delivery_firstname delivery_lastname delivery_address1 delivery_address2
    delivery_postcode delivery_city delivery_country delivery_phone delivery_phone_mobile
    invoice_company invoice_firstname invoice_lastname invoice_address1 invoice_address2
    invoice_postcode invoice_city invoice_country invoice_phone""".split()
_FLAT_NAMES = """id_order order_reference order_date order_status payment_method
    total_paid_tax_incl total_paid_tax_excl total_products total_shipping customer_id
    customer_email customer_firstname customer_lastname customer_company customer_newsletter
    delivery_firstname delivery_lastname delivery_company delivery_address1 delivery_address2
    delivery_postcode delivery_city delivery_country delivery_phone invoice_firstname
    invoice_lastname invoice_company invoice_address1 invoice_address2 invoice_postcode
    invoice_city invoice_country invoice_phone product_id product_name product_reference
    product_quantity product_price_tax_incl product_price_tax_excl""".split()


_LTV = "cents / 100.0"
_BASKET = """CASE WHEN order_count = 0 THEN 0
             ELSE ((2 * cents + order_count) // (2 * order_count)) / 100.0 END"""


def _email(text: str) -> str:
    return f"""CASE WHEN length({text}) - length(replace({text}, '@', '')) = 1
        THEN substr(split_part({text}, '@', 1), 1, 2) || '***' ||
             substr(sha256(split_part({text}, '@', 1)), 1, 8) || '@' || split_part({text}, '@', 2)
        ELSE substr(sha256({text}), 1, 16) || '@anonymized.local' END"""


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9+]', '', 'g')"


def _phone(text: str) -> str:
    d = _digits(text)
    return f"""CASE WHEN length({d}) <= 4 THEN '****'
        ELSE left({d}, 2) || repeat('*', length({d}) - 4) || right({d}, 2) END"""


def _hash(text: str) -> str:
    return f"substr(sha256({text}), 1, 16)"


def _unless_empty(text: str, masked: str) -> str:
    return f"CASE WHEN {text} IN ('', '0') THEN {text} WHEN {text} IS NOT NULL THEN {masked} END"


_CONTROL = r"'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]'"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, {_CONTROL}, '', 'g')"


def _guard(text: str) -> str:
    return f"""CASE WHEN left({text}, 1) IN ('=', '+', '-', '@', chr(9), chr(10), chr(13))
        THEN '''' || {text} ELSE {text} END"""


def _text(column: str) -> str:
    """A cell as it stands in a file: plain digits, no formula, nothing for NULL."""
    t = f"coalesce(CAST({column} AS VARCHAR), '')"
    plain = f"""(CASE WHEN regexp_full_match({t}, '-?[0-9](\\.[0-9]+)?e[-+][0-9]+')
        THEN rtrim(CAST(CAST({t} AS DECIMAL(38, 20)) AS VARCHAR), '0') ELSE {t} END)"""
    return _guard(plain)


def _cells(entity: str, view: str, columns: str, where: str = "true") -> str:
    """``entity, row`` for the rows of a view ``v``, all the columns joined as text."""
    row = ", '|', ".join(_text(f"v.{c}") for c in columns.split())
    return f"SELECT '{entity}' AS entity, concat({row}) AS row FROM {view} v WHERE {where}"


# Columns of the shop tables in their order.
_ORDER_COLUMNS = """id_order reference id_shop id_carrier id_lang id_customer id_currency
    id_address_delivery id_address_invoice current_state payment module shipping_number
    total_discounts_tax_incl total_paid_tax_incl total_paid_tax_excl total_products
    total_shipping_tax_incl invoice_number valid date_add date_upd"""
_DETAIL_COLUMNS = """id_order_detail id_order product_id product_attribute_id product_name
    product_reference product_ean13 product_quantity reduction_percent reduction_amount
    total_price_tax_incl total_price_tax_excl"""
_CUSTOMER_COLUMNS = """id_customer id_shop id_default_group id_lang company siret firstname
    lastname email passwd newsletter optin secure_key active deleted date_add acctbal home_nation"""
_ADDRESS_COLUMNS = """id_address id_country id_state id_customer company lastname firstname
    address1 address2 postcode city phone phone_mobile vat_number"""
_BUYERS = "v.id_customer IN (SELECT id_customer FROM buyer)"
_CHOSEN = "v.id_order IN (SELECT id_order FROM chosen)"


def _dimensions(uses: dict[str, str]) -> list[str]:
    """Dimension rows in use, given per dimension a query for the ids."""
    shapes = {
        "country": ("id_country", "id_country iso_code id_zone", "id_country id_lang name"),
        "state": ("id_state", "id_state iso_code", None),
        "group": ("id_group", "id_group reduction", "id_group id_lang name"),
        "carrier": ("id_carrier", "id_carrier name", "id_carrier id_lang delay"),
        "order_state": ("id_order_state", "id_order_state position", None),
        "cart_rule": ("id_cart_rule", "id_cart_rule code", "id_cart_rule id_lang name"),
        "currency": ("id_currency", "id_currency name", None),
        "lang": ("id_lang", "id_lang name", None),
    }
    out = []
    for name, ids in uses.items():
        key, columns, labels = shapes[name]
        out.append(_cells(name, f"s_{name}", columns, f"v.{key} IN ({ids})"))
        if name == "order_state":
            out.append(_cells("order_state_lang", "s_state_lang", "id_order_state id_lang name", f"v.{key} IN ({ids})"))
        elif labels:
            out.append(_cells(f"{name}_lang", f"s_{name}_lang", labels, f"v.{key} IN ({ids})"))
    return out


_ORDER_CHILDREN = {
    "order_detail": ("s_detail", _DETAIL_COLUMNS),
    "order_history": ("s_full_history", "id_order_history id_order id_order_state"),
    "order_carrier": ("s_order_carrier", "id_order_carrier id_order id_carrier"),
    "order_invoice": ("s_invoice", "id_order_invoice id_order total"),
    "order_slip": ("s_slip", "id_order_slip id_order"),
    "order_cart_rule": ("s_coupon", "id_order_cart_rule id_order id_cart_rule value"),
}
_ORDERS_COMPLETE = [
    _cells("orders", "s_orders", _ORDER_COLUMNS, _CHOSEN),
    *[_cells(name, view, columns, _CHOSEN) for name, (view, columns) in _ORDER_CHILDREN.items()],
    _cells(
        "order_payment", "s_payment", "id_order_payment order_reference amount",
        "v.order_reference IN (SELECT reference FROM chosen)",
    ),
]
_ORDERS_ULTRA = [
    *_ORDERS_COMPLETE,
    _cells("order_return", "s_full_return", "id_order_return id_order", _CHOSEN),
    _cells("order_message", "s_order_message", "id_order_message id_order name", _CHOSEN),
    _cells("message", "s_message", "id_message id_order message", _CHOSEN),
    _cells(
        "order_invoice_payment", "s_invoice_payment", "id_order_invoice id_order_payment",
        f"id_order_invoice IN (SELECT id_order_invoice FROM s_invoice v WHERE {_CHOSEN})",
    ),
    _cells(
        "order_slip_detail", "s_slip_detail", "id_order_slip_detail id_order_slip product_quantity",
        f"id_order_slip IN (SELECT id_order_slip FROM s_slip v WHERE {_CHOSEN})",
    ),
    _cells(
        "order_return_detail", "s_return_detail", "id_order_return id_order_detail product_quantity",
        f"id_order_return IN (SELECT id_order_return FROM s_full_return v WHERE {_CHOSEN})",
    ),
]
_CUSTOMERS_COMPLETE = [
    _cells("customer", "s_customer", _CUSTOMER_COLUMNS, _BUYERS),
    _cells("address", "s_address", _ADDRESS_COLUMNS, _BUYERS),
    _cells("customer_group", "s_customer_group", "id_customer id_group", _BUYERS),
]
_CUSTOMERS_ULTRA = [
    *_CUSTOMERS_COMPLETE,
    _cells("cart", "s_cart", "id_cart id_customer", _BUYERS),
    _cells("customer_thread", "s_thread", "id_customer_thread id_customer", _BUYERS),
    _cells("connections", "s_connections", "id_connections id_customer date_add", _BUYERS),
    _cells("guest", "s_guest", "id_guest id_customer date_add", _BUYERS),
    _cells(
        "cart_product", "s_cart_product", "id_cart id_product quantity",
        f"id_cart IN (SELECT id_cart FROM s_cart v WHERE {_BUYERS})",
    ),
    _cells(
        "customer_message", "s_customer_message", "id_customer_message id_customer_thread message",
        f"id_customer_thread IN (SELECT id_customer_thread FROM s_thread v WHERE {_BUYERS})",
    ),
]


def _written(select: str, names: list[str]) -> str:
    """The columns of a query as they are read back from files."""
    columns = ", ".join(f"nullif({_text(f'e.{n}')}, '') AS {n}" for n in names)
    return f"SELECT {columns} FROM ({select}) e"


def _used_by(where_orders: str) -> dict[str, str]:
    """Per dimension the ids that orders, addresses, coupons, groups and histories hold."""
    return {
        "country": f"SELECT v.id_country FROM s_address v WHERE {_BUYERS}",
        "state": f"SELECT v.id_state FROM s_address v WHERE {_BUYERS}",
        "group": f"SELECT v.id_group FROM s_customer_group v WHERE {_BUYERS}",
        "carrier": f"SELECT id_carrier FROM chosen",
        "order_state": f"SELECT v.id_order_state FROM s_full_history v WHERE {_CHOSEN}",
        "cart_rule": f"SELECT v.id_cart_rule FROM s_coupon v WHERE {_CHOSEN}",
        "currency": "SELECT id_currency FROM chosen",
        "lang": "SELECT id_lang FROM chosen" + where_orders,
    }


def _selected(orders: str | None, customers: str | None, parts: list[str]) -> str:
    sets = [f"chosen AS (SELECT * FROM s_orders o WHERE {orders})"] if orders else []
    sets += [f"buyer AS (SELECT * FROM s_customer c WHERE {customers})"] if customers else []
    return f"WITH {', '.join(sets)} " + " UNION ALL ".join(parts)


_ESTIMATE = f"""
        SELECT 'customer' AS entity, count(*) AS rows FROM s_customer c WHERE {_ACTIVE}
        UNION ALL SELECT 'address', count(*) FROM customer
        UNION ALL SELECT 'customer_group', count(*) FROM orders
        UNION ALL SELECT 'orders', count(*) FROM s_orders o WHERE {_PERIOD}
        UNION ALL SELECT 'order_detail', count(*) FROM lineitem
        UNION ALL SELECT 'order_history', count(*) FROM events
        UNION ALL SELECT 'order_payment', count(*) FROM s_payment
        UNION ALL SELECT 'order_carrier', count(*) FROM orders WHERE o_orderstatus <> 'P'
        UNION ALL SELECT 'order_invoice', count(*) FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'order_slip', count(*) FROM s_slip
        UNION ALL SELECT 'order_cart_rule', count(*) FROM s_coupon"""

_BODIES = {
    "scan_orders": f"SELECT * FROM s_orders o WHERE {_PERIOD} AND id_order > 20",
    "scan_customers": f"SELECT * FROM s_customer c WHERE {_ACTIVE}",
    "scan_generic_root": "SELECT * FROM s_customer WHERE id_customer > 70",
    "scan_children": f"""
        SELECT * FROM s_detail WHERE id_order IN (SELECT id_order FROM s_orders o WHERE {_PERIOD})
        """,
    "scan_children_scattered": """
        SELECT * FROM s_detail d WHERE EXISTS (
            SELECT 1 FROM s_orders o WHERE o.id_order = d.id_order AND current_state = 'P'
            AND id_shop = 2 AND id_lang = 1 AND id_currency = 3)""",
    "keyset_pages": f"""
        SELECT CAST((row_number() OVER (ORDER BY id_order) - 1) // 100 + 1 AS BIGINT) AS page, *
        FROM ({_orders(f"{_PERIOD} AND id_order > 300")})""",
    "keyset_page": _orders(f"{_PERIOD} AND id_order > 300") + " ORDER BY id_order LIMIT 100",
    "incremental_since": _orders("id_order > 1000"),
    "incremental_watermark": """
        SELECT coalesce(max(o_orderkey), 1000) AS watermark FROM orders WHERE o_orderkey > 1000""",
    "custom_columns": "SELECT id_customer, acctbal, home_nation FROM s_customer",
    "custom_table_closure": f"""
        WITH chosen AS (SELECT id_customer FROM s_customer c WHERE {_ACTIVE})
        SELECT 'customer' AS entity, id_customer AS id FROM chosen
        UNION ALL SELECT 'address', id_address FROM s_address JOIN chosen USING (id_customer)
        UNION ALL SELECT 'loyalty', event_id FROM events JOIN chosen ON id_customer = user_id
            WHERE event_type = 'signup'""",
    "sink_csv": "SELECT doc_id, CASE WHEN left(text, 1) IN ('=', '+', '-', '@') THEN '''' || text"
    " ELSE text END AS text, lang, n_chars FROM documents",
    "sink_csv_masked": f"""
        SELECT id_customer, {_email("email")} AS email, {_hash("lastname")} AS lastname,
               nullif(company, '') AS company FROM s_customer""",
    "csv_header_clean": """
        SELECT o_orderkey AS id_order, o_totalprice AS total____,
               o_orderpriority AS mode_paiement FROM orders""",
    "csv_safe_cells": f"""
        SELECT {_text("id_customer")} AS id_customer, {_text("company")} AS _dirty,
               {_text("CAST(round(acctbal) AS BIGINT)")} AS balance,
               {_text("round(acctbal) * CAST(10000.5 AS DOUBLE)")} AS large,
               {_text("round(acctbal) / 1048576")} AS small
        FROM s_customer""",
    "csv_bom": "SELECT count(*) > 0 AS marked FROM orders",
    "column_projection": "SELECT email, '' AS birthday, id_customer FROM s_customer",
    "export_relational": _selected(
        _FILTERED,
        _ACTIVE,
        [
            *_ORDERS_COMPLETE,
            *_CUSTOMERS_COMPLETE,
            _cells("loyalty", "s_loyalty", "id_loyalty id_customer points", _BUYERS),
            *_dimensions(_used_by(" UNION SELECT id_lang FROM buyer")),
        ],
    ),
    "export_incremental": """
        SELECT 0 AS run, id_order FROM s_orders WHERE current_state = 'O' AND id_order > 1000""",
    "export_continued": """
        WITH chosen AS (SELECT CASE WHEN id_order <= 4000 THEN 0 ELSE 1 END AS run, id_order
                        FROM s_orders WHERE current_state = 'O')
        SELECT run, 'orders' AS entity, id_order FROM chosen
        UNION ALL SELECT run, 'order_detail', id_order FROM s_detail JOIN chosen USING (id_order)""",
    "export_enriched": _written(_enriched(1, _WIDE), _ENRICHED_NAMES),
    "export_flat": _written(_flat(1, _WIDE), _FLAT_NAMES),
    "file_manifest": """
        WITH chosen AS (SELECT * FROM s_orders WHERE date_add >= '1999-01-01')
        SELECT 'orders' AS entity_name, count(*) AS row_count, true AS described FROM chosen
        UNION ALL SELECT 'order_detail', count(*), true FROM s_detail
            JOIN chosen USING (id_order)""",
    "file_manifest_any_path": """
        SELECT CASE id_order % 4 WHEN 0 THEN 'größe' WHEN 1 THEN 'a%20b' WHEN 2 THEN 'a b' ELSE 'a#b' END
            AS entity_name, CAST(count(*) AS BIGINT) AS row_count FROM s_orders GROUP BY 1""",
    "resume_export": _orders(_WIDE),
    "project_all": "SELECT * FROM s_orders",
    "project_enriched": _enriched(2, _WIDE),
    "project_flat": _flat(2, _FILTERED),
    "enriched_orders": _enriched(1, "true"),
    "flat_orders": _flat(1, _WIDE),
    "flat_orders_colocated": _flat(1, _WIDE),
    "flat_orders_by_department": _flat(
        1, "left(ad.postcode, 2) IN ('20', '05') OR ad.postcode LIKE '973%'"
    ),
    "flat_orders_corsica": _flat(
        1,
        "(left(ad.postcode, 2) = '05' OR left(ad.postcode, 3) IN ('200', '201'))",
    ),
    "flat_orders_guarded": _flat(
        1,
        "(left(ad.postcode, 2) IN ('05', '06', '07') OR ad.postcode LIKE '973%') AND ad.id_country < 6",
    ),
    "f_shop": _orders("id_shop = 2"),
    "f_shop_multi": _orders("id_shop IN (1, 3)"),
    "f_date_add_open": _orders("date_add >= '1999-03-01'"),
    "f_date_add": _orders("date_add >= '1997-03-01' AND date_add < '1998-03-01'"),
    "f_date_upd": _orders("date_upd >= '1999-01-01' AND date_upd < '1999-07-01'"),
    "f_id_range": _orders("id_order BETWEEN 100 AND 900"),
    "f_currency": _orders("id_currency = 3"),
    "f_lang": _orders("id_lang = 2"),
    "f_amounts": _orders(
        """total_paid_tax_incl BETWEEN 50000.5 AND 400000
        AND total_paid_tax_excl BETWEEN 45000 AND 300000
        AND total_products BETWEEN 40000 AND 280000
        AND total_shipping_tax_incl BETWEEN 1 AND 3
        AND total_discounts_tax_incl BETWEEN 5 AND 45"""
    ),
    "f_amount_zero_bound": _orders("total_paid_tax_incl <= 90000"),
    "f_current_state": _orders("current_state IN ('F', 'P')"),
    "f_has_had_state": _orders(_had("'purchase', 'signup'")),
    "f_never_had_state": _orders("NOT " + _had("'error', 'view'")),
    "f_state_history": _orders(_had("'purchase'") + " AND NOT " + _had("'error'")),
    "f_late": _orders(
        "date_add < TIMESTAMP '2001-08-01' - INTERVAL 300 DAY AND current_state NOT IN ('F')"
    ),
    "f_payment": _orders("payment = '2-HIGH'"),
    "f_payment_contains": _orders("payment LIKE '%GE%'"),
    "f_module": _orders("module = 'urgent'"),
    "f_has_payment": _orders(_PAID),
    "f_has_no_payment": _orders("NOT " + _PAID),
    "f_carrier": _orders("id_carrier IN (2, 5)"),
    "f_free_shipping": _orders("total_shipping_tax_incl = 0"),
    "f_paid_shipping": _orders("total_shipping_tax_incl > 0"),
    "f_has_tracking": _orders("shipping_number IS NOT NULL AND shipping_number <> ''"),
    "f_has_no_tracking": _orders("shipping_number IS NULL OR shipping_number = ''"),
    "f_has_invoice": _orders("invoice_number > 0"),
    "f_has_no_invoice": _orders("invoice_number IS NULL OR invoice_number = 0"),
    "f_has_slip": _orders(_SLIPPED),
    "f_has_no_slip": _orders("NOT " + _SLIPPED),
    "f_has_return": _orders(_RETURNED),
    "f_has_no_return": _orders("NOT " + _RETURNED),
    "f_different_addresses": _orders("id_address_delivery <> id_address_invoice"),
    "f_has_product": _orders(_line("d.product_id IN (3, 17, 42, 101, 150)")),
    "f_has_product_attribute": _orders(_line("d.product_attribute_id = 7")),
    "f_product_reference": _orders(_line("d.product_reference = 'P17-A'")),
    "f_product_reference_contains": _orders(_line("d.product_reference LIKE '%99-R%'")),
    "f_product_ean": _orders(_line("d.product_ean13 = '0000000000042'")),
    "f_product_discount": _orders(_DISCOUNTED),
    "f_products_together": _orders(
        _line("d.product_attribute_id = 7") + " AND " + _line("d.product_reference LIKE '%9-A%'")
    ),
    "f_manufacturer": _orders(
        """id_order IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey
                        WHERE p_brand IN ('Brand#3', 'Brand#8'))"""
    ),
    "f_category": _orders(
        """id_order IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey
                        WHERE p_type = 'SMALL')"""
    ),
    "f_has_coupon": _orders("EXISTS (SELECT 1 FROM s_coupon u WHERE u.id_order = o.id_order)"),
    "f_has_no_coupon": _orders(
        "NOT EXISTS (SELECT 1 FROM s_coupon u WHERE u.id_order = o.id_order)"
    ),
    "f_coupon_code": _orders(_coupon("r.code = 'Brand#11'")),
    "f_coupon_code_contains": _orders(_coupon("r.code LIKE '%#2%'")),
    "f_coupon_discount_min": _orders(_coupon("u.value >= 6500")),
    "f_coupon_discount_max": _orders(_coupon("u.value <= 900")),
    "f_coupon_count_min": _orders(
        "(SELECT count(*) FROM s_coupon u WHERE u.id_order = o.id_order) >= 3"
    ),
    "f_coupons_together": _orders(
        _coupon("r.code LIKE '%#1%'")
        + " AND (SELECT count(*) FROM s_coupon u WHERE u.id_order = o.id_order) >= 2"
    ),
    "f_late_default_state": _orders(
        "date_add < TIMESTAMP '2001-08-01' - INTERVAL 1000 DAY AND current_state = 'O'"
    ).replace("current_state, total", "2 AS current_state, total"),
    "f_ignore_case": _orders(
        "payment ILIKE '%urgent%' AND " + _line("d.product_reference ILIKE '%p1%'")
    ),
    "geo_delivery": _orders(_delivered("a.id_country IN (3, 7)")),
    "geo_invoice": _orders(_delivered("a.id_country IN (3, 7)", key="id_address_invoice")),
    "geo_both": _orders(
        _delivered("a.id_country IN (3, 7, 12, 15) AND a.postcode LIKE '05%'")
        + " OR "
        + _delivered("a.id_country IN (3, 7, 12, 15) AND a.postcode LIKE '05%'", key="id_address_invoice")
    ),
    "geo_country": _orders(_delivered("a.id_country IN (1, 20)")),
    "geo_country_iso": _orders(_delivered("k.iso_code IN ('4', '11')", _COUNTRY)),
    "geo_state": _orders(_delivered("a.id_state = 5")),
    "geo_state_iso": _orders(_delivered("a.id_state IN (6, 9)")),
    "geo_zone": _orders(_delivered("k.id_zone = 2", _COUNTRY)),
    "geo_postcode": _orders(_delivered("a.postcode = '00670'")),
    "geo_postcode_prefix": _orders(_delivered("a.postcode LIKE '08%'")),
    "geo_postcode_range": _orders(
        _delivered("a.postcode >= '02000' AND a.postcode <= '06999'")
    ),
    "geo_department": _orders(_delivered("g.dept_code IN ('03', '05', '973')", _MAP)),
    "geo_region": _orders(_delivered("g.region_code IN ('OCC', 'REU')", _MAP)),
    "geo_department_region": _orders(
        _delivered("g.dept_code IN ('01', '02', '03') AND g.region_code = 'ARA'", _MAP)
    ),
    "geo_corsica": _orders(_delivered("left(a.postcode, 3) IN ('200', '201', '202', '206')")),
    "geo_country_guard": f"""
        SELECT a.id_address, a.postcode FROM s_address a {_MAP}
        WHERE g.region_code IN ('OCC', 'ARA', 'IDF', 'NAQ') AND a.id_country < 6""",
    "geo_customer": f"""
        SELECT id_customer, id_default_group, email, active FROM s_customer c
        WHERE {_home("a.id_country IN (2, 4, 9, 15, 18) AND a.postcode LIKE '05%'")}""",
    "c_base": _customers(
        """c.id_shop = 1 AND c.date_add >= '1995-01-10' AND c.date_add < '1999-01-01'
        AND c.id_customer BETWEEN 5 AND 1200"""
    ),
    "c_active": _customers("c.active = 0"),
    "c_newsletter": _customers("c.newsletter = 1"),
    "c_optin": _customers("c.optin = 0"),
    "c_default_group": _customers("c.id_default_group IN ('BUILDING', 'MACHINERY')"),
    "c_lang": _customers("c.id_lang = 2"),
    "c_email": _customers("c.email = 'c33@household.example'"),
    "c_email_contains": _customers("c.email LIKE '%@f%'"),
    "c_in_group": _customers(
        """EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id_customer
                   AND o_orderpriority IN ('1-URGENT', '5-LOW'))"""
    ),
    "c_has_company": _customers("c.company IS NOT NULL AND c.company <> ''"),
    "c_has_siret": _customers("c.siret IS NOT NULL AND c.siret <> ''"),
    "c_has_phone": _customers(_home(_PHONE)),
    "c_has_no_phone": _customers("NOT " + _home(_PHONE)),
    "c_has_postcode": _customers("c.newsletter = 1 AND " + _home("a.postcode <> ''")),
    "c_has_vat_number": _customers(_home("a.vat_number <> ''")),
    "c_complete_address": _customers(_home(_COMPLETE)),
    "c_incomplete_address": _customers("NOT " + _home(_COMPLETE)),
    "c_reachable": _customers(_home(_PHONE) + " AND NOT " + _home("a.vat_number <> ''")),
    "c_prospect": _customers(
        "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey - o_custkey % 3 = c.id_customer)"
    ),
    "c_last_visit": _customers(
        """(SELECT max(ts) FROM events WHERE event_type = 'purchase'
            AND user_id = c.id_customer) < TIMESTAMP '2024-01-31' - INTERVAL 3 DAY"""
    ),
    "semi_join": _orders(
        "(SELECT count(*) FROM s_slip x WHERE x.id_order = o.id_order) >= 2"
    ),
    "anti_join": _orders("NOT " + _line("true")),
    "relational_closure": _selected(_PERIOD, None, _ORDERS_ULTRA),
    "relational_closure_customers": _selected(None, _ACTIVE, _CUSTOMERS_ULTRA),
    "closure_by_reference": f"""
        SELECT * FROM s_payment WHERE order_reference IN (
            SELECT reference FROM s_orders o WHERE {_FILTERED})""",
    "job_owner_join": """
        SELECT j.*, c.firstname, c.lastname FROM s_job j
        LEFT JOIN s_customer c ON c.id_customer = j.id_employee""",
    "reference_bundle": _selected(_PERIOD, _ACTIVE, _dimensions(_used_by(""))),
    "count_orders": f"SELECT count(*) AS n FROM s_orders o WHERE {_FILTERED}",
    "count_customers": f"SELECT count(*) AS n FROM s_customer c WHERE {_ACTIVE}",
    "count_customers_in_group": """
        SELECT count(*) AS n FROM s_customer c WHERE c.deleted = 0
        AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id_customer
                    AND o_orderpriority = '2-HIGH')
        AND (SELECT sum(CAST(o_totalprice AS DECIMAL(20, 6))) FROM orders
             WHERE o_custkey = c.id_customer AND o_orderstatus = 'F') >= 900000""",
    "count_flat": f"""
        SELECT count(*) AS n FROM s_orders o LEFT JOIN s_detail d USING (id_order)
        WHERE {_WIDE}""",
    "v_order_count": _value("id_customer, order_count")
    + " WHERE deleted = 0 AND order_count BETWEEN 2 AND 3",
    "v_ltv": _value(f"id_customer, {_LTV} AS ltv")
    + " WHERE deleted = 0 AND cents BETWEEN 20000000 AND 150000000",
    "v_avg_basket": _value(f"id_customer, {_BASKET} AS avg_basket")
    + """ WHERE deleted = 0 AND order_count > 0
          AND cents >= 10000000 * order_count AND cents <= 30000000 * order_count""",
    "customer_value": _value(
        f"id_customer, order_count, {_LTV} AS ltv, CAST({_BASKET} AS DOUBLE) AS avg_basket"
    ),
    "estimate_ratio": f"""
        WITH n AS (SELECT (SELECT count(*) FROM s_orders o WHERE {_PERIOD}) AS orders_n,
                          (SELECT count(*) FROM s_customer c WHERE {_ACTIVE}) AS customers_n)
        SELECT t.entity,
               CASE t.side WHEN 'o' THEN orders_n ELSE customers_n END * t.ratio AS rows
        FROM n, (VALUES
            ('customer', 'c', 1), ('address', 'c', 2), ('customer_group', 'c', 2),
            ('cart', 'c', 2), ('cart_product', 'c', 2), ('customer_thread', 'c', 2),
            ('customer_message', 'c', 2), ('connections', 'c', 2), ('orders', 'o', 1),
            ('order_detail', 'o', 3), ('order_history', 'o', 5), ('order_payment', 'o', 2),
            ('order_carrier', 'o', 2), ('order_invoice', 'o', 2),
            ('order_invoice_payment', 'o', 2), ('order_slip', 'o', 2),
            ('order_slip_detail', 'o', 3), ('order_cart_rule', 'o', 2),
            ('order_return', 'o', 2), ('message', 'o', 2), ('guest', 'c', 2),
            ('order_message', 'o', 2), ('order_return_detail', 'o', 3)) AS t(entity, side, ratio)""",
    "estimate_by_table": _ESTIMATE,
    "estimate_total": f"SELECT sum(rows) AS rows FROM ({_ESTIMATE}) t",
    "job_progress": """
        SELECT l_orderkey AS id_export_job,
               least(100, round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)
                     / count(*) * 100, 1)) AS percent
        FROM lineitem GROUP BY l_orderkey""",
    "rows_per_table": """
        SELECT 'orders' AS table_name, count(*) AS rows FROM orders
        UNION ALL SELECT 'lineitem', count(*) FROM lineitem
        UNION ALL SELECT 'customer', count(*) FROM customer
        UNION ALL SELECT 'events', count(*) FROM events""",
    "department_of": f"""
        SELECT id_address, {_DEPARTMENT} AS department,
               CASE WHEN left(postcode, 3) IN ('200', '201') THEN '2A'
                    WHEN left(postcode, 3) IN ('202', '206') THEN '2B'
                    ELSE {_DEPARTMENT} END AS department_corsica
        FROM s_address a""",
    "mask_email": f"""
        WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text,
                '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS e FROM documents),
             given AS (SELECT doc_id, e || CASE WHEN doc_id % 2 = 1 THEN '@b' ELSE '' END AS e
                       FROM found)
        SELECT doc_id, {_email("e")} AS masked FROM given""",
    "mask_phone": f"""
        WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text,
                '\\+?[0-9][0-9 ().-]{{7,}}[0-9]')) AS p FROM documents),
             given AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN left(p, 4) ELSE p END AS p
                       FROM found)
        SELECT doc_id, {_phone("p")} AS masked FROM given""",
    "mask_secret": """
        SELECT id_customer, '***MASKED***' AS passwd,
               CASE WHEN company IS NOT NULL THEN '***MASKED***' END AS company
        FROM s_customer""",
    "mask_hash": f"""
        SELECT id_address, {_hash("address1")} AS address1, {_hash("address2")} AS address2
        FROM s_address""",
    "anonymize": f"""
        SELECT id_customer, {_hash("firstname")} AS firstname, {_hash("lastname")} AS lastname,
               {_email("email")} AS email, '***MASKED***' AS passwd,
               '***MASKED***' AS secure_key, company
        FROM s_customer""",
    "anonymize_address": f"""
        SELECT id_address, {_hash("address1")} AS address1,
               {_unless_empty("address2", _hash("address2"))} AS address2,
               {_unless_empty("phone", _phone("phone"))} AS phone,
               {_unless_empty("phone_mobile", _phone("phone_mobile"))} AS phone_mobile,
               {_unless_empty("vat_number", _hash("vat_number"))} AS vat_number, city
        FROM s_address""",
    "csv_safe_value": f"""
        WITH risky AS (SELECT doc_id, chr(CAST(1 + doc_id % 3 AS INTEGER)) ||
                              substr('=+-@a', CAST(1 + doc_id % 5 AS INTEGER), 1) || text AS text
                       FROM documents),
             clean AS (SELECT doc_id, {_strip("text")} AS text FROM risky)
        SELECT doc_id, {_guard("text")} AS safe, text AS legacy FROM clean""",
    "log_redact": """
        SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN
               '{"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '"}' END
               AS context
        FROM events""",
    "top_recent_jobs": """
        SELECT j.*, c.firstname, c.lastname
        FROM (SELECT * FROM s_job ORDER BY date_add DESC, id_export_job DESC LIMIT 50) j
        LEFT JOIN s_customer c ON c.id_customer = j.id_employee""",
    "jobs_by_status": """
        SELECT * FROM s_job WHERE status IN ('pending', 'running', 'paused')
        ORDER BY date_add DESC, id_export_job DESC LIMIT 20""",
    "recent_logs": """
        SELECT event_id AS id_log, user_id AS id_export_job, event_type AS level,
               props AS context_json, ts AS date_add
        FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 15""",
    "job_files": """
        SELECT id_export_job, entity_name FROM s_file WHERE id_export_job = 7
        ORDER BY entity_name""",
    "order_by_key": _orders(_FILTERED) + " ORDER BY id_order",
    "flat_sort": f"""
        SELECT o.id_order, d.id_order_detail, d.product_id
        FROM s_orders o LEFT JOIN s_detail d ON d.id_order = o.id_order
        WHERE {_FILTERED} ORDER BY 1, 2, 3""",
    "facet_payments": """
        SELECT DISTINCT payment FROM s_orders WHERE payment IS NOT NULL AND payment <> ''
        ORDER BY payment""",
    "facet_regions": f"""
        SELECT g.region_code, g.region_name, count(a.id_address) AS addresses
        FROM geo_map g LEFT JOIN s_address a ON g.dept_code = {_DEPARTMENT}
        GROUP BY ALL ORDER BY 2""",
    "facet_departments": f"""
        SELECT g.dept_code, g.dept_name, count(a.id_address) AS addresses
        FROM geo_map g LEFT JOIN s_address a ON g.dept_code = {_DEPARTMENT}
        GROUP BY ALL ORDER BY 1""",
    "orphan_rows": """
        SELECT d.id_order, d.id_order_detail, d.product_id FROM s_detail d
        LEFT JOIN (SELECT id_order FROM s_orders WHERE date_add >= '1998-01-01') o
            ON o.id_order = d.id_order
        WHERE o.id_order IS NULL""",
    "drop_orphans": """
        SELECT d.id_order, d.id_order_detail, d.product_id FROM s_detail d
        JOIN s_orders o ON o.id_order = d.id_order WHERE o.date_add >= '1998-01-01'""",
    "mark_stuck": """
        SELECT id_export_job,
               CASE WHEN stuck THEN 'failed' ELSE status END AS status,
               CASE WHEN stuck THEN 'Timeout: job bloqué depuis plus de 24h' END AS error_message
        FROM (SELECT *, status = 'running' AND date_upd < TIMESTAMP '1997-12-31' AS stuck
              FROM s_job) j""",
    "retention_split": """
        WITH job AS (SELECT id_export_job,
                            date_add < TIMESTAMP '2001-08-01' - INTERVAL 900 DAY AS old
                     FROM s_job)
        SELECT CASE WHEN old THEN 'expired' ELSE 'kept' END AS entity, id_export_job AS id
        FROM job
        UNION ALL
        SELECT CASE WHEN old THEN 'expired_children' ELSE 'kept_children' END, id_export_file
        FROM s_file JOIN job USING (id_export_job)""",
    "drop_expired": """
        SELECT * FROM s_file WHERE download_expires >= TIMESTAMP '2001-07-25'""",
    "valid_links": "SELECT * FROM s_file WHERE download_expires > TIMESTAMP '2000-01-01'",
}


def _complete(body: str) -> str:
    """Merge a body's own WITH list into the views it uses."""
    text = _sql(body)
    own = re.match(r"\s*WITH\b", body)
    if own and text != body:
        views, _, rest = text.partition("\n" + body)
        return views + ",\n" + body[own.end() :] + rest
    return text


ORACLES = {name: _complete(body) for name, body in _BODIES.items()}
