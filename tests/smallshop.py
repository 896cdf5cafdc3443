"""A hand-made shop of a few rows for the cases the sample tables cannot show."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tradewind.sources.shop import Shop

ORDERS = (
    "id_order long, reference string, id_shop long, id_carrier long, id_lang long,"
    " id_customer long, id_currency long, id_address_delivery long, id_address_invoice long,"
    " current_state long, payment string, module string, shipping_number string,"
    " total_discounts_tax_incl decimal(20,6), total_paid_tax_incl decimal(20,6),"
    " total_paid_tax_excl decimal(20,6), total_products decimal(20,6),"
    " total_shipping_tax_incl decimal(20,6), invoice_number long, valid int,"
    " date_add string, date_upd string"
)


def _order(key, reference, customer, delivery, invoice, state, paid, date, **extra):
    row = dict(
        id_order=key, reference=reference, id_shop=1, id_carrier=2, id_lang=1,
        id_customer=customer, id_currency=1, id_address_delivery=delivery,
        id_address_invoice=invoice, current_state=state, payment="Carte", module="card",
        shipping_number=None, total_discounts_tax_incl=0, total_paid_tax_incl=paid,
        total_paid_tax_excl=paid, total_products=paid, total_shipping_tax_incl=0,
        invoice_number=None, valid=1, date_add=date, date_upd=date,
    )
    row.update(extra)
    return tuple(row.values())


def small_shop(spark) -> Shop:
    def table(rows, schema):
        return spark.createDataFrame([tuple(r) for r in rows], schema).coalesce(1)

    orders = spark.createDataFrame(
        [
            (*r[:13], *[Decimal(v) for v in r[13:18]], *r[18:])
            for r in [
                _order(1, "ABC", 1, 10, 10, 5, 100, "2024-01-10 23:59:59", id_lang=2),
                _order(2, "ABC", 1, 10, 11, 2, 50, "2024-01-11 00:00:00",
                       shipping_number="", invoice_number=0, total_shipping_tax_incl=4),
                _order(3, "DEF", 2, 12, 13, None, 75, "2023-01-01 10:00:00",
                       shipping_number="T3", invoice_number=9, payment="Virement 100%"),
                _order(4, "GHI", 3, 14, 14, 4, 20, "2024-01-05 12:00:00", valid=0),
                _order(5, "JKL", None, 99, 99, 2, 0, "2024-01-06 12:00:00", id_shop=2),
            ]
        ],
        ORDERS,
    ).coalesce(1)
    for c in ("date_add", "date_upd"):
        orders = orders.withColumn(c, F.to_timestamp_ntz(F.col(c)))
    return Shop(
        spark,
        {
            "orders": orders,
            "order_detail": table(
                [
                    (1, 1, 100, 0, "Lampe", 1, "REF_1", "111", 0.0, 0.0, 60.0, 50.0),
                    (2, 1, 100, 0, "Lampe", 1, "REF_1", "111", 10.0, 0.0, 20.0, 17.0),
                    (3, 1, 100, 1, "Lampe", 1, "REF_1", "111", 0.0, 2.0, 20.0, 17.0),
                    (4, 2, 200, 0, "Table", 2, "REFX2", "222", 0.0, 0.0, 50.0, 42.0),
                    (5, 3, 300, 0, "Vase", 1, "OTHER", "333", 0.0, 0.0, 75.0, 62.0),
                ],
                "id_order_detail long, id_order long, product_id long, product_attribute_id long,"
                " product_name string, product_quantity long, product_reference string,"
                " product_ean13 string, reduction_percent double, reduction_amount double,"
                " total_price_tax_incl double, total_price_tax_excl double",
            ),
            "product": table(
                [(100, 7, 70), (200, 8, 80), (300, 7, 90)],
                "id_product long, id_manufacturer long, id_category_default long",
            ),
            "customer": table(
                [
                    (1, 1, 3, 1, "Acme", "123", "Jean", "Doe", "john.doe@x.fr", "pw", 1, 0, "k1", 1, 0),
                    (2, 1, 3, 2, "", "", "Ana", "Roy", "ANA@x.fr", "pw", 0, 1, "k2", 1, 0),
                    (3, 1, 4, 1, None, None, "Max", "Lee", "max@y.fr", "pw", 0, 0, "k3", 0, 0),
                    (4, 2, 4, 1, "Old", None, "Eve", "Kay", "eve@y.fr", "pw", 1, 1, "k4", 1, 1),
                    (5, 1, 3, 1, None, None, "Zoe", "Sun", "zoe@z.fr", "pw", 1, 0, "k5", 1, 0),
                ],
                "id_customer long, id_shop long, id_default_group long, id_lang long,"
                " company string, siret string, firstname string, lastname string, email string,"
                " passwd string, newsletter int, optin int, secure_key string, active int,"
                " deleted int",
            ).withColumn("date_add", F.to_timestamp_ntz(F.lit("2023-06-01 00:00:00"))),
            "address": table(
                [
                    (10, 8, 1, 1, "75001", "Paris", "1 rue A", "06 12 34 56 78", None, None),
                    (11, 9, 2, 1, "01000", "Bourg", "2 rue B", None, "", "FR1"),
                    (12, 8, None, 2, "97400", "Saint-Denis", "", "", None, None),
                    (13, 8, None, 2, "20000", "Ajaccio", "3 rue C", None, None, ""),
                    (14, 9, None, 3, "75002", "Paris", "4 rue D", None, "0612", None),
                ],
                "id_address long, id_country long, id_state long, id_customer long,"
                " postcode string, city string, address1 string, phone string,"
                " phone_mobile string, vat_number string",
            ).withColumns(
                {
                    "company": F.lit(None).cast("string"),
                    "firstname": F.lit("F"),
                    "lastname": F.lit("L"),
                    "address2": F.lit(None).cast("string"),
                }
            ),
            "country": table(
                [(8, "FR", 1), (9, "BE", 2)], "id_country long, iso_code string, id_zone long"
            ),
            "country_lang": table(
                [(8, 1, "France"), (8, 2, "Frankreich"), (9, 1, "Belgique")],
                "id_country long, id_lang long, name string",
            ),
            "state": table([(1, "AA"), (2, "BB")], "id_state long, iso_code string"),
            "order_state_lang": table(
                [(2, 1, "Payée"), (5, 1, "Livrée"), (5, 2, "Delivered")],
                "id_order_state long, id_lang long, name string",
            ),
            "customer_group": table(
                [(1, 1), (1, 2), (2, 2), (4, 1)], "id_customer long, id_group long"
            ),
            "order_history": table(
                [(1, 1, 2), (2, 1, 5), (3, 2, 2), (4, 3, 6), (5, 3, 6)],
                "id_order_history long, id_order long, id_order_state long",
            ),
            "order_payment": table(
                [(1, "ABC"), (2, "ABC"), (3, "DEF"), (4, "ZZZ"), (5, None)],
                "id_order_payment long, order_reference string",
            ),
            "order_cart_rule": table(
                [(1, 1, 1, 5.0), (2, 1, 2, 15.0), (3, 2, 1, 3.0), (4, 4, 9, 8.0)],
                "id_order_cart_rule long, id_order long, id_cart_rule long, value double",
            ),
            "cart_rule": table([(1, "NOEL_10"), (2, "ETE20")], "id_cart_rule long, code string"),
            "order_slip": table(
                [(1, 1), (2, 3), (3, 4)], "id_order_slip long, id_order long"
            ),
            "order_slip_detail": table(
                [(1, 1), (2, 1), (3, 2), (4, 77)],
                "id_order_slip_detail long, id_order_slip long",
            ),
            "order_return": table([(1, 3)], "id_order_return long, id_order long"),
            "cart": table([(1, 1), (2, 4), (3, 9)], "id_cart long, id_customer long"),
            "cart_product": table([(1, 100), (1, 200), (2, 100)], "id_cart long, id_product long"),
            "connections": table(
                [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-30 00:00:00"),
                 (3, 2, "2024-01-02 00:00:00")],
                "id_connections long, id_customer long, date_add string",
            ).withColumn("date_add", F.to_timestamp_ntz("date_add")),
            "wishlist": table([(1, 1), (2, 4)], "id_wishlist long, id_customer long"),
        },
    )
