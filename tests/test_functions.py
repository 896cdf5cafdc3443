import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tradewind.functions import cells, masking
from tradewind.functions.geography import department_of
from tradewind.functions.geomap import DEPARTMENTS, REGIONS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.coalesce(1).select("i", function(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_department_map():
    assert len(DEPARTMENTS) == 101 and len({d[0] for d in DEPARTMENTS}) == 101
    assert {d[2] for d in DEPARTMENTS} == set(REGIONS) and len(REGIONS) == 18


def test_department_of(spark):
    codes = ["75001", "97400", "98800", "20000", "20600", "01000", None, ""]
    want = ["75", "974", "988", "20", "20", "01", None, ""]
    assert apply(spark, department_of, codes) == want
    corsica = apply(spark, lambda c: department_of(c, corsica=True), codes)
    assert corsica == ["75", "974", "988", "2A", "2B", "01", None, ""]


def test_mask_email(spark):
    got = apply(spark, masking.mask_email, ["john.doe@x.fr", "a@b@c", "plain", "é@x", None, "a@"])
    assert got == [
        f"jo***{sha('john.doe')[:8]}@x.fr",
        f"{sha('a@b@c')[:16]}@anonymized.local",
        f"{sha('plain')[:16]}@anonymized.local",
        f"é***{sha('é')[:8]}@x",
        None,
        f"a***{sha('a')[:8]}@",
    ]


def test_mask_phone(spark):
    got = apply(spark, masking.mask_phone, ["06 12 34 56 78", "123", "+33 1-2", "none", None])
    assert got == ["06******78", "****", "+3*12", "****", None]


def test_anonymize_by_column_name(spark):
    df = spark.createDataFrame(
        [("a@b.fr", "0612345678", "pw", "k", "Jean", "Paris", 5, "0", ""),
         (None, None, None, None, None, None, None, None, None)],
        "Customer_Email string, phone_mobile string, last_passwd_gen string,"
        " reset_password_token string, firstname string, city string, other_id int,"
        " address1 string, dni string",
    ).coalesce(1)
    first, second = masking.anonymize(df).collect()
    assert tuple(first) == (
        f"a***{sha('a')[:8]}@b.fr", "06******78", "***MASKED***", "***MASKED***",
        sha("Jean")[:16], "Paris", sha("5")[:16], "0", "",
    )
    assert set(second) == {None}


@pytest.mark.parametrize("name, mask", [
    ("email", masking.mask_email), ("PHONE", masking.mask_phone), ("passwd", masking.mask_secret),
    ("secure_key", masking.mask_secret), ("reset_password_token", masking.mask_secret),
    ("vat_number", masking.mask_hash), ("city", None), ("token", None),
])
def test_mask_for(name, mask):
    assert masking.mask_for(name) is mask


def test_log_redact(spark):
    texts = [
        '{"rows": 12, "Email": "a@b", "deep": {"phone": 1, "n": [1, 2.5]}}',
        '{"PASSWORD": "x"}', "{}", "not json", None, '{"size": null, "s": "q\\"uote"}',
    ]
    got = apply(spark, masking.log_redact, texts)
    assert json.loads(got[0]) == {"rows": 12, "deep": {"phone": 1, "n": [1, 2.5]}}
    assert got[1:5] == [None] * 4
    assert json.loads(got[5]) == {"size": None, "s": 'q"uote'}


CELLS = ["=1+1", "-5", "@a", "+", "ok", "a\x0bb", "a\tb", "\tb", "\x00=1", "", None, "'=1", "a\n=b"]


def test_csv_safe_value(spark):
    assert apply(spark, cells.csv_safe_value, CELLS) == [
        "'=1+1", "'-5", "'@a", "'+", "ok", "ab", "a\tb", "'\tb", "'=1", "", "", "'=1", "a\n=b"
    ]
    legacy = apply(spark, lambda c: cells.csv_safe_value(c, legacy_order=True), CELLS)
    assert legacy[8] == "=1" and legacy[0] == "'=1+1"


def test_every_control_character_goes(spark):
    text = "x" + "".join(map(chr, range(0x20))) + "\x7f" + "y"
    assert apply(spark, cells.csv_safe_value, [text]) == ["x\t\n\ry"]


def test_cells_of_other_types(spark):
    df = spark.sql("SELECT -5 AS a, true AS b, array(1, 2) AS c, CAST(NULL AS DATE) AS d, 1.50BD AS e")
    assert tuple(cells.csv_safe_cells(df).first()) == ("'-5", "1", "[1,2]", "", "1.50")


def test_header(spark):
    df = spark.sql("SELECT 1 AS `total (€)`, 2 AS `-x`, 3 AS ok_1")
    assert cells.csv_header_clean(df).columns == ["total____", "_x", "ok_1"]
    with pytest.raises(ValueError, match="a_b"):
        cells.csv_header_clean(spark.sql("SELECT 1 AS `a-b`, 2 AS a_b"))
