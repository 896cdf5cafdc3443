"""Masking, cleaning and CSV against plain Python over random text."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tradewind.functions import cells, masking
from tradewind.sinks.csvfiles import CsvOptions, read_csv, write_csv

POOL = list("ab09+=-@;,\"'\\ \t\n\r\x00\x0b\x1f\x7fé€😀.")


def texts(n=400, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(POOL, k=rng.randint(0, 12))) for _ in range(n)]


def sha(text, n):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def safe(text):
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    return "'" + text if text[:1] in set("=+-@\t\r\n") and text else text


def email(text):
    parts = text.split("@")
    if len(parts) != 2:
        return sha(text, 16) + "@anonymized.local"
    return f"{parts[0][:2]}***{sha(parts[0], 8)}@{parts[1]}"


def phone(text):
    digits = re.sub("[^0-9+]", "", text)
    return "****" if len(digits) <= 4 else digits[:2] + "*" * (len(digits) - 4) + digits[-2:]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, v string").coalesce(2)


def test_expressions_agree_with_python(spark):
    values = texts()
    v = F.col("v")
    rows = frame(spark, values).select(
        "i",
        cells.csv_safe_value(v).alias("safe"),
        masking.mask_email(v).alias("email"),
        masking.mask_phone(v).alias("phone"),
        masking.mask_hash(v).alias("hash"),
    )
    for r in rows.collect():
        text = values[r.i]
        assert r.safe == safe(text)
        assert r.email == email(text)
        assert r.phone == phone(text)
        assert r.hash == sha(text, 16)


def test_cells_of_a_row_agree_with_single_values(spark):
    values = texts(seed=11)
    pairs = frame(spark, values).select("i", "v", F.reverse("v").alias("w"))
    for r in cells.csv_safe_cells(pairs).collect():
        text = values[int(r.i)]
        assert (r.v, r.w) == (safe(text), safe(text[::-1]))


def test_csv_round_trip(spark, tmp_path):
    values = texts(seed=3)
    for number, options in enumerate((CsvOptions(), CsvOptions(sep=",", bom=False))):
        path = f"{tmp_path}/{number}"
        write_csv(frame(spark, values).select("i", "v", "v").toDF("i", "v", "w"), path, options)
        back = {int(r.i): (r.v, r.w) for r in read_csv(spark, path, options).collect()}
        assert len(back) == len(values)
        for i, text in enumerate(values):
            assert back[i] == (safe(text) or None,) * 2, repr(text)
