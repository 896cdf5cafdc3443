"""Tables that hold what real ones hold now and then."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, text_key long, "
    "node string, size string, copies string, turn string, score string, c0 string, kept_id string"
)
#: Columns that the operators use inside, under the same names.
CLASHES = (1, 2, "node", "size", "copies", "turn", "score", "c0", "kept_id")

LONG = " ".join(f"wort{i % 977} of{i % 13}" for i in range(30_000)) + " " + "x" * 300_000

TEXTS = [
    (1, "Plain words of one text that many would write in much the same way, no more.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n ", "fr", None),
    (5, "... !!! ???", "en", "b"),
    (6, LONG, "de", "a"),
    (7, "Deux mots", "fr", "c"),
    (8, "mail me at jo.doe@mail.example.com or +1 (555) 123-4567 now", "en", "c"),
    (8, "another text under the same id", "en", "c"),
    (9, "Plain words of one text that many would write in much the same way, no more.", "en", "b"),
    (10, "Ñandú él 日本語 ￿ \U0001f600 token = 'abcdef123456'", None, None),
    (None, "a text without an id", "en", "a"),
    (None, None, None, None),
    (11, "same row", "en", "a"),
    (11, "same row", "en", "a"),
    (11, "same row", "en", "a"),
]


def documents(spark):
    rows = [(i, t, lang, s, len(t or ""), *CLASHES) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def labels(spark, rows=((1, 1, 0), (5, 0, 0), (7, 1, 1), (None, 1, 1), (8, None, None), (1, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, texts=()):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (900, ""), (901, "...")]
    return spark.createDataFrame(rows, "item_id long, text string")


def by_id(df, column="doc_id"):
    return {r[column]: r for r in df.collect()}


def with_rows(spark, texts, source="s"):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], schema).withColumn(
        "source", F.lit(source)
    )
