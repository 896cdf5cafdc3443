"""From raw documents to a training mix.

Every stage takes the documents that the one before it kept and returns documents with the same
columns; the last one adds what the mix takes of each.  All stages read doc_id and text (the last
one source too); other columns are carried along under any name.  Null texts count as empty.  Rows
without doc_id pass every stage unless their own text is rejected.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm.decontaminate import decontaminate
from tradewind.llm.mixture import mix, turn_of
from tradewind.llm.neardup import kept_texts
from tradewind.llm.personal import learn_tagger, redact
from tradewind.llm.toxicity import score_toxicity

#: The toxicity model and the mix cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer if the documents have a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id and text are among ``rejected`` (doc_id, text_key)."""
    i, k = _free(docs, "rejected_id"), _free(docs, "rejected_key")
    rejected = rejected.select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k))
    return docs.join(rejected, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose passages make them toxic, by a model of the labels."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one text of every group of near copies (five words, 0.8), the one with the least doc_id.

    Unlike texts under one doc_id all stay; rows that repeat doc_id and text are one row.
    """
    i, k, n = _free(docs, "kept_id"), _free(docs, "kept_key"), _free(docs, "kept_rows")
    kept = store.checkpoint(kept_texts(docs).toDF(i, k, n))
    rows = docs.join(kept, (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64("text") == F.col(k)))
    out = rows.where(F.col(n) == 1).select(docs.columns).union(docs.where("doc_id IS NULL"))
    if kept.where(F.col(n) > 1).limit(1).count():
        out = out.union(rows.where(F.col(n) > 1).dropDuplicates([i, k]).select(docs.columns))
    return out


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which a twentieth or more is benchmark passages."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in place of every span of personal data, in all documents."""
    return redact(docs, learn_tagger(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, target of the source, copies and words taken.

    Rows that repeat doc_id and text are one row of their sizes' sum.
    """
    names = {c: _free(docs, c) for c in ("size", "target", "copies", "taken")}
    i, n = _free(docs, "mixed_turn"), _free(docs, "mixed_rows")
    dealt = mix(docs).where("taken > 0").groupBy(F.col("turn").alias(i))
    dealt = store.checkpoint(
        dealt.agg(
            F.count(F.lit(1)).alias(n),
            F.sum("size").alias(names["size"]),
            F.first("target").alias(names["target"]),
            F.sum("copies").alias(names["copies"]),
            F.sum("taken").alias(names["taken"]),
        )
    )
    rows = docs.join(dealt, turn_of() == F.col(i))
    out = rows.where(F.col(n) == 1)
    if dealt.where(F.col(n) > 1).limit(1).count():
        out = out.union(rows.where(F.col(n) > 1).dropDuplicates([i]))
    return out.drop(i, n)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicate", near_duplicate),
    ("benchmark_free", benchmark_free),
    ("personal_data", personal_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{store.shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
