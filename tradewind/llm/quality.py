"""Importance resampling of documents towards texts of high quality.

Words and pairs of words fall into hashed features.  One model counts them over the whole corpus,
one over texts labelled good; the log of a document's weight is the sum of its features' log ratios,
that is the log of the two models' ratio for the text.  Gumbel noise from a hash of the document
turns the top of the weights into a sample without replacement.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm.samples import MOST_LABELLED, id_places, labelled
from tradewind.llm.text import WORDS_AND_MARKS, byte_slices, mix, signed, tokenize, unsigned, utf8

FEATURES = 1 << 14
#: Pseudo-counts over all features, spread evenly.
SMOOTHING = 1.0


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word or run of marks, and of every pair within a row; rows ascend."""
    tokens = tokenize(data, offsets, WORDS_AND_MARKS)
    rows, h = tokens.rows, tokens.hashes
    within = rows[1:] == rows[:-1]
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:], 23)[within]
    at = np.concatenate([rows, rows[:-1][within]])
    feature = (np.concatenate([mix(h, 29), pairs]) >> np.uint64(64 - 14)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], feature[order]


def log_ratios(documents: DataFrame, target_ids: np.ndarray) -> np.ndarray:
    """Per feature: log of its chance in the target texts over its chance in all texts."""
    shared = documents.sparkSession.sparkContext.broadcast(target_ids)

    def scan(batches):
        raw, target = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for batch in batches:
            good = id_places(batch.column(0), shared.value) >= 0
            for first, last, data, offsets in byte_slices(batch.column(1)):
                rows, features = hashed_features(data, offsets)
                raw += np.bincount(features, minlength=FEATURES)
                target += np.bincount(features[good[first:last][rows]], minlength=FEATURES)
        used = np.flatnonzero(raw)
        yield store.table(feature=used.astype(np.int32), raw=raw[used], target=target[used])

    source = documents.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text"))
    sums = (
        source.mapInArrow(scan, "feature int, raw bigint, target bigint")
        .groupBy("feature")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toArrow()
    )
    counts = np.full((2, FEATURES), SMOOTHING)
    counts[:, sums["feature"].to_numpy()] += [sums["target"].to_numpy(), sums["raw"].to_numpy()]
    target, raw = counts / counts.sum(axis=1, keepdims=True)
    return np.log(target) - np.log(raw)


def _largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a bigint column: sixteen bits at a time, from at most 65,536 counts."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        inside = rows if prefix is None else rows.where(F.shiftright(column, shift + 16) == prefix)
        counts = inside.groupBy(F.shiftright(column, shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["p"]):
            if r["n"] >= left:
                prefix = r["p"]
                break
            left -= r["n"]
        else:
            return None
    return prefix


def resample(documents: DataFrame, labels: DataFrame, teach: Column | None = None, share: float | None = None,
             seed: int = 1, most_labelled: int = MOST_LABELLED, evenly: float | None = None) -> DataFrame:
    """(doc_id, n_features, log_ratio, sample_key, selected) for every row of ``documents``.

    The target model learns from at most ``most_labelled`` rows with quality 1, picked by a hash;
    the raw model from all rows.  ``share`` of all rows is selected; by default the share of good
    ones among the labels.  The sample is by Gumbel top-k: reruns agree.  Rows that repeat doc_id
    and text have one key, and all rows with the last key that fits are selected.  A text without
    words has the ratio 0.  With ``evenly`` every text weighs as so many features of its mean log
    ratio, whatever its length; that is no longer the models' ratio.  Without labels of quality 1 every ratio is 0, and without any labels
    all rows are selected.  Other columns are not read.
    """
    spark = documents.sparkSession
    ids, good = labelled(labels, "quality", F.lit(True) if teach is None else teach, most_labelled)
    target = ids[good > 0]
    ratios = log_ratios(documents, target) if len(target) else np.zeros(FEATURES)
    shared = spark.sparkContext.broadcast(ratios)
    if share is None:
        share = float((good > 0).mean()) if len(good) else 1.0

    def scan(batches):
        for batch in batches:
            keys = unsigned(batch.column(1).to_numpy())
            for first, last, data, offsets in byte_slices(batch.column(2)):
                rows, features = hashed_features(data, offsets)
                n = np.bincount(rows, minlength=last - first)
                sums = np.bincount(rows, weights=shared.value[features], minlength=last - first)
                ratio = sums if evenly is None else evenly * sums / np.maximum(n, 1)
                chance = ((mix(keys[first:last], seed + 41) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                key = ratio - np.log(-np.log(chance))
                bits = (key + 0.0).view(np.int64)
                yield store.table(
                    doc_id=batch.column(0).slice(first, last - first),
                    n_features=n.astype(np.int64),
                    log_ratio=ratio,
                    sample_key=key,
                    place=np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits),
                )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), utf8().alias("text"))
    scored = store.checkpoint(source.mapInArrow(scan, "doc_id bigint, n_features bigint, log_ratio double, sample_key double, place bigint"))
    n = scored.count()
    last = _largest(scored, "place", max(1, round(share * n))) if n and share > 0 else None
    selected = F.lit(False) if last is None else F.col("place") >= last
    return scored.select("doc_id", "n_features", "log_ratio", "sample_key", selected.alias("selected"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(documents, labels)
