"""Toxic passages by maximum-scoring segments.

A word's score is its log-odds between toxic and clean texts under Dirichlet priors that follow the
whole sample; words without significant odds cost a little.  One linear scan finds all maximal
segments of a text.  Under the extreme-value law of such segments in clean text, a score S in n
words has the expectation n * exp(-lambda * S); those below ``SIGNIFICANT`` are passages.  A text's
evidence is the sum of minus the logarithms of its passages' expectations, so words scattered over a
long text add up to nothing.  The evidence, and the same sum over the lesser segments of which less
than one is expected, give the probability, calibrated on the labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import store
from tradewind.llm.samples import MOST_LABELLED, id_places, labelled, lookup, text_hash
from tradewind.llm.text import ALPHANUMERIC, byte_slices, signed, tokenize, utf8

#: Weight of the prior: so many pseudo-words per word of the sample.
PRIOR = 0.05
LEAST_Z = 3.0
LEAST_ODDS = 1.0
MOST_TERMS = 1 << 16
#: What a word without odds of its own costs a segment.
GAP_COST = 0.25
SIGNIFICANT = 0.05

_PASSAGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


@dataclass
class ToxicTerms:
    """Hashes of toxic words (ascending) with their scores, and the law of segments in clean text."""

    hashes: np.ndarray
    scores: np.ndarray
    rate: float
    weights: tuple[float, ...] = (-20.0, 0.0, 0.0)


def segments(places: np.ndarray, scores: np.ndarray, cost: float = GAP_COST) -> list[tuple[int, int, float]]:
    """All maximal segments (first place, last place, score) of a text in which only ``places`` score.

    Linear: every segment knows the next earlier one that starts lower, and merged ones are gone.
    """
    stack: list[tuple[int, int, float, float]] = []
    links: list[int] = []
    total, last = 0.0, -1
    for place, score in zip(places.tolist(), scores.tolist()):
        total -= cost * (place - last - 1)
        last = place
        begin, low, total = place, total, total + score
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = links[j]
            if j < 0 or stack[j][3] >= total:
                stack.append((begin, place, low, total))
                links.append(j)
                break
            begin, low = stack[j][0], stack[j][2]
            del stack[j:], links[j:]
    return [(b, e, high - low) for b, e, low, high in stack]


def _decay(scores: np.ndarray, chances: np.ndarray) -> float:
    """The lambda for which a clean word's expected exp(lambda * score) is 1."""
    rest = 1 - chances.sum()
    if not len(scores) or (chances * scores).sum() >= rest * GAP_COST:
        return 1.0
    excess = lambda x: (chances * np.exp(x * scores)).sum() + rest * math.exp(-x * GAP_COST) - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _terms(documents: DataFrame, ids: np.ndarray, toxic: np.ndarray) -> ToxicTerms:
    """Word counts (once per text) over the labelled rows, their log-odds and what is significant."""
    shared = documents.sparkSession.sparkContext.broadcast((ids, toxic))

    def scan(batches):
        known, y = shared.value
        counter = store.Counter()

        def rows(parts):
            for h, n1, n0 in parts:
                yield store.table(h=signed(h), n1=n1, n0=n0)

        for batch in batches:
            at = id_places(batch.column(0), known)
            batch, at = batch.filter(pa.array(at >= 0)), at[at >= 0]
            for first, last, data, offsets in byte_slices(batch.column(1)):
                tokens = tokenize(data, offsets, ALPHANUMERIC)
                order = np.lexsort((tokens.hashes, tokens.rows))
                h, r = tokens.hashes[order], tokens.rows[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
                one = y[at[first:last]][r[new]].astype(np.int64)
                yield from rows(counter.add(h[new], one, 1 - one))
        yield from rows(counter.rest())

    source = documents.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text"))
    counts = source.mapInArrow(scan, "h bigint, n1 bigint, n0 bigint").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = store.checkpoint(counts)
    all1, all0 = (float(x or 0) for x in counts.agg(F.sum("n1"), F.sum("n0")).first())
    if not all1 or not all0:
        return ToxicTerms(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    weight = PRIOR * (all1 + all0)
    prior = PRIOR * (F.col("n1") + F.col("n0"))
    odds = lambda n, total: F.log((n + prior) / (total + weight - n - prior))
    scored = counts.select(
        "h",
        (odds(F.col("n1"), all1) - odds(F.col("n0"), all0)).alias("odds"),
        F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior)).alias("deviation"),
        ((F.col("n0") + prior) / (all0 + weight)).alias("chance"),
    ).withColumn("z", F.col("odds") / F.col("deviation"))
    scored = scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    floor = store.count_floor(scored, "z", MOST_TERMS).get(0)
    got = scored.where(F.col("z") >= F.lit(floor if floor is not None else math.inf)).select("h", "odds", "chance").toArrow()
    h = got["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    scores = got["odds"].to_numpy()[order]
    return ToxicTerms(h[order], scores, _decay(scores, got["chance"].to_numpy()[order]))


def passages(documents: DataFrame, terms: ToxicTerms) -> DataFrame:
    """(doc_id, text_key, n_words, slight, evidence, passages): a hash of the text; words counted from 0, a passage's end exclusive.

    evidence is the sum of minus the logarithms of the passages' expectations, 0 without any; slight
    is the same of segments that are no passages but less than one expected.  In clean text its mean
    is below 1 whatever the length.
    """
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def scan(batches):
        known = shared.value
        for batch in batches:
            for first, last, data, offsets in byte_slices(batch.column(2)):
                tokens = tokenize(data, offsets, ALPHANUMERIC)
                at = lookup(tokens.hashes, known.hashes)
                hit = np.flatnonzero(at >= 0)
                rows = tokens.rows[hit]
                cuts = np.searchsorted(rows, np.arange(last - first + 1))
                n = np.diff(tokens.bounds)
                slight, evidence, found = np.zeros(last - first), np.zeros(last - first), [[] for _ in range(last - first)]
                for r in np.unique(rows):
                    own = hit[cuts[r] : cuts[r + 1]]
                    for begin, end, score in segments(own - tokens.bounds[r], known.scores[at[own]]):
                        surprise = known.rate * score - math.log(n[r])
                        if surprise < -math.log(SIGNIFICANT):
                            slight[r] += max(0.0, surprise)
                        else:
                            evidence[r] += surprise
                            found[r].append({"begin": begin, "end": end + 1, "score": score, "expected": math.exp(-surprise)})
                yield store.table(
                    doc_id=batch.column(0).slice(first, last - first),
                    text_key=batch.column(1).slice(first, last - first),
                    n_words=n.astype(np.int64),
                    slight=slight,
                    evidence=evidence,
                    passages=pa.array(found, _PASSAGES),
                )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8().alias("text"))
    kind = "array<struct<begin:bigint,end:bigint,score:double,expected:double>>"
    return source.mapInArrow(scan, f"doc_id bigint, text_key bigint, n_words bigint, slight double, evidence double, passages {kind}")


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(documents: DataFrame, labels: DataFrame, teach: Column | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text_key, score, predicted, n_words, slight, evidence, passages) for every row of ``documents``.

    Learns from at most ``most_labelled`` labelled texts, picked by a hash among the rows of
    ``labels`` that ``teach`` admits (all, if None); the score reads the text alone.  Null texts
    count as empty; rows that repeat a doc_id are scored each by its text.  Without labels of both
    kinds nothing is toxic.  Columns besides doc_id and text are not read.
    """
    spark = documents.sparkSession
    ids, toxic = labelled(labels, "toxic", F.lit(True) if teach is None else teach, most_labelled)
    terms = _terms(documents, ids, (toxic > 0).astype(np.int64))
    found = store.checkpoint(passages(documents, terms))
    w = np.array(terms.weights)
    features = ["x1", "x2"]
    found = found.withColumns({"x1": F.log1p("slight"), "x2": F.log1p("evidence")})
    if len(terms.hashes):
        shared = spark.sparkContext.broadcast(ids)

        def pick(batches):
            for batch in batches:
                yield batch.filter(pa.array(id_places(batch.column(0), shared.value) >= 0))

        # As many rows as the sample has labels, unless ids repeat; then the first ones of each.
        sample = found.select("doc_id", *features).mapInArrow(pick, "doc_id bigint, x1 double, x2 double")
        sample = sample.groupBy("doc_id").agg(*[F.max(f).alias(f) for f in features]).toArrow()
        y = (toxic > 0).astype(float)[lookup(sample["doc_id"].to_numpy(), ids)]
        w = _fit(np.stack([np.ones(len(y)), *(sample[f].to_numpy() for f in features)], axis=1), y)
    logit = sum((float(a) * F.col(x) for a, x in zip(w[1:], features)), F.lit(float(w[0])))
    scored = found.withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select("doc_id", "text_key", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "slight", "evidence", "passages")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(documents, labels, text_hash() % 5 != 0)
    return scored.select("doc_id", (text_hash() % 5 == 0).alias("held_out"), "score", "predicted", "n_words", F.size("passages").cast("long").alias("n_passages"))
