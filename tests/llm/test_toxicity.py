import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm import odd
from tradewind.llm.queries import QUERIES
from tradewind.llm.samples import id_places, labelled, lookup
from tradewind.llm.toxicity import GAP_COST, LEAST_ODDS, LEAST_Z, PRIOR, SIGNIFICANT, _decay, score_toxicity, segments
from pyspark.sql import functions as F
import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def maximal(scores):
    """All maximal scoring segments, by taking the best one and going on beside it."""
    best, where = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9:
                best, where = total, (a, b)
    if where is None:
        return []
    a, b = where
    right = [(x + b + 1, y + b + 1, s) for x, y, s in maximal(scores[b + 1 :])]
    return [*maximal(scores[:a]), (a, b, best), *right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 40)
        places = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        hits = [rng.choice([0.31, 0.77, 1.13, 2.9]) + rng.random() * 1e-3 for _ in places]
        scores = [-GAP_COST] * n
        for p, s in zip(places, hits):
            scores[p] = s
        got = segments(np.array(places, int), np.array(hits))
        want = maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_decay_balances_clean_text():
    scores, chances = np.array([2.0, 5.0]), np.array([0.01, 0.002])
    x = _decay(scores, chances)
    assert abs((chances * np.exp(x * scores)).sum() + (1 - chances.sum()) * np.exp(-x * GAP_COST) - 1) < 1e-6
    assert _decay(np.zeros(0), np.zeros(0)) == 1.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic = [r.predicted for r in got if labels[r.doc_id]]
    clean = [r.predicted for r in got if not labels[r.doc_id]]
    assert len(toxic) > 50 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def brute_scores(texts, toxic):
    """The score from its definition: dictionaries of words, segments taken one by one, regression by small steps."""
    words = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.translate(LOWER)) for t in texts]
    n1, n0 = Counter(), Counter()
    for w, y in zip(words, toxic):
        (n1 if y else n0).update(set(w))
    all1, all0 = sum(n1.values()), sum(n0.values())
    weight, scores, chances = PRIOR * (all1 + all0), {}, {}
    for w in n1.keys() | n0.keys():
        prior = PRIOR * (n1[w] + n0[w])
        odds = math.log((n1[w] + prior) / (all1 + weight - n1[w] - prior)) - math.log((n0[w] + prior) / (all0 + weight - n0[w] - prior))
        if odds >= LEAST_ODDS and odds / math.sqrt(1 / (n1[w] + prior) + 1 / (n0[w] + prior)) >= LEAST_Z:
            scores[w], chances[w] = odds, (n0[w] + prior) / (all0 + weight)
    rate = _decay(np.array(list(scores.values())), np.array(list(chances.values())))
    x = np.ones((len(texts), 3))
    for row, w in zip(x, words):
        surprises = [rate * s - math.log(len(w)) for *_, s in maximal([scores.get(v, -GAP_COST) for v in w])]
        row[1] = math.log1p(sum(s for s in surprises if 0 < s < -math.log(SIGNIFICANT)))
        row[2] = math.log1p(sum(s for s in surprises if s >= -math.log(SIGNIFICANT)))
    y, beta, speed = np.array(toxic, float), np.zeros(3), np.zeros(3)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x @ beta))
        speed = 0.9 * speed - (x.T @ (p - y) + 1e-2 * beta)
        beta = beta + 2e-3 * speed
    return 1 / (1 + np.exp(-x @ beta))


def test_scores_equal_brute_force(spark):
    rng = random.Random(3)
    plain, foul = [f"w{i}" for i in range(150)], ["foul", "horrid", "vile", "Rotten"]
    texts, toxic = [], []
    for i in range(240):
        t = rng.choices(plain, k=rng.choice([8, 30, 90]))
        if i % 3 == 0:
            at = rng.randrange(len(t))
            t[at:at] = rng.choices(foul, k=rng.choice([1, 2, 4]))
        elif i % 40 == 1:
            t.append("vile")
        texts.append(" ".join(t))
        toxic.append(int(i % 3 == 0))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = odd.by_id(score_toxicity(odd.with_rows(spark, texts), labels))
    want = brute_scores(texts, toxic)
    assert np.abs(np.array([rows[i].score for i in range(len(texts))]) - want).max() < 2e-3
    assert sum(r.predicted for r in rows.values()) > 50 and any(r.evidence for r in rows.values())


@pytest.fixture(scope="module")
def joined(spark):
    """Clean texts of growing length, each also with one toxic document inside, scored as learned at sf0.1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    clean = [r.text for r in scored.where("toxic = 0 AND predicted = 0 AND size(passages) = 0").orderBy("doc_id").collect()]
    toxic = [r.text for r in scored.where("toxic = 1").orderBy(F.desc("evidence"), "doc_id").limit(20).collect()]
    rng, rows, made = random.Random(7), [], {}
    for n in (40, 100, 300, 1000):
        for k in range(20):
            t = rng.choices(clean, k=n)
            for inside in (0, 1):
                made[10**7 + len(rows)] = (n, inside)
                rows.append((10**7 + len(rows), " ".join([*t[: n // 2], *([toxic[k]] if inside else []), *t[n // 2 :]])))
    more = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = odd.by_id(score_toxicity(docs.select("doc_id", "text").unionByName(more), labels))
    return {key: [got[i] for i, k in made.items() if k == key] for key in set(made.values())}


@pytest.mark.parametrize("n", [40, 100, 300, 1000])
def test_clean_texts_stay_clean_at_any_length(joined, n):
    clean, toxic = joined[n, 0], joined[n, 1]
    assert np.mean([r.n_words for r in clean]) > 300 * n
    assert sum(r.predicted for r in clean) <= 1 and all(r.evidence == 0 or r.passages for r in clean)
    assert sum(r.predicted for r in toxic) >= 19


def test_score_reads_the_text_alone(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    one = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z")).repartition(5)
    two = {r.doc_id: r.score for r in score_toxicity(other, labels).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_odd_rows(spark):
    rows = score_toxicity(odd.documents(spark), odd.labels(spark)).collect()
    assert len(rows) == len(odd.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    none = score_toxicity(odd.documents(spark), odd.labels(spark).limit(0)).collect()
    assert len(none) == len(odd.TEXTS) and not any(r.predicted for r in none)
    assert score_toxicity(odd.no_documents(spark), odd.labels(spark)).collect() == []


def test_passages_show_where(spark):
    toxic = [f"good day {i} to all of you here" for i in range(60)]
    texts = toxic + [f"what a horrid foul day {i} it is for you" for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    rows = odd.by_id(score_toxicity(odd.with_rows(spark, texts), labels))
    assert all(rows[i].predicted == (i >= 60) for i in range(120))
    (p,) = rows[70].passages
    assert (p.begin, p.end) == (0, 4) or texts[70].split()[p.begin : p.end][-3:] == ["horrid", "foul", "day"][:3] or p.begin <= 2 < p.end


@pytest.mark.parametrize("most", [1 << 16, 100])
def test_sample_of_labels_is_bounded(spark, most):
    rows = [(i, 1, i % 2) for i in range(1000)] + [(5, 0, 1), (None, 1, 1), (2000, 1, None)]
    ids, y = labelled(odd.labels(spark, rows), "toxic", F.lit(True), most)
    assert (len(ids) == 1000) if most > 1000 else (0 < len(ids) <= most)
    assert (np.diff(ids) > 0).all() and all(b == (1 if i == 5 else i % 2) for i, b in zip(ids, y))
    assert id_places(pa.array([None, int(ids[0]), -1]), ids).tolist() == [-1, 0, -1]
    assert lookup(np.array([3]), np.zeros(0, int)).tolist() == [-1]
