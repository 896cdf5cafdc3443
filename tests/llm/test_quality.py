import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm import odd
from tradewind.llm.quality import FEATURES, _largest, hashed_features, log_ratios, resample
from tradewind.llm.queries import QUERIES


def test_the_kth_largest_place(spark):
    rng = random.Random(1)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(500)] + [7, 7, 7, -1, 0, 2**63 - 1]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 3, 250, 505, 506):
        assert _largest(frame, "v", k) == ordered[k - 1]
    assert _largest(frame, "v", 507) is None


@pytest.mark.parametrize("share", [None, 0.1, 0.5, 1.0])
def test_selection_is_the_top_by_key(spark, share):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = resample(docs, labels, share=share).collect()
    used = share if share is not None else np.mean([r.quality for r in labels.collect()])
    k = max(1, round(used * len(rows)))
    top = sorted((r.sample_key for r in rows), reverse=True)[k - 1]
    assert all(r.selected == (r.sample_key >= top) for r in rows)
    assert sum(r.selected for r in rows) == k
    again = resample(docs.repartition(9), labels, share=share).collect()
    assert {(r.doc_id, r.selected) for r in again} == {(r.doc_id, r.selected) for r in rows}


def test_ratios_are_those_of_the_counts(spark):
    docs = odd.with_rows(spark, ["good good", "bad !!", "good bad"])
    ratios = log_ratios(docs, np.array([0]))
    raw, target = 9 + 1.0 * len(ratios), 3 + 1.0 * len(ratios)
    values = {round(math.log(((t + 1) / target) / ((r + 1) / raw)), 9) for t, r in ((2, 3), (1, 1), (0, 2), (0, 1), (0, 0))}
    assert set(np.round(ratios, 9)) <= values | {round(math.log((a + 1) / target / ((b + 1) / raw)), 9) for a in range(4) for b in range(7)}


def brute_weights(texts, target):
    """Log of the two models' ratio for each text, from dictionaries of words, marks and pairs."""
    tokens = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", t.lower()) for t in texts]
    features = [[*w, *zip(w, w[1:])] for w in tokens]
    raw, good = Counter(), Counter()
    for i, f in enumerate(features):
        raw.update(f)
        if i in target:
            good.update(f)
    n_raw, n_good = (sum(c.values()) + FEATURES for c in (raw, good))
    ratio = {x: math.log((good[x] + 1) / n_good) - math.log((raw[x] + 1) / n_raw) for x in raw}
    return [sum(ratio[x] for x in f) for f in features], features


def test_weights_equal_brute_force(spark):
    """Texts of few features, none of which share a hash, so the hashed models are the plain ones."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(9)] + ["!!", "?"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 4, 40]))) for _ in range(60)]
    target = set(range(0, 60, 3))
    want, features = brute_weights(texts, target)
    docs = odd.with_rows(spark, texts)
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    at, hashed = hashed_features(np.frombuffer(data, np.uint8), offsets)
    assert len(set(hashed.tolist())) == len({x for f in features for x in f}) and np.bincount(at).tolist() == [len(f) for f in features]
    labels = spark.createDataFrame([(i, int(i in target), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = odd.by_id(resample(docs, labels))
    assert np.allclose([rows[i].log_ratio for i in range(60)], want, atol=1e-9)
    even = odd.by_id(resample(docs, labels, evenly=24.0))
    assert np.allclose([even[i].log_ratio for i in range(60)], [24 * w / len(f) for w, f in zip(want, features)], atol=1e-9)
    for i in range(60):  # the same noise is added to either weight
        assert abs((rows[i].sample_key - rows[i].log_ratio) - (even[i].sample_key - even[i].log_ratio)) < 1e-9


def test_good_texts_are_kept(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op7_quality"](spark, sf).collect()]
    assert len(got) == 10_000
    good = [r.selected for r in got if quality.get(r.doc_id) == 1]
    junk = [r.selected for r in got if quality.get(r.doc_id) == 0]
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.2


def test_noise_follows_the_law(spark):
    docs = odd.with_rows(spark, [f"text {i}" for i in range(4000)])
    keys = np.array([r.sample_key for r in resample(docs, odd.labels(spark).limit(0)).collect()])
    assert abs(keys.mean() - 0.5772) < 0.1 and abs(keys.var() - math.pi**2 / 6) < 0.25


def test_odd_rows(spark):
    rows = resample(odd.documents(spark), odd.labels(spark)).collect()
    assert len(rows) == len(odd.TEXTS) and all(math.isfinite(r.sample_key) for r in rows)
    assert {r.log_ratio for r in rows if r.n_features == 0} == {0.0}
    assert all(r.selected for r in resample(odd.documents(spark), odd.labels(spark).limit(0)).collect())
    assert resample(odd.no_documents(spark), odd.labels(spark)).collect() == []
