from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import odd
from tradewind.llm import phrases as ph
from tradewind.llm import text as tx

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=ph.LONGEST, most=ph.MOST_LISTED):
    """The definition, phrase by phrase, with whole Python integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    chosen = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for (lang, *w), a in chosen.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[(lang, *w[i:j])] = max(inside[(lang, *w[i:j])], a)
    out = {}
    for (lang, *w), a in chosen.items():
        if 100 * inside[(lang, *w)] >= ph.SUBSUMED * a:
            continue
        cuts = [(lang, *w[:k]) for k in range(1, len(w))], [(lang, *w[k:]) for k in range(1, len(w))]
        score, _, l, r = min((2000000 * a // (f[x] + f[y]), k, f[x], f[y]) for k, (x, y) in enumerate(zip(*cuts)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, longest, most", [(3, 4, 2000), (10, 3, 7), (30, 4, 2000)])
def test_equals_brute_force(spark, least, longest, most):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    want = brute([(r.lang, r.text) for r in df.collect()], least, longest, most)
    assert want and rows_of(ph.mine_phrases(df, least, longest, most)) == want


def test_without_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(ph, "HOT_SHARE", 1)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    assert rows_of(ph.mine_phrases(df, 5)) == brute([(r.lang, r.text) for r in df.collect()], 5)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert rows_of(ph.mine_phrases(docs, 2)) == brute(rows, 2)
    assert ph.mine_phrases(odd.no_documents(spark)).collect() == []
    assert ph.mine_phrases(docs, 10**9).collect() == []


def test_ties_pieces_and_cuts(spark):
    texts = ["b a"] * 4 + ["é z"] * 4 + ["a.b a,b\na;b"] + ["x y z w"] * 5 + ["x y"] * 3 + ["A\tB  a b"] * 2
    rows = [(None, t) for t in texts]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(ph.mine_phrases(df, 3))
    assert got == brute(rows, 3)
    assert ("und", "x y z w") in {(r[0], r[2]) for r in got} and "y z w" not in {r[2] for r in got}


def test_counts_that_pass_64_bits(spark):
    a = 6 * 10**12
    df = spark.createDataFrame([(a, [a, 7], [a + 1, 9])], "a long, before array<long>, after array<long>")
    cut = df.select(ph._cut_scores(4).alias("cut")).first().cut
    assert (cut.score, cut.k, cut.l, cut.r) == (2000000 * a // (2 * a + 1), 1, a, a + 1)


def test_elements_are_merged_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(ph, "MOST_HELD", 50)
    rng, held, total, most = np.random.default_rng(1), ph._Elements(), Counter(), 0
    parts = []
    for _ in range(40):
        keys = rng.integers(0, 400, 30).astype(np.uint64)
        total.update(keys.tolist())
        parts += list(held.add(keys, keys + np.uint64(1)))
        most = max(most, held.held)
    parts += list(held.rest())
    got = Counter()
    for p in parts:
        assert (p[1] == p[0] + np.uint64(1)).all()
        got.update(dict(zip(p[0].tolist(), p[2].tolist())))
    assert got == total and len(parts) > 5 and most <= 80


def test_keys_are_those_of_spark(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 50) for _ in "ab")
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").selectExpr("xxhash64(a, b) AS h")
    assert [r.h for r in df.collect()] == tx.signed(ph._chain(tx.unsigned(a), tx.unsigned(b))).tolist()


def test_stripes_are_merged_after_one_exchange(spark):
    """Whole stripes travel; merging them, and adding up elements, needs no further exchange."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = df.selectExpr("xxhash64(lang) AS lang_key", "cast(text AS binary) AS text")
    merged = ph.merge_stripes(ph.count_stripes(texts, 0, None, None))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(prefix" in plan
