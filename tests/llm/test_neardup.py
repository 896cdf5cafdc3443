import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from tradewind.llm import neardup, text as T
from tradewind.llm.components import connected_components
from tradewind.llm.neardup import Similarity, kept_texts, near_duplicates, sketch


def brute(rows, kind):
    """Least id reachable of each id, from all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        runs = {tuple(w[j : j + kind.words]) for j in range(len(w) - kind.words + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(runs)
    least = {i: i for i in sets}
    changed = True
    links = [
        (i, j)
        for i in sets
        for j in sets
        if i < j and any(a and b and 100 * len(a & b) >= kind.percent * len(a | b) for a in sets[i] for b in sets[j])
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            if least[i] != low or least[j] != low:
                least[i] = least[j] = low
                changed = True
    return least


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def family_rows():
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [" ".join(base)] + [edited(rng, base, rng.randrange(1, 12)) for _ in range(70)]
    side = edited(rng, base, 9).split()  # a branch whose members resemble each other more than the base
    rows += [edited(rng, side, rng.randrange(0, 4)) for _ in range(30)]
    for size in (1, 2, 3, 4, 7, 20):
        own = [f"s{rng.randrange(10**6)}" for _ in range(size)]
        rows += [" ".join(own)] * 2 + [edited(rng, own, 1), " ".join(own + ["more"])]
    rows += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(base[:30]) for _ in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", [Similarity(), Similarity(words=3, percent=85, run=6)])
@pytest.mark.parametrize("small", [2, 16])
def test_no_link_is_lost_in_a_family(spark, monkeypatch, kind, small):
    monkeypatch.setattr(neardup, "SMALL_BAND", small)
    rows = family_rows()
    got = {r.doc_id: r.component_id for r in near_duplicates(odd.with_rows(spark, rows), kind).collect()}
    assert got == brute(list(enumerate(rows)), kind)


def test_odd_rows(spark):
    rows = near_duplicates(odd.documents(spark)).collect()
    assert len(rows) == len(odd.TEXTS)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert got[1] == {(12, 1, True)} and got[9] == {(12, 1, False)}
    assert got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)} and got[4] == {(0, 4, True)}
    assert got[8] == {(2, 8, True), (5, 8, True)} or {c for _, c, _ in got[8]} == {8}
    assert got[11] == {(1, 11, True)} and {(c, k) for _, c, k in got[None]} == {(None, True)}
    assert near_duplicates(odd.no_documents(spark)).collect() == []


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(3)
    kind = Similarity()
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(1, 2**63, 4000).astype(np.uint64)
        b = a.copy()
        n = int(4000 * (1 - share) / (1 + share))
        b[:n] = rng.integers(1, 2**63, n).astype(np.uint64)
        at = np.repeat([0, 1], 4000)
        regs = sketch(at, np.concatenate([a, b]), 2, kind.registers)
        assert abs((regs[0] == regs[1]).mean() - share) < 5 * (share * (1 - share) / kind.registers) ** 0.5
    few = sketch(np.array([0, 1, 1]), np.array([5, 5, 9], np.uint64) << np.uint64(40), 3, kind.registers)
    assert len(set(few[0])) == 1 and 1 <= len(set(few[1])) <= 2


def test_equal_sets_have_equal_registers():
    texts = pa.array([b"a b c d e f g", b"A  b c d e f g", b"x"], pa.binary())
    for first, last, data, offsets in T.byte_slices(texts):
        at, grams = neardup.distinct_shingles(T.tokenize(data, offsets, T.BLANK_SEPARATED), 5)
        regs = sketch(at, grams, 3, 205)
        assert (regs[0] == regs[1]).all() and not (regs[0] == regs[2]).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    links += [(5000, 5000 + i) for i in range(1, 200)]
    least = {}
    for u, v in links:
        least.setdefault(u, u), least.setdefault(v, v)
    for _ in range(400):
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    got = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {n: c for n, c in least.items() if any(u != v and n in (u, v) for u, v in links)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_every_text_of_a_doc_id_is_compared(spark):
    """Each of two unlike texts under one doc_id has a near copy under another."""
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "pq")
    rows = [(5, one), (5, two), (5, None), (7, one + " more"), (9, two + " more"), (11, "alone here"), (-3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11), (-3, -3)}
    kept = kept_texts(docs.union(docs.where("doc_id = 11")))
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kept = kept.join(keys, ["doc_id", "text_key"]).select("doc_id", "text", "n_rows").collect()
    assert {(r.doc_id, r.text, r.n_rows) for r in kept} == {(5, one, 1), (5, two, 1), (5, None, 1), (11, "alone here", 2), (-3, "x y", 1)}



def test_no_table_of_links_or_pairs_is_broadcast(spark, monkeypatch):
    """Labels and pairs grow with the documents; the driver must not collect them to send them."""
    from tradewind.llm import store

    plans, compact = [], store.compact

    def watched(df, *args):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return compact(df, *args)

    monkeypatch.setattr(store, "compact", watched)
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "u long, v long")
    assert {r.component for r in connected_components(links).collect()} == {0, 100}
    assert plans and not [p for p in plans if "BroadcastExchange" in p]
    base = " ".join(f"w{i}" for i in range(40))
    sets = neardup.shingle_sets(spark.createDataFrame([(1, base), (2, base + " x"), (3, "a b c d e f")], "doc_id long, text string"), Similarity(), spark.sparkContext.broadcast(np.full(1 << 17, np.uint64(2**64 - 1))))
    confirmed = neardup._confirmed(spark.createDataFrame([(1, 2), (1, 3)], "u long, v long"), sets, Similarity())
    assert [tuple(r) for r in confirmed.collect()] == [(1, 2)]
    assert "BroadcastExchange" not in confirmed._jdf.queryExecution().executedPlan().toString()
