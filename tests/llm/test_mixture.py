import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.llm import odd
from tradewind.llm import mixture
from tradewind.llm.mixture import mix, targets


def shares(sizes):
    """Cap and share again until no target is above its cap."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: mixture.WEIGHTS[i % 3] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        own = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if own[n] > 3 * sizes[n]}
        if not over:
            return own | {n: 3.0 * sizes[n] for n in full}
        full |= over


def test_targets_are_shared_again(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 10_000]) for i in range(rng.randrange(1, 9))} | {None: 40, "hot": 30_000}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(frame).collect()}
        want = shares(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[n] - want[n]) <= 1e-9 * max(1, want[n]) for n in want)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_sources_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixture, "PART_ROWS", 50)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) <= sum(r.size for r in got)
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    again = {(r.doc_id, r.taken) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_odd_rows(spark):
    rows = mix(odd.documents(spark)).collect()
    assert len(rows) == len(odd.TEXTS)
    sizes = {r.doc_id: r.size for r in rows}
    assert sizes[2] == sizes[3] == sizes[4] == 0 and sizes[6] == 60_001 and sizes[7] == 2
    assert sum(r.taken for r in rows) <= sum(r.size for r in rows)
    assert {r.source_size for r in rows if r.source is None} == {8}
    assert mix(odd.no_documents(spark)).collect() == []
    empty = mix(odd.documents(spark).withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(empty) == len(odd.TEXTS) and not any(r.taken for r in empty)


def test_targets_of_many_sources(spark):
    """Against the shares found by filling sources one after the other."""
    rng = np.random.default_rng(4)
    sizes = rng.zipf(1.3, 50_000).clip(1, 10**7).astype(int)
    names = sorted(f"s{i}" for i in range(50_000))
    frame = spark.createDataFrame(pd.DataFrame({"source": names, "source_size": sizes}))
    got = mixture.targets(frame).toPandas().set_index("source")["target"]
    weights = np.array([mixture.WEIGHTS[i % 3] for i in range(50_000)])
    caps, total = 3 * sizes, sizes.sum()
    full = np.zeros(50_000, bool)
    while True:
        level = (total - caps[full].sum()) / weights[~full].sum()
        over = ~full & (level * weights > caps)
        if not over.any():
            break
        full |= over
    want = np.where(full, caps, level * weights)
    assert np.allclose(got.loc[names], want, rtol=1e-9)
    assert math.isclose(got.sum(), total, rel_tol=1e-9)


def test_running_totals_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_PARTS", 3)
    rows = spark.range(500).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 20).alias("part"), "id")
    got = mixture._running(rows, ["k"], "part", [F.col("id")], "id", "upto").collect()
    assert len(got) == 500
    assert all(r.upto == sum(range(r.k, r.id + 1, 2)) for r in got)
