import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm.neighbours import _quantise, nearest


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, tile string, dim string").repartition(3)


def brute(rows, k):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    out = {}
    for q, a in usable.items():
        if q % 4 == 0:
            scores = []
            for x, b in usable.items():
                if x != q and len(a) == len(b):
                    total = 0.0
                    for s, t in zip(a, b):
                        total += float(np.float32(s)) * float(np.float32(t))
                    scores.append((-total, x))
            out[q] = [(x, -s) for s, x in heapq.nsmallest(k, scores)]
    return {q: r for q, r in out.items() if r}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("tile,block", [(1 << 19, 1 << 16), (100, 30)])
def test_exact_however_the_cells_are_cut(spark, tile, block):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.standard_normal((200, 8)), 1).astype(np.float32)
    vectors[50:90] = vectors[7]  # a group of copies, with ties everywhere
    rows = [(i, v.tolist(), "t", "d") for i, v in enumerate(vectors)]
    rows += [(1000, None, "", ""), (1004, [0.0] * 8, "", ""), (1008, [1.0, None] * 4, "", ""), (None, [1.0] * 8, "", "")]
    rows += [(1012, [float("nan")] + [1.0] * 7, "", ""), (1016, [float("inf")] + [1.0] * 7, "", ""), (1020, [], "", "")]
    rows += [(2000, [1.0, 2.0], "", ""), (2001, [3.0, -1.0], "", ""), (2004, [3.0] * 3, "", ""), (2001, [3.0, -1.0], "", "")]
    df = nearest(frame(spark, rows), F.col("id") % 4 == 0, k=7, tile_values=tile, block_values=block)
    assert found(df) == brute(rows, 7)


def test_no_vectors(spark):
    assert nearest(frame(spark, []), F.lit(True)).collect() == []
    assert nearest(frame(spark, [(1, [1.0], "", "")]), F.lit(True)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((2, 60, 24)) * np.array([1e-3, 1, 50] * 20)[:, None]
    xc, xs, x_kept, x_rest, x_norm = _quantise(x)
    yc, ys, y_kept, y_rest, _ = _quantise(y)
    near = (yc @ xc.T) * ys[:, None] * xs[None, :]
    slack = y_kept[:, None] * x_rest[None, :] + y_rest[:, None] * x_norm[None, :]
    assert (np.abs(near - y @ x.T) <= slack * (1 + 1e-6)).all()
