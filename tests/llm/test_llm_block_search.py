import numpy as np
import pytest

from medalmart.llm import block_search
from medalmart.llm.block_search import nearest, products, quantised
from pyspark.sql import functions as F


def brute(rows, k):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in use:
        if q % 20 == 0:
            best = sorted({(-float(products(x[None], y[None])[0]), i) for i, y in use if i != q and len(y) == len(x)})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size", [(4096, 8192), (3, 11)])
@pytest.mark.parametrize("k", [5, 400])
def test_exact_with_ties_and_odd_vectors(spark, size, k):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1, 160)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]  # a third are one vector
    rows += [(200, None), (220, []), (240, [0.0] * 16), (260, [float("nan")] * 16), (280, [None] * 16), (300, [float("inf")] + [0.0] * 15)]
    rows += [(320, [1.0, 2.0]), (321, [1.0, 2.0]), (322, [0.5, 1024.0]), (None, rows[5][1]), rows[7]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(frame, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k, queries=size[0], candidates=size[1])
    assert sorted(map(tuple, got.collect())) == brute(list(dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows)), k)
    assert nearest(frame.limit(0), F.lit(True)).count() == 0


def test_repeated_rows_do_not_fill_a_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 61)]
    frame = spark.createDataFrame(rows + [rows[6]] * 600, "vec_id long, embedding array<float>")
    real = block_search._tiles

    def watched(k):
        run = real(k)

        def small(queries, candidates):
            assert len(candidates) <= 60, f"{len(candidates)} candidates in a block"
            return run(queries, candidates)

        return small

    monkeypatch.setattr(block_search, "_tiles", watched)
    asks = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    got = sorted(map(tuple, nearest(frame, asks, 5, candidates=100).collect()))
    assert got == brute([(i, tuple(np.float32(v).tolist())) for i, v in rows], 5)


def test_heaps_keep_the_best_whatever_is_held(spark, monkeypatch):
    monkeypatch.setattr(block_search, "HELD", 30)  # lists go on after a few queries
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(1, 300)]  # many ties
    for kind in ("float", "double", "int"):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding AS array<{kind}>) AS embedding")
        got = nearest(frame, F.col("vec_id") % 20 == 0, 7, queries=4, candidates=40)
        assert sorted(map(tuple, got.collect())) == brute([(i, tuple(v)) for i, v in rows], 7)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 32)) * np.exp(rng.normal(size=(200, 1)) * 3), rng.normal(size=(200, 32))
    (a, s, n, e), (b, t, m, f) = quantised(x), quantised(y)
    near = (a.astype(float) * b).sum(1) * s * t
    assert (np.abs(near - (x * y).sum(1)) <= n * f + e * (m + f) + 1e-12).all()
