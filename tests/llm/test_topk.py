import math

import numpy as np
import pytest

from helpers import duck_rows, spark_rows
from quarry.llm import topk
from quarry.llm.topk import OP10_SQL, BallTree, Best, op10_top_k, search, top_k


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (6, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0]), (12, [2.0]), (14, [-0.5, 0.1]), (-16, [0.1, -0.2]), (18, []), (20, [])]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, score int, query_id string")
    assert got(top_k(df, k=3, every=2)) == brute(rows, 3, 2)
    assert top_k(df.limit(0)).count() == 0
    assert top_k(df.where("vec_id = 0"), every=2).count() == 0


def test_many_ties_and_shards(spark, monkeypatch):
    r = np.random.default_rng(7)
    base = r.normal(size=(40, 6)).round(1)
    rows = [(int(i), base[r.integers(40)].tolist()) for i in r.permutation(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    assert got(top_k(df, k=5, every=50)) == brute(rows, 5, 50)


@pytest.mark.parametrize("broadcast", [topk.BROADCAST_BYTES, 0])
def test_wide_vectors_make_small_shards(spark, monkeypatch, broadcast):
    """Shards and blocks are bounded by bytes; blocks too large to broadcast are dealt."""
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=40).tolist()) for i in range(700)]
    monkeypatch.setattr(topk, "PACK_BYTES", 40 * 8 * 100)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", broadcast)
    made = []
    keep = topk.packed
    monkeypatch.setattr(topk, "packed", lambda v, n, label: made.append(n) or keep(v, n, label))
    assert got(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=5)) == brute(rows, 4, 5)
    assert made[0] == 7 and made[1] == 2


def test_huge_components(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, -3.0]), (2, [-1e12, 5.0]), (3, [1e30, 0.0])]
    out = {(q, i): s for q, _, i, s in got(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4))}
    assert out[0, 1] == (256 * 10**9) ** 2 - 3 * 256 * 256 if (256 * 10**9) ** 2 < 2**63 else out[0, 1] == 2**63 - 1
    assert out[0, 2] == -(2**63) and out[0, 3] == 2**63 - 1


def test_tree_prunes_and_is_exact():
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 16)) * 300
    rows = (centres[r.integers(30, size=4000)] + r.normal(size=(4000, 16)) * 5).astype(np.int64)
    ids, q = np.arange(4000), rows[:50]
    best, seen = Best(np.full(50, topk.LONG[0]), 5), []
    monkey, keep = topk.products, topk.products
    try:
        topk.products = lambda a, b, d: seen.append(len(a) * len(b)) or monkey(a, b, d)
        search(BallTree(rows), ids, q, ids[:50], best)
    finally:
        topk.products = keep
    exact = q @ rows.T
    for i in range(50):
        want = sorted((-exact[i, j], j) for j in range(4000) if j != i)[:5]
        assert [(-s, j) for s, j in want] == list(zip(best.scores[i], best.ids[i], strict=True))
    assert sum(seen) < 0.5 * 50 * 4000


@pytest.mark.parametrize("scale", [1, 2**31])
def test_products_are_exact(scale):
    a = np.array([[3, -5], [7, 11]]) * scale
    assert topk.products(a, a, 2).tolist() == [[max(topk.LONG[0], min(topk.LONG[1], int(x) * int(z) + int(y) * int(w))) for z, w in a] for x, y in a]


def test_whole_table(spark, small):
    assert spark_rows(op10_top_k(spark, small)) == duck_rows(OP10_SQL, small)
