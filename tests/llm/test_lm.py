import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lm


def brute(rows, weights, order=2):
    """rows: (id, trains, text) -> id -> (n_tokens, n_known, N, base, score), with the same
    weights (unknown, 1-gram, ..) for every bucket."""
    counts = [Counter() for _ in range(order + 1)]
    tokens = [["<s>", *(text or "").encode().lower().split(), "</s>"] for _, _, text in rows]
    for (_, trains, _), t in zip(rows, tokens, strict=True):
        if trains:
            padded = ["<p>"] * (order - 2) + t if order > 1 else t
            start = len(padded) - len(t) + 1
            for i in range(start, len(padded)):
                for k in range(1, order + 1):
                    counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    total, distinct = sum(counts[1].values()), len(counts[1])
    contexts = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for gram, c in counts[k].items():
            contexts[k][gram[:-1]] += c
    out = []
    for (i, _, _), t in zip(rows, tokens, strict=True):
        padded = ["<p>"] * (order - 2) + t if order > 1 else t
        start = len(padded) - len(t) + 1
        base = score = known = 0
        for j in range(start, len(padded)):
            c = counts[1][(padded[j],)]
            known += c > 0
            base += math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            w = [weights[0], weights[1]] + [weights[k] if contexts[k][tuple(padded[j - k + 1 : j])] else 0 for k in range(2, order + 1)]
            p = [c == 0, c / max(1, total)] + [counts[k][tuple(padded[j - k + 1 : j + 1])] / max(1, contexts[k][tuple(padded[j - k + 1 : j])]) for k in range(2, order + 1)]
            score += math.log10(sum(a * b for a, b in zip(w, p, strict=True)) / sum(w))
        out.append((i, len(t) - 1, known, total, base, score))
    return out


ROWS = [
    (1, True, "the cat sat on the mat"), (2, True, "The cat ran"), (3, False, "the dog sat"), (4, True, None), (5, True, ""), (6, False, None), (7, True, "a\tb\x0bc d\n"), (7, True, "a b"), (None, True, "the cat"),
    (None, False, "zzz"), (8, None, "the"), (9, True, "w " * 3000), (10, False, "É é"),
]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_of_odd_rows(spark, monkeypatch, order):
    fixed = np.array([0.1, 0.4, 0.3, 0.2][: order + 1])
    monkeypatch.setattr(lm, "mixture_weights", lambda cells, n, o: dict.fromkeys(range(32**2), fixed))
    df = spark.createDataFrame([(i, t, x, 1) for i, t, x in ROWS], "doc_id long, trains boolean, text string, score int")
    got = sorted((tuple(r) for r in lm.lm_scores(df, F.col("trains"), order=order).collect()), key=str)
    want = sorted(brute([(i, bool(t), x) for i, t, x in ROWS], fixed, order), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.lm_scores(df, F.lit(False)).collect()}
    assert rows[1].train_tokens == 0 and rows[1].n_known == 0 and rows[1].base_score == 0 and math.isfinite(rows[1].score)
    assert lm.lm_scores(df.limit(0), F.lit(True)).count() == 0


def test_weights_raise_the_likelihood():
    r = np.random.default_rng(1)
    steps = r.integers(1, 60, (500, 2))
    unknown = r.random(500) < 0.1
    cells = ((3 * 2 + unknown) * 256 + np.where(unknown, 0, steps[:, 0])) * 256 + np.where(unknown, 0, steps[:, 1])
    n = r.integers(1, 9, 500)
    p = np.stack([unknown, np.where(unknown, 0, 2.0 ** (-(steps[:, 0] - 1) / lm.Q)), np.where(unknown, 0, 2.0 ** (-(steps[:, 1] - 1) / lm.Q))], axis=1)
    likelihood = [n @ np.log(p @ lm.mixture_weights(cells, n, 2, rounds)[3]) for rounds in (1, 5, 100)]
    assert likelihood == sorted(likelihood)
    best = lm.mixture_weights(cells, n, 2)[3]
    for other in r.dirichlet(np.ones(3), 200):
        assert n @ np.log(p @ other) <= n @ np.log(p @ best) + 1e-2


def test_packing():
    r = np.random.default_rng(2)
    for values in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.unique(r.integers(0, 2**63, 999, dtype=np.uint64)), np.array([0, 2**64 - 1], np.uint64)):
        assert (lm._from_planes(lm._planes(values)) == values).all()
    for counts in ([], [0, 255], [256], [70_000], [2**40]):
        assert lm._from_counts(lm._counts(np.array(counts, np.int64))).tolist() == counts


def test_whole_table(spark):
    middle = "/root/testdata/sf0.01"
    docs = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 != 1, r.text) for r in spark.read.parquet(f"{middle}/documents.parquet").collect()]
    got = {r.doc_id: r for r in lm.op3_lm_score(spark, middle).collect()}
    for i, n, known, total, base, _ in brute(docs, [0.1, 0.4, 0.5]):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in got.values() if r.held_out]
    # no worse than any weights chosen by hand, and far better than the base
    for weights in ([0.1, 0.4, 0.5], [0.2, 0.6, 0.2], [0.05, 0.9, 0.05]):
        by_hand = {x[0]: x[-1] for x in brute(docs, weights)}
        assert sum(r.score for r in held) >= sum(by_hand[r.doc_id] for r in held)
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
