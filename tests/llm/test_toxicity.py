import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.samples import labelled
from quarry.llm.toxicity import BLOCK, BlockMaxIndex, Examples, ToxicityModel, isotonic

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def random_vectors(r, n, terms):
    out = []
    for _ in range(n):
        t = np.sort(r.choice(terms, r.integers(1, 8), replace=False))
        w = r.exponential(size=len(t))
        out.append((t, (w / np.linalg.norm(w)).astype(np.float32).astype(float)))
    return out


def index_of(vectors, n_terms):
    owner = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    return BlockMaxIndex(np.concatenate([t for t, _ in vectors]), owner, np.concatenate([w for _, w in vectors]), n_terms, len(vectors))


@pytest.mark.parametrize("terms", [9, 60])
def test_neighbours_are_exact(terms):
    """With few terms all are heavy, with many of them few are."""
    r = np.random.default_rng(1)
    vectors = random_vectors(r, 900, terms)
    index = index_of(vectors, terms)
    for q in [*random_vectors(r, 60, terms), (np.array([3]), np.array([1.0])), (np.zeros(0, int), np.zeros(0))]:
        mine = dict(zip(*q, strict=True))
        cosines = np.array([sum(w * mine.get(t, 0) for t, w in zip(*v, strict=True)) for v in vectors])
        want = sorted((-round(c, 9), i) for i, c in enumerate(cosines) if round(c, 9) > 0)[:15]
        places, scores = index.nearest(*q, 15)
        assert list(places) == [i for _, i in want]
        assert np.allclose(scores, [-c for c, _ in want])


def test_blocks_are_skipped():
    """Entries of other terms are in blocks whose bound is zero or below the k-th cosine."""
    vectors = [(np.array([t]), np.array([1.0])) for t in range(100) for _ in range(40)]
    index = index_of(vectors, 100)
    assert index.of_term[8] - index.of_term[7] <= -(-40 // BLOCK) + 1 < index.n_blocks
    assert len(index.nearest(np.array([7]), np.array([1.0]), 15)[0]) == 15


def test_isotonic():
    x, y = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0])
    at, height = isotonic(x, y, np.ones(4))
    assert height.tolist() == [0, 0.5, 1] and np.allclose(at, [0.1, 0.25, 0.4])
    assert (np.diff(isotonic(np.random.default_rng(2).random(200), np.random.default_rng(3).random(200), np.ones(200))[1]) > 0).all()


def examples_of(rows):
    """(id, label, fold, text) as Examples."""
    seen = [Counter(toxicity.words(t)) for *_, t in rows]
    out = pd.DataFrame([r[:3] for r in rows], columns=["id", "label", "fold"])
    return Examples(out.assign(words=[" ".join(x) for x in seen], times=[np.fromiter(x.values(), np.int32, len(x)).tobytes() for x in seen]))


def test_model_by_hand():
    model = ToxicityModel(examples_of([(1, 1.0, 0, "bad bad"), (2, 1.0, 1, "bad ugly"), (3, 0.0, 0, "good"), (4, 0.0, 1, "12")]))
    model.calibrate(np.array([0.9, 0.8, 0.1]), np.array([1.0, 1.0, 0.0]))
    score, shown = model.answer("BAD! bad?")
    assert (shown[0]["doc_id"], shown[0]["toxic"]) == (1, 1.0) and abs(shown[0]["cosine"] - 1) < 1e-6 and score > 0.5
    low, shown = model.answer("good good")
    assert low < 0.5 and shown[0]["doc_id"] == 3
    assert {x["doc_id"] for x in model.answer("bad good")[1]} == {1, 2, 3}
    assert model.answer(None) == model.answer("") == model.answer("unknown words") and model.answer("")[1] == []
    assert 0 <= model.answer("bad " * 100_000)[0] <= 1


def brute_votes(examples, texts):
    """The vote, and cosines with all examples, by dictionaries over all words."""
    terms = lambda text: Counter(toxicity.words(text))
    bags, labels, total = [terms(t) for _, _, t in examples], [y for _, y, _ in examples], len(examples)
    share = sum(labels) / total
    df, toxic = Counter(t for b in bags for t in b), Counter()
    for b, y in zip(bags, labels, strict=True):
        for t in b:
            toxic[t] += y

    def weight(t, n):
        if t not in df:
            return 0.0
        chi = (toxic[t] - df[t] * share) ** 2 / (df[t] * share * (1 - share) * (total - df[t] + 0.5) / total)
        r = (chi / toxicity.HALF) ** toxicity.STEEP
        return (1 + math.log(n)) * (math.log((1 + total) / (1 + df[t])) + 1) * (toxicity.FLOOR + r / (1 + r))

    def unit(bag):
        w = {t: weight(t, n) for t, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items() if x}

    units = [unit(b) for b in bags]
    for text in texts:
        q = unit(terms(text)) if terms(text) else {}
        cosines = np.array([sum(x * u.get(t, 0.0) for t, x in q.items()) for u in units])
        best = np.sort(cosines[cosines > 1e-9])[::-1][: toxicity.NEIGHBOURS]
        near = [i for i in np.argsort(-cosines, kind="stable")[: len(best)]]
        w = cosines[near] ** toxicity.POWER
        yield cosines, float((w @ np.array(labels)[near] + toxicity.PRIOR * share) / (w.sum() + toxicity.PRIOR)) if len(best) else None


def test_query_equals_brute_force(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    examples = sorted((r.id, r.label, r.text) for r in labelled(docs, labels, "toxic", most=toxicity.EXAMPLES).collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted(toxicity.op2_toxicity(spark, small).collect())
    assert [r.doc_id for r in rows] == sorted(texts)
    model = toxicity.fit_toxicity(docs, labels)
    place = {i: n for n, (i, _, _) in enumerate(examples)}
    for r, (cosines, vote) in zip(rows, brute_votes(examples, [texts[r.doc_id] for r in rows]), strict=True):
        vote = model.zero if vote is None else vote
        assert r.score == pytest.approx(0.98 * float(np.interp(vote, *model.steps)) + 0.02 * vote, abs=2e-4)
        assert np.allclose([e.cosine for e in r.evidence], np.sort(cosines)[::-1][: len(r.evidence)], atol=1e-5)
        assert np.allclose([e.cosine for e in r.evidence], [cosines[place[e.doc_id]] for e in r.evidence], atol=1e-5)


@pytest.mark.parametrize(("sf_dir", "recall"), [(MIDDLE, None), (LARGE, 0.9)])
def test_held_out_accuracy(spark, sf_dir, recall):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op2_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [(r.predicted, labels[r.doc_id], r.held_out) for r in rows if r.doc_id in labels]
    assert np.mean([p for p, y, _ in judged if y == 1]) >= 0.9
    assert np.mean([p for p, y, h in judged if h and y == 0]) <= 0.01
    if recall:  # the middle size has six held-out toxic documents only
        assert np.mean([p for p, y, h in judged if h and y == 1]) >= recall
    assert any(e.cosine > 0.5 for r in rows if r.predicted for e in r.evidence)


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1), (2, 1)], [(0, 0), (1, None)]])
def test_little_to_learn_and_odd_rows(spark, labels):
    texts = ["a bad text", None, "", "a bad text", "long " * 50_000]
    docs = spark.createDataFrame([(i, t, 1.0, "e") for i, t in enumerate(texts)] + [(None, "x", 1.0, "e")], "doc_id long, text string, score double, evidence string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = docs.select(model.scored(spark, F.col("text"))["score"].alias("s")).collect()
    assert len(got) == 6 and all(0 <= r.s <= 1 for r in got)
    none = toxicity.fit_toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert none.answer("x")[0] == 0


def test_words_of_few_toxic_examples_count(spark):
    """Each toxic word stands in five toxic examples of 200 (chi-square about 20)."""
    text = lambda i: f"plain w{chr(97 + i % 23)}{chr(97 + i % 19)} text" + (f" {'abcdefgh'[i % 8] * 7}" if i < 40 else "")
    docs = spark.createDataFrame([(i, f"{text(i)} {i}") for i in range(200)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, int(i < 40)) for i in range(200)], "doc_id long, toxic int"))
    assert all(model.answer(f"new {c * 7} words")[0] >= 0.5 for c in "abcdefgh")
    assert model.answer("new words")[0] < 0.5


def test_a_rare_toxic_word_finds_its_example():
    """A word of one toxic example only: its terms count, so the example is found."""
    rows = [(i, 0.0, i % 8, f"plain text w{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)] + [(999, 1.0, 3, "plain text vilewordhere")]
    score, shown = ToxicityModel(examples_of(rows)).answer("vilewordhere plain")
    assert shown[0]["doc_id"] == 999
