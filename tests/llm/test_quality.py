import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality, samples

MIDDLE = "/root/testdata/sf0.01"


def held_out_accuracy(rows, labels, label):
    known = {r.doc_id: r[label] for r in labels.collect()}
    judged = [(r.predicted, known[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in known]
    return np.mean([p == y for p, y, _ in judged]), judged


def test_features():
    assert quality.features(None).shape == quality.features("x" * 300_000).shape
    assert np.isfinite(quality.features("")).all() and np.isfinite(quality.features("é")).all()
    # pairs of kinds: a slow count
    text = "Ab 12!|é"
    kind = lambda b: next((i for i, k in enumerate(quality.KINDS) if b in k), quality.N_KINDS - 1)
    kinds = [kind(b) for b in text.encode()]
    want = np.zeros(quality.N_KINDS**2)
    for a, b in zip(kinds, kinds[1:], strict=False):
        want[a * quality.N_KINDS + b] += 1 / (len(kinds) - 1)
    assert np.allclose(quality.features(text)[: len(want)], np.sqrt(want), atol=1e-6)


def test_prior_and_risk_on_made_up_points():
    r = np.random.default_rng(0)
    good, bad = lambda n: r.normal(1.5, 1, (n, 4)), lambda n: r.normal(-1.5, 1, (n, 4))
    for prior in (0.3, 0.7):
        p, u = good(3000), np.concatenate([good(int(6000 * prior)), bad(6000 - int(6000 * prior))])
        r.shuffle(u)
        teller = quality._train(p[::2], u[::2], None, 400)
        scores = teller.logit(p[1::2])
        found = quality.class_prior(scores, quality.above(teller.logit(u[1::2]), quality.cuts_of(scores)))
        assert abs(found - prior) < 0.08
        net = quality._train(p, u, found, 800)
        assert (net.score(good(2000)) > 0.5).mean() > 0.95 and (net.score(bad(2000)) < 0.5).mean() > 0.95


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = quality.op5_quality_classifier(spark, MIDDLE).collect()
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    accuracy, judged = held_out_accuracy(rows, labels, "quality")
    assert len(judged) > 50 and accuracy >= 0.93
    assert np.mean([p for p, y, _ in judged if y == 1]) >= 0.97  # good documents are kept


def test_held_out_labels_are_never_read(spark):
    docs = spark.createDataFrame([(i, "text %d" % i) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    ids = {r.id for r in samples.labelled(docs, labels, "quality", most=1000).collect()}
    assert ids == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


def test_sample_is_bounded_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i % 900}", 1) for i in range(2000)] + [(None, "n", 1), (5000, None, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, 1, "x") for i in range(2000)] + [(7, 0, "x"), (None, 1, "x"), (5000, 1, "x"), (8, None, "x")], "doc_id long, quality int, text string")
    some = samples.labelled(docs, labels, "quality", most=300).collect()
    assert 200 < len(some) <= 400 and all(r.label == 1 and r.text for r in some)
    assert len({r.text for r in samples.labelled(docs, labels, "quality", most=10_000).collect()}) <= 900
    ids = docs.select(F.col("doc_id").alias("id"))
    some, fewer = ({r.id for r in ids.where(samples.sampled("s", share)).collect()} for share in (0.15, 0.05))
    assert 200 < len(some) < 400 and fewer < some and samples.share_of(0, 9) == samples.share_of(5, 9) == 1


def test_prior_is_of_all_documents(spark):
    """Samples of other sizes move it little; counts above cuts are of every document."""
    docs, labels = (spark.read.parquet(f"{MIDDLE.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    priors = [quality.fit_quality(docs, labels, others=n, steps=300).prior for n in (2000, 4000, 8000)]
    assert max(priors) - min(priors) < 0.06
    net = quality.Network(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    texts = docs.select("text").limit(300)
    cuts = np.array([-0.5, 0.0, 0.5])
    want = quality.above(net.logit(np.stack([quality.features(r.text) for r in texts.collect()])), cuts)
    assert quality.counted_above(texts.repartition(5), net, cuts).tolist() == want.tolist()


@pytest.mark.parametrize("texts", [[], [None, "", "x"]])
def test_too_little_to_learn(spark, texts):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert [r.s for r in docs.select(model.score(F.col("text")).alias("s")).collect()] == [0.5] * len(texts)


def test_query_equals_its_model_on_each_text(spark, small):
    """The query's scores are those of the fitted network on each whole text by itself."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op5_quality_classifier(spark, small).collect():
        assert r.score == pytest.approx(float(model.net.score(quality.features(texts[r.doc_id])[None])[0]), abs=1e-6)
