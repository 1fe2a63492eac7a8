"""Quality classifier (operator 5): positive-unlabelled learning.

Trusted positives and unlabelled text (web text as it comes) are the only training
data; no negative is ever labelled.  A first network tells positives from unlabelled;
the share of unlabelled text that its best threshold still calls positive, against the
same for positives, estimates the class prior.  The classifier then minimises the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)), by Adam on mini-batches, where a batch whose negative risk falls below
zero takes a step back instead.

Features are of form only: how often each kind of byte follows each other kind, how
much the words repeat, and lengths.  Gradient steps take about ``POSITIVES`` labelled
and ``UNLABELLED`` unlabelled texts (documented bounds; a hash of the id chooses).  The
class prior is of all documents: each task counts how many of its texts score above
each of ``CUTS`` thresholds.  Every whole text is scored.

Edge cases: null texts are scored as empty; very long texts cost one pass over their
bytes; without positives or unlabelled text the score is the prior assumed, 0.5.
Repeated rows get equal scores; repeated positive texts teach once; null ids, labels
and texts teach nothing.  An empty table gives an empty result; only id, text and the
label are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import fold, labelled, sampled, share_of
from .storage import table

POSITIVES, UNLABELLED, HIDDEN, STEPS, BATCH, SEED, CUTS, MARGIN = 6000, 12000, 16, 1200, 1024, 11, 200, 0.94
#: At this score and above a document passes.
THRESHOLD = 0.3

#: Kinds of bytes, in order; what is in none is of the last kind.
KINDS = [b" ", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"'\"()-", b"|", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))]
N_KINDS = len(KINDS) + 1
N_FEATURES = N_KINDS**2 + 4
_KIND_OF = np.full(256, N_KINDS - 1, np.uint8)
for _i, _bytes in enumerate(KINDS):
    _KIND_OF[list(_bytes)] = _i


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte-kind pairs, then repetition and length."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kinds = _KIND_OF[raw]
    pairs = np.bincount(kinds[:-1] * np.uint8(N_KINDS) + kinds[1:], minlength=N_KINDS**2) if len(kinds) > 1 else np.zeros(N_KINDS**2)
    words = (text or "").split()
    n = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / n
    few = len(set(words)) / n**0.9
    return np.concatenate([np.sqrt(pairs / max(1, len(kinds) - 1)), [np.sqrt(again), few, np.log1p(len(words)), np.log1p(len(raw) / n)]]).astype(np.float32)


def _column(text: Column, score) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score(np.stack([features(x) for x in batch])) if len(batch) else [], dtype=float)

    return scored(text)


def feature_rows(texts: DataFrame) -> np.ndarray:
    """The features of a bounded sample, on the driver."""

    @F.pandas_udf("array<float>")
    def make(batch: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in batch])

    rows = texts.select(make("text").alias("f")).toPandas().f
    return np.array(rows.tolist(), np.float32).reshape(len(rows), N_FEATURES)


class Network:
    """One hidden layer of tanh on standardised features, a logit out."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = [r.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(x) for x in self.w]
        self.v = [np.zeros_like(x) for x in self.w]
        self.t = 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def step(self, x: np.ndarray, slope, rate: float = 0.01) -> None:
        """One Adam step; ``slope`` gives the risk's derivative by each logit."""
        s = self.standard(x)
        h = np.tanh(s @ self.w[0] + self.w[1])
        d = slope(h @ self.w[2] + self.w[3])
        back = np.outer(d, self.w[2]) * (1 - h**2)
        grads = [s.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(positives: np.ndarray, other: np.ndarray, prior: float | None, steps: int, seed: int = SEED) -> Network:
    """Non-negative risk for a prior; without one, positives against the others."""
    every = np.concatenate([positives, other])
    net = Network(every.mean(0), every.std(0) + 1e-3, seed)
    r = np.random.default_rng(seed)
    for _ in range(steps):
        p, u = positives[r.integers(len(positives), size=BATCH)], other[r.integers(len(other), size=BATCH)]

        def slope(z: np.ndarray) -> np.ndarray:
            zp, zu = z[:BATCH], z[BATCH:]
            up, down_u, down_p = (_sigmoid(zp) - 1) / BATCH, _sigmoid(zu) / BATCH, _sigmoid(zp) / BATCH
            if prior is None:
                return np.concatenate([up, down_u])
            loss = lambda z: np.logaddexp(0, z).mean()  # noqa: E731  of calling it negative
            if loss(zu) - prior * loss(zp) < 0:
                return np.concatenate([prior * down_p, -down_u])
            return np.concatenate([prior * up - prior * down_p, down_u])

        net.step(np.concatenate([p, u]), slope)
    return net


def class_prior(positives: np.ndarray, other: np.ndarray, least: float = 0.2) -> float:
    """Share of positives among others, from scores of a classifier that tells the two
    apart: the least ratio of the shares above a threshold, over thresholds that keep
    ``least`` of the positives.  ``MARGIN`` takes a little off: the ratio is never below the
    share but for noise, and while a prior a little too small lowers all scores a little,
    one too large hides the rarest kind of negative.

    ``other``: how many of the others lie above each of ``cuts_of(positives)``, after
    the number of all of them."""
    cuts = cuts_of(positives, least)
    p, u = 1 - np.searchsorted(np.sort(positives), cuts) / len(positives), other[1:] / max(1, other[0])
    return float(np.clip(MARGIN * (u / np.maximum(p, 1e-9)).min(), 0.01, 0.99))


def cuts_of(positives: np.ndarray, least: float = 0.2) -> np.ndarray:
    return np.quantile(positives, np.linspace(0, 1 - least, CUTS))


def above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The number of scores, and of those at or above each cut."""
    return np.append(len(scores), len(scores) - np.searchsorted(np.sort(scores), cuts))


def counted_above(texts: DataFrame, net: Network, cuts: np.ndarray) -> np.ndarray:
    """``above`` for the logits of all texts: a row of numbers from each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(cuts) + 1, np.int64)
        for pdf in batches:
            if len(pdf):
                total += above(net.logit(np.stack([features(x) for x in pdf.text])), cuts)
        yield pd.DataFrame({"place": np.arange(len(total)), "n": total})

    rows = texts.mapInPandas(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(cuts) + 1, np.int64)
    for r in rows:
        out[r.place] = r.n
    return out


class QualityModel:
    def __init__(self, net: Network | None, prior: float) -> None:
        self.net, self.prior = net, prior

    def score(self, text: Column) -> Column:
        """Probability of good quality, 0 to 1, of a text column."""
        return _column(text, self.net.score) if self.net else F.lit(self.prior)


def fit_quality(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, others: int = UNLABELLED, steps: int = STEPS) -> QualityModel:
    trusted = labels.where("quality = 1")
    p = feature_rows(labelled(docs, trusted, "quality", most=positives))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text")
    chosen = share_of(texts.count(), others)
    # the classifier that the prior comes from learns from one half of the sample and is read on all documents but those
    half = sampled("unlabelled", chosen / 2)
    rest = sampled("unlabelled", chosen) & ~half
    first, second = feature_rows(texts.where(half).select("text")), feature_rows(texts.where(rest).select("text"))
    u = np.concatenate([first, second])
    if len(p) < 10 or len(first) < 5 or len(second) < 5:
        return QualityModel(None, 0.5)
    own = np.arange(len(p)) % 2 == 0
    teller = _train(p[own], first, None, steps // 2)
    scores = teller.logit(p[~own])
    prior = class_prior(scores, counted_above(texts.where(~half).select("text"), teller, cuts_of(scores)))
    return QualityModel(_train(p, u, prior, steps), prior)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
