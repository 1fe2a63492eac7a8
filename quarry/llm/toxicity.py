"""Toxicity (operator 2): the nearest labelled examples by exact TF-IDF cosine.

Terms are words, and all of them count: no term is left out of a vector.  Besides its
inverse document frequency a term has an emphasis that rises with how much its presence in examples depends on the label
(chi-square), from ``FLOOR`` to 1 + ``FLOOR``, as in supervised term weighting: a text
with a telling word is near to the examples that have it, one without meets its
neighbours by all it has.

Examples stand in an inverted index whose order puts like ones together.  Each term
has, for every block of examples that it occurs in, the largest weight there and the
place of its postings; the sums of those bounds order the blocks, and blocks are scored
in full, from their slices of the postings, until no bound left exceeds the k-th cosine
so far.  The neighbours found are exact.

Neighbours vote with their labels, weighted by a power of the cosine.  Votes are turned
into probabilities by isotonic regression over the votes that models of the other folds
gave on each example.  The nearest examples are the evidence.

The examples are about ``EXAMPLES`` labelled documents (a documented bound, which also
bounds the index that is broadcast); every whole text is scored.

Edge cases: null and empty texts, and those without a word of any example, are zero
vectors and get the share of toxic examples among zero vectors; very long texts are
one vector; without any example scores are 0; equal cosines are ordered by the
examples' place in the index, which follows from the examples alone.  Repeated rows
get equal scores; repeated texts with labels are one example with the mean label, an id
with several labels takes the largest, null labels and ids teach nothing.  An empty
table gives an empty result; only id, text and the label are read, so further columns
of any name do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import fold, labelled
from .storage import table, trim, written

EXAMPLES, FOLDS = 3000, 8
#: The least emphasis of a term, and the chi-square at which half of the rest is reached.
FLOOR, HALF, STEEP = 0.1, 24.0, 4
NEIGHBOURS, POWER, PRIOR, BLOCK, FIRST_BLOCKS, HEAVY, SHOWN = 15, 4, 0.1, 128, 4, 1 / 8, 3
#: At this score and above a document is toxic.
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for each of some ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class BlockMaxIndex:
    """Postings of unit vectors, by term and block of entries.

    Terms of at least ``HEAVY`` of the entries have their postings filled up with zeros, so
    that a block's slice of them is a row of a matrix; those of others are slices of one
    array, a slice for each block that the term occurs in."""

    def __init__(self, terms: np.ndarray, entries: np.ndarray, weights: np.ndarray, n_terms: int, n_entries: int) -> None:
        """Of each posting the term, the entry and the weight, in any order."""
        self.n_blocks = n = -(-n_entries // BLOCK)
        often = np.flatnonzero(np.bincount(terms, minlength=n_terms) >= max(1.0, n_entries * HEAVY))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        heavy = self.row[terms] >= 0
        self.filled = np.zeros((len(often), n * BLOCK), np.float32)
        self.filled[self.row[terms[heavy]], entries[heavy]] = weights[heavy]
        self.filled = self.filled.reshape(len(often), n, BLOCK)
        self.filled_most = self.filled.max(axis=2, initial=0)
        terms, entries, weights = terms[~heavy], entries[~heavy], weights[~heavy]
        order = np.lexsort((entries, terms))
        terms, entries = terms[order], entries[order]
        self.weights = weights[order].astype(np.float32)
        self.columns = (entries % BLOCK).astype(np.uint8)
        first = np.flatnonzero(np.diff(terms.astype(np.int64) * max(1, n) + entries // BLOCK, prepend=-1))
        self.starts = np.append(first, len(terms)).astype(np.int32)
        self.blocks = (entries[first] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0, np.float32)
        self.of_term = np.searchsorted(terms[first], np.arange(n_terms + 1)).astype(np.int32)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest entries with a positive cosine."""
        row = self.row[terms]
        rows, heavy = row[row >= 0], weights[row >= 0]
        terms, light = terms[row < 0], weights[row < 0]
        sizes = self.of_term[terms + 1] - self.of_term[terms]
        pairs, own = _ranges(self.of_term[terms], sizes), np.repeat(light, sizes)
        of = self.blocks[pairs]
        bound = np.bincount(of, own * self.most[pairs], self.n_blocks) + heavy @ self.filled_most[rows]
        order = np.flatnonzero(bound)
        order = order[np.argsort(-bound[order], kind="stable")]
        places, scores, at, step = np.zeros(0, int), np.zeros(0), 0, FIRST_BLOCKS
        slot = np.full(self.n_blocks, -1)
        while at < len(order) and (len(scores) < k or bound[order[at]] >= scores[-1] - 1e-6):
            chunk = order[at : at + step]
            if len(scores) == k:
                chunk = chunk[bound[chunk] >= scores[-1] - 1e-6]
            slot[chunk] = np.arange(len(chunk))
            mine = np.flatnonzero(slot[of] >= 0)
            starts = self.starts[pairs[mine]]
            n = self.starts[pairs[mine] + 1] - starts
            postings = _ranges(starts, n)
            cells = np.repeat(slot[of[mine]] * BLOCK, n) + self.columns[postings]
            found = np.bincount(cells, np.repeat(own[mine], n) * self.weights[postings], len(chunk) * BLOCK).astype(float)
            found += heavy @ self.filled[rows[:, None], chunk].reshape(len(rows), len(chunk) * BLOCK)
            slot[chunk] = -1
            found = np.round(found, 9)
            hit = np.flatnonzero(found)
            places = np.concatenate([places, chunk[hit // BLOCK] * BLOCK + hit % BLOCK])
            scores = np.concatenate([scores, found[hit]])
            if len(scores) > k:
                some = scores >= np.partition(scores, -k)[-k]
                places, scores = places[some], scores[some]
            best = np.lexsort((places, -scores))[:k]
            places, scores, at, step = places[best], scores[best], at + step, step * 4
        return places, scores


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps that fit (x, y) best: their middles and heights."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Examples:
    """Labelled examples as counts of their words."""

    def __init__(self, rows: pd.DataFrame) -> None:
        """``rows``: id, label, fold, the distinct words, joined by spaces, and their counts
        (int32, as bytes)."""
        self.ids, self.labels, self.folds = rows.id.to_numpy(np.int64), rows.label.to_numpy(float), rows.fold.to_numpy(int)
        self.vocabulary: dict[str, int] = {}
        places = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in x.split(" ") if w), np.int32) for x in rows.words]
        self.sizes = np.array([len(x) for x in places], np.int64)
        self.terms = np.concatenate(places) if places else np.zeros(0, np.int32)
        self.times = np.frombuffer(b"".join(rows.times), np.int32)


def emphasis(n: np.ndarray, positive: np.ndarray, texts: int, share: float) -> np.ndarray:
    """How much a term counts that is in n texts, of which ``positive`` are toxic: by its
    chi-square with the label."""
    spread = n * (share * (1 - share)) * (texts - n + 0.5) / max(1, texts)
    chi = np.divide((positive - n * share) ** 2, spread, out=np.zeros(len(n)), where=spread > 0)
    r = (chi / HALF) ** STEEP
    return FLOOR + r / (1 + r)


class ToxicityModel:
    def __init__(self, examples: Examples, without: int | None = None) -> None:
        """A model of the examples that aren't in the fold ``without``."""
        mine = np.flatnonzero(examples.folds != (-1 if without is None else without))
        starts = np.cumsum(examples.sizes) - examples.sizes
        at = _ranges(starts[mine], examples.sizes[mine])
        terms, owner = examples.terms[at], np.repeat(np.arange(len(mine)), examples.sizes[mine])
        labels, n_terms = examples.labels[mine], len(examples.vocabulary)
        total = len(mine)
        self.share = float(labels.mean()) if total else 0.0
        n, positive = np.bincount(terms, minlength=n_terms), np.bincount(terms, labels[owner], n_terms)
        self.vocabulary = examples.vocabulary
        self.term_weights = (np.log((1 + total) / (1 + n)) + 1) * emphasis(n, positive, total, self.share) * (n > 0)
        weights = (1 + np.log(examples.times[at])) * self.term_weights[terms]
        weights = weights / np.maximum(1e-300, np.sqrt(np.bincount(owner, weights**2, total)))[owner]
        # like examples together: by the heaviest of their terms that many have
        key = np.full(total, -1)
        often = np.flatnonzero(n[terms] >= BLOCK)
        heavy = often[np.lexsort((weights[often], owner[often]))]
        key[owner[heavy]] = terms[heavy]  # the last one of each owner, its heaviest, stays
        place = np.empty(total, int)
        order = np.argsort(key, kind="stable")
        place[order] = np.arange(total)
        self.ids, self.labels = examples.ids[mine][order], labels[order]
        empty = examples.sizes[mine] == 0
        self.zero = float((labels[empty].sum() + self.share) / (empty.sum() + 1))
        self.index = BlockMaxIndex(terms, place[owner], weights, n_terms, total)
        self.calibrate(np.zeros(0), np.zeros(0))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Learns what votes mean; texts without a term are one more point."""
        self.steps = isotonic(np.append(votes, self.zero), np.append(labels, self.zero), np.ones(len(votes) + 1))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the unit TF-IDF vector: (1 + log tf) * idf * emphasis over
        the terms that any example has."""
        seen = Counter(words(text))
        terms = np.fromiter((self.vocabulary.get(w, -1) for w in seen), np.int64, len(seen))
        times = np.fromiter(seen.values(), float, len(seen))
        order = np.argsort(terms, kind="stable")
        order = order[np.searchsorted(terms[order], 0) :]
        return self.unit(terms[order], times[order])

    def unit(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(times)) * self.term_weights[terms]
        some = weights > 0
        terms, weights = terms[some], weights[some]
        return terms, weights / np.sqrt((weights**2).sum()) if len(weights) else weights

    def neighbours(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The vote of a vector, the places of its nearest examples, their cosines."""
        places, cosines = self.index.nearest(terms, weights, NEIGHBOURS)
        if not len(places):
            return self.zero, places, cosines
        w = cosines**POWER
        return float((w @ self.labels[places] + PRIOR * self.share) / (w.sum() + PRIOR)), places, cosines

    def answer(self, text: str | None) -> tuple[float, list]:
        """Score, and the nearest examples: id, cosine and toxic label."""
        vote, places, cosines = self.neighbours(*self.vector(text))
        fitted = float(np.interp(vote, *self.steps))
        shown = [{"doc_id": int(self.ids[p]), "cosine": min(1.0, float(c)), "toxic": float(self.labels[p])} for p, c in zip(places[:SHOWN], cosines, strict=False)]
        return min(1.0, max(0.0, 0.98 * fitted + 0.02 * vote)), shown  # the vote orders what the steps make equal

    def scored(self, spark: SparkSession, text: Column) -> Column:
        """struct<score, evidence> for a text column."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("score double, evidence array<struct<doc_id long, cosine double, toxic double>>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([shared.value.answer(x) for x in batch], columns=["score", "evidence"])
            trim()

        return score(text)


def fold_votes(examples: Examples, part: int) -> pd.DataFrame:
    """The votes of the other folds' examples, which alone weigh the terms, on one fold."""
    model = ToxicityModel(examples, part)
    starts = np.cumsum(examples.sizes) - examples.sizes
    out = []
    for i in np.flatnonzero(examples.folds == part):
        at = slice(starts[i], starts[i] + examples.sizes[i])
        order = np.argsort(examples.terms[at])
        out.append((model.neighbours(*model.unit(examples.terms[at][order], examples.times[at][order]))[0], examples.labels[i]))
    return pd.DataFrame(out, columns=["vote", "label"], dtype=float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, examples: int = EXAMPLES) -> ToxicityModel:
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")
    sample = written(labelled(docs, labels, "toxic", most=examples).withColumn("fold", part), "toxicity-examples")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [Counter(words(x)) for x in pdf.text]
            yield pdf[["id", "label", "fold"]].assign(words=[" ".join(x) for x in seen], times=[np.fromiter(x.values(), np.int32, len(x)).tobytes() for x in seen])

    rows = sample.mapInPandas(count, "id long, label double, fold int, words string, times binary").toPandas().sort_values("id", ignore_index=True)
    known = Examples(rows)
    del rows
    judged = spark.sparkContext.broadcast(known)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf.id:
                yield fold_votes(judged.value, int(i))

    given = spark.range(0, FOLDS, numPartitions=FOLDS).mapInPandas(votes, "vote double, label double").toPandas()
    judged.destroy()
    model = ToxicityModel(known)
    model.calibrate(given.vote.to_numpy(float), given.label.to_numpy(float))
    return model


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), model.scored(spark, F.col("text")).alias("s"))
    return out.select("doc_id", "held_out", "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.evidence")
