"""LM scoring (operator 3): deleted interpolation of an n-gram model.

The probability of a token is a mixture of its maximum-likelihood estimates given 1 to
``order`` - 1 tokens before it, its share of all tokens, and the class of tokens that
training has not seen.  The weights of the mixture depend on how often the contexts
were seen (buckets of powers of two) and are learned by expectation-maximisation on
counts of a held-out ("deleted") part of the training documents, against counts of the
retained part; scores use counts of both.

How it is spread: documents are dealt into blocks by a hash of id and text.  A block
lists its distinct n-grams once, however often they occur in it, as sorted hashes,
which are dealt by hash range to counting tasks; these return the corpus counts to
each block in the order of its list.  So a hot word or word pair costs one entry for
each block, texts move as compressed blocks only, and nothing is gathered on the
driver but a histogram of bounded size (``Q`` steps for an octave).  Blocks and hash
ranges grow with the square root of the input until they reach a size that a task
holds in memory, so the lists that blocks and tasks exchange grow in proportion.

Words and n-grams are hashed to 64 bits.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import fold
from .storage import table, trim, written

ORDER, DELETED, Q = 2, 8, 4
BLOCK_CHARS = 500_000, 16_000_000
REMEMBERED, EM_ROUNDS = 100_000, 100
START, END, SEED = 0x5BD1E995_9E3779B9, 0x2545F491_4F6CDD1D, 77


class _Hashes(dict):
    """Hashes of words; bounded, as it is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_hashes = _Hashes()


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes.lower and bytes.split know only ASCII, and
    split at the space and the controls 9 to 13."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


class Block:
    """The n-grams of some documents.  ``levels[k - 1]`` has the hash of the k-gram that
    ends at each place, places being the start, the words and the end of each document;
    at a start it stands for the start itself, as the context of what follows."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        lists = [tokens(x) for x in texts]
        self.lengths = np.array([len(x) + 1 for x in lists], np.int64)  # with the end, without the start
        first = np.full(1, START, np.uint64)
        last = np.full(1, END, np.uint64)
        parts = []
        for words in lists:
            parts += [first, np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)), last]
        unigrams = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.is_start = np.zeros(len(unigrams), bool)
        self.is_start[starts] = True
        self.levels = [unigrams]
        for k in range(2, order + 1):
            before = np.roll(self.levels[-1], 1)
            here = _mixed(before, unigrams)
            here[self.is_start] = START + k
            self.levels.append(here)

    def of_places(self, per_document: np.ndarray) -> np.ndarray:
        return np.repeat(per_document, self.lengths + 1)


def _range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of a hash; ranges rise with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Rising numbers as differences, their bytes by significance, as many as are used."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    steps[:1] = values[:1]
    width = max(1, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    head = np.array([width], "u1").tobytes() + (values[:1].astype("<u8").tobytes() if len(values) else b"")
    return head + np.ascontiguousarray(steps[1:].view("u1").reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    width = data[0]
    rest = np.frombuffer(data, "u1", offset=9).reshape(width, -1)
    steps = np.zeros((rest.shape[1] + 1, 8), "u1")
    steps[1:, :width] = rest.T
    steps = steps.view("<u8").ravel()
    steps[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    with np.errstate(over="ignore"):
        return np.cumsum(steps, dtype=np.uint64)


def _counts(values: np.ndarray) -> bytes:
    """Counts at the width of the largest."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if values.max(initial=0) <= np.iinfo(k).max)
    return kind[2].encode() + values.astype(kind).tobytes()


def _from_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{chr(data[0])}", offset=1).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, id, trains, text) -> a compressed Arrow table for each block and batch."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        of = batch.column("block").to_numpy()
        order = np.argsort(of, kind="stable")
        rows = batch.select(["id", "trains", "text"]).take(pa.array(order))
        found, starts = np.unique(of[order], return_index=True)
        blobs = []
        for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
            out = io.BytesIO()
            with pa.ipc.new_stream(out, rows.schema) as stream:
                stream.write_batch(rows.slice(a, b - a))
            blobs.append(squeeze.compress(out.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], ["block", "docs"])
    trim()


def _documents(blobs: pd.Series) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_all() for x in blobs])


LISTS = "part int, block long, level int, grams binary, counts binary"


def _list(order: int, parts: int):
    """A block's distinct n-grams, with their counts in its training documents."""

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        docs = _documents(pdf.docs)
        block = Block(docs["text"].to_pylist(), order)
        trains = block.of_places(docs["trains"].to_numpy(zero_copy_only=False))
        rows = []
        for level, grams in enumerate(block.levels, 1):
            found, place = np.unique(grams, return_inverse=True)
            counts = np.bincount(place.ravel(), trains, len(found)).astype(np.int64)
            present, starts = np.unique(_range_of(found, parts), return_index=True)
            for part, a, b in zip(present, starts, [*starts[1:], len(found)], strict=True):
                rows.append((part, key[0], level, _planes(found[a:b]), _counts(counts[a:b])))
        return pd.DataFrame(rows, columns=["part", "block", "level", "grams", "counts"])

    return make


COUNTED = "part int, block long, level int, counts binary, retained binary, known long, total long, retained_total long"


def _count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of a hash range's n-grams, returned to each block in its list's order
    (which it can make again), and a row of sums under block -1: distinct known words and
    their counts."""
    lists = [_from_planes(x) for x in pdf.grams]
    counts = [_from_counts(x) for x in pdf.counts]
    deleted = pdf.block.to_numpy() % DELETED == 0
    sizes = [len(x) for x in lists]
    found, place = np.unique(np.concatenate(lists), return_inverse=True)
    place, each = place.ravel(), np.concatenate(counts)
    every = np.bincount(place, each, len(found)).astype(np.int64)
    kept = np.bincount(place, np.where(np.repeat(deleted, sizes), 0, each), len(found)).astype(np.int64)
    ends = np.cumsum(sizes)
    mine = [place[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    out = pdf[["part", "block", "level"]].copy()
    out["counts"] = [_counts(every[x]) for x in mine]
    out["retained"] = [_counts(kept[x]) if d else None for x, d in zip(mine, deleted, strict=True)]
    out["known"] = out["total"] = out["retained_total"] = 0
    if key[1] == 1:
        words = found != np.uint64(START)
        out.loc[len(out)] = [key[0], -1, 1, b"", None, int((every[words] > 0).sum()), int(every[words].sum()), int(kept[words].sum())]
    return out


class _Counted:
    """A block's n-grams with the counts that came back for it."""

    def __init__(self, docs: pa.Table, back: pd.DataFrame, order: int, parts: int, column: str) -> None:
        self.block = Block(docs["text"].to_pylist(), order)
        self.counts = []
        for level, grams in enumerate(self.block.levels, 1):
            rows = back[back.level == level].sort_values("part")
            found, place = np.unique(grams, return_inverse=True)
            part = _range_of(found, parts)
            starts, stops = np.searchsorted(part, rows.part.to_numpy()), np.searchsorted(part, rows.part.to_numpy(), "right")
            out = np.zeros(len(found), np.int64)
            for data, a, b in zip(rows[column], starts, stops, strict=True):
                out[a:b] = _from_counts(data)
            self.counts.append(out[place.ravel()])
        self.events = np.flatnonzero(~self.block.is_start)

    def estimates(self, total: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For each token: whether it is unknown, its estimates by context length, and the
        bucket of its contexts' counts."""
        e = self.events
        c = [x[e] for x in self.counts]
        shares = [c[0] / max(1, total)]
        bucket = np.zeros(len(e), np.int64)
        for k in range(1, len(c)):
            context = self.counts[k - 1][e - 1]
            shares.append(np.divide(c[k], context, out=np.zeros(len(e)), where=context > 0))
            bucket = bucket * 32 + np.minimum(31, np.where(context > 0, 1 + np.log2(np.maximum(1, context)).astype(np.int64), 0))
        return c[0] == 0, shares, bucket


def _histogram(order: int, parts: int, total: int):
    """Tokens of a deleted block's training documents, by estimates in steps of 1/Q octave."""

    def make(key: tuple, docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        got = _documents(docs.docs) if len(docs) else None
        if got is None or not len(back):
            return pd.DataFrame({"cell": [], "n": []})
        known = _Counted(got, back, order, parts, "retained")
        trains = known.block.of_places(got["trains"].to_numpy(zero_copy_only=False))[known.events]
        unknown, shares, cell = known.estimates(total)
        cell = cell * 2 + unknown
        for p in shares:
            with np.errstate(divide="ignore"):
                step = np.where(p > 0, np.minimum(254, np.rint(-np.log2(p) * Q)) + 1, 0).astype(np.int64)
            cell = cell * 256 + step
        cells, n = np.unique(cell[trains], return_counts=True)
        return pd.DataFrame({"cell": cells, "n": n})

    return make


def mixture_weights(cells: np.ndarray, n: np.ndarray, order: int, rounds: int = EM_ROUNDS) -> dict[int, np.ndarray]:
    """Bucket -> weights of (unknown, 1-gram, ..), by expectation-maximisation."""
    estimates = np.zeros((len(cells), order + 1))
    rest = cells.copy()
    for k in range(order, 0, -1):
        step, rest = rest % 256, rest // 256
        estimates[:, k] = np.where(step > 0, 2.0 ** (-(step - 1.0) / Q), 0)
    estimates[:, 0], bucket = rest % 2, rest // 2
    out = {}
    for b in np.unique(bucket):
        p, m = estimates[bucket == b], n[bucket == b].astype(float)
        weights = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            part = p * weights
            share = part / np.maximum(part.sum(1, keepdims=True), 1e-300)
            weights = (share * m[:, None]).sum(0) + 1e-3
            weights /= weights.sum()
        out[int(b)] = weights
    return out


def _score(order: int, parts: int, stats: tuple[int, int], weights: dict[int, np.ndarray], columns: list[str]):
    total, distinct = stats
    default = np.full(order + 1, 1 / (order + 1))

    def score(key: tuple, docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c: [] for c in columns})
        got = _documents(docs.docs)
        known = _Counted(got, back, order, parts, "counts")
        unknown, shares, bucket = known.estimates(total)
        buckets, place = np.unique(bucket, return_inverse=True)
        learned = np.array([weights.get(int(b), default) for b in buckets]).reshape(-1, order + 1)
        # a context that was never seen says nothing: its weight goes to the others
        for k in range(2, order + 1):
            learned[(buckets >> 5 * (order - k)) % 32 == 0, k] = 0
        learned /= learned.sum(1, keepdims=True)
        w = learned[place.ravel()]
        p = w[:, 0] * unknown
        for k, share in enumerate(shares, 1):
            p = p + w[:, k] * share
        c = known.counts[0][known.events]
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        lengths = known.block.lengths
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({"id": got["id"].to_pandas(), "n_tokens": lengths, "n_known": add((c > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(np.maximum(p, 1e-300)))})

    return score


def lm_scores(docs: DataFrame, trains, *, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``trains`` is a boolean column: whether the model learns from the document (null: no).
    ``score`` is the log10 probability of the text's words and end; ``base_score`` that
    of a 1-gram model with half a count added.

    Edge cases: null and empty texts are the end alone; repeated rows and null ids are
    documents as others; without training documents every token is unknown; without a
    deleted part the weights are equal.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(trains, F.lit(False)).alias("trains"), F.col(text_col).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    block_chars = min(BLOCK_CHARS[1], max(BLOCK_CHARS[0], int(64 * math.sqrt(chars))))
    blocks = max(2 * DELETED, -(-chars // block_chars))
    parts = max(16, blocks // 2)
    dealt = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"), "id", "trains", "text")
    packed = lambda d: d.mapInArrow(_pack, "block long, docs binary")
    lists = packed(dealt).groupBy("block").applyInPandas(_list(order, parts), LISTS)
    counted = written(lists.groupBy("part", "level").applyInPandas(_count, COUNTED), "lm-counts")
    known, total, retained = counted.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "total", "retained_total")]).first()
    back = counted.where("block >= 0").select("part", "block", "level", "counts")
    held = F.col("block") % DELETED == 0
    kept = counted.where("block >= 0").where(held).select("part", "block", "level", "retained")
    histogram = packed(dealt.where(held)).groupBy("block").cogroup(kept.groupBy("block")).applyInPandas(_histogram(order, parts, retained), "cell long, n long")
    cells = histogram.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    weights = mixture_weights(cells.cell.to_numpy(np.int64), cells.n.to_numpy(np.int64), order)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    score = _score(order, parts, (total, known), weights, ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return packed(dealt).groupBy("block").cogroup(back.groupBy("block")).applyInPandas(score, schema).withColumnRenamed("id", "doc_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scores(docs, fold(F.col("doc_id")) != 1)
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
