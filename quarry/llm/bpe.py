"""Byte-level BPE encoding and decoding (operator 8).

Each match of the pre-token pattern is merged by itself.  Merging keeps the pieces
in a linked list over byte positions and the possible merges in a rank queue: a
bucket of positions per merge rank, and a two-level bitmap whose set bits say
which buckets hold something.  Find-first-set on the bitmap gives the next rank,
the bucket gives its leftmost position, and entries that a merge has made stale
are skipped.  A pre-token of n bytes takes O(n log n) however long it is; a scan
for the lowest rank after each merge would take O(n^2).

Texts are whole; null is empty and gives no ids; a surrogate alone (which Spark strings
don't hold) is encoded as ``?``.  Repeated rows are encoded each; an empty table gives
an empty result; columns other than those named are not read, whatever their names.
The vocabulary is read by the driver and broadcast: its size is fixed by its file
(about 50,000 entries).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table, trim

#: Bits of a bitmap word (as a power of two); pre-tokens whose ids a worker remembers, and their greatest length.
WORD_SHIFT, REMEMBERED, REMEMBERED_LENGTH = 8, 250_000, 64
WORD_MASK = (1 << WORD_SHIFT) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class RankQueue:
    """Positions by rank; the lowest rank, and its leftmost position, come first."""

    __slots__ = ("buckets", "high", "low")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.high = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> WORD_SHIFT
        self.low[word] = self.low.get(word, 0) | 1 << (rank & WORD_MASK)
        self.high |= 1 << word

    def pop(self) -> tuple[int, int]:
        """(rank, position); the queue must not be empty (``high`` is then 0)."""
        high, low = self.high, self.low
        word = (high & -high).bit_length() - 1
        bits = low[word]
        rank = (word << WORD_SHIFT) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        bits &= bits - 1
        low[word] = bits
        if not bits:
            self.high = high & (high - 1)
        return rank, bucket[0]


def merge(piece: bytes, rank_of) -> list[int]:
    """The ids of one pre-token; ``rank_of`` gives the rank of a byte string, or None.
    Every single byte must have a rank."""
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # the piece at i is piece[i:after[i]], and the next one starts there
    before = list(range(-1, n))
    wanted = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # the rank of the pair that starts at i
    wanted.append(None)
    queue = RankQueue()
    push, pop = queue.push, queue.pop
    for i, rank in enumerate(wanted):
        if rank is not None:
            push(rank, i)
    while queue.high:
        rank, i = pop()
        if wanted[i] != rank:
            continue  # stale: a merge has taken or changed one of the pair's pieces
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        wanted[j] = wanted[i] = None
        if k < n and (again := rank_of(piece[i : after[k]])) is not None:
            wanted[i] = again
            push(again, i)
        if i:
            p = before[i]
            again = rank_of(piece[p:k])
            if again is not None and again != wanted[p]:
                push(again, p)
            wanted[p] = again
    ids, i = [], 0
    while i < n:
        ids.append(rank_of(piece[i : after[i]]))
        i = after[i]
    return ids


class Remembered(dict):
    """Ids of short pre-tokens, packed as little-endian unsigned 32-bit integers.  Two
    generations bound its size: what is not asked for while the newer one fills goes."""

    def __init__(self, rank_of, most: int = REMEMBERED) -> None:
        super().__init__()
        self.rank_of, self.most, self.older = rank_of, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", merge(word.encode("utf-8", "replace"), self.rank_of)).tobytes()
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBPE:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.words = regex.compile(pattern).findall
        self.pieces = {i: piece for piece, i in ranks.items()}
        self.known = Remembered(ranks.get, remembered)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.words(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def strings(self, text: str) -> list[str]:
        """The text of each token; what is left of a character goes to the token that ends it."""
        out, held = [], b""
        for i in self.encode(text):
            held += self.pieces[i]
            try:
                out.append(held.decode("utf-8"))
                held = b""
            except UnicodeDecodeError as e:
                # a whole part before the last, unended character belongs to this token
                out.append(held[: e.start].decode("utf-8"))
                held = held[e.start :]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_coders: dict[tuple, ByteBPE] = {}


def _coder(ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> ByteBPE:
    """The coder of this worker, so that remembered pre-tokens outlive a batch and a task."""
    at = (len(ranks), pattern, zlib.crc32(b"".join(ranks)), remembered)
    if at not in _coders:
        _coders.clear()
        _coders[at] = ByteBPE(ranks, pattern, remembered)
    return _coders[at]


def encoded(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """array<int>: the ids of a text column; null texts give an empty array."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            yield pd.Series([coder.encode(x or "") for x in batch], dtype=object)

    return encode(text)


def decoded(spark: SparkSession, ids: Column, ranks: dict[bytes, int]) -> Column:
    """binary: the bytes of an id array; null arrays give no bytes, an unknown id an error."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(shared.value, "")
        for batch in batches:
            yield pd.Series([coder.decode(() if x is None else x) for x in batch], dtype=object)

    return decode(ids)


class BpeTokens:
    """A token counter for ``operators.chunking`` by a vocabulary of this package.  A token
    that ends inside a character is an empty string, and the one that ends it has it."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, (self.ranks, self.pattern) = spark, vocabulary(path)

    def tokens(self, texts: Column) -> Column:
        shared, pattern = self.spark.sparkContext.broadcast(self.ranks), self.pattern

        @F.pandas_udf("array<array<string>>")
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            coder = _coder(shared.value, pattern)
            for batch in batches:
                yield pd.Series([None if row is None else [coder.strings(x or "") for x in row] for row in batch], dtype=object)

        return split(texts)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """A struct of the number of ids, their digest (little-endian unsigned 32-bit) and
    the digest of the bytes they decode to; the ids themselves stay in the worker."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf(DIGESTS)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            rows = []
            for text in batch:
                packed = coder.packed(text or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


ENCODED = DIGESTS + ", ids array<int>"
#: Rows that go back to the JVM at once with their ids.
ROWS_BACK = 256


def encoded_rows(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text_col: str = "text", keep: list[str], remembered: int = REMEMBERED // 4) -> DataFrame:
    """The columns ``keep``, and those of ``round_trip`` with the ids.  Rows go back in
    small batches, so that neither side holds the ids of a whole Arrow batch; a worker,
    which may have served other stages, remembers fewer pre-tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        coder = _coder(shared.value, pattern, remembered)
        for pdf in batches:
            for start in range(0, len(pdf), ROWS_BACK):
                part = pdf.iloc[start : start + ROWS_BACK]
                packed = [coder.packed(x or "") for x in part["_text"]]
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
                back = [hashlib.sha256(coder.decode(x.tolist())).hexdigest() for x in ids]
                yield part.drop(columns="_text").assign(n_tokens=[len(x) for x in ids], ids_sha256=[hashlib.sha256(x).hexdigest() for x in packed], decoded_sha256=back, ids=ids)

    kept = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInPandas(encode, f"{schema}, {ENCODED}")


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and pattern; ``path`` defaults to the public 50k byte-level vocabulary."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = vocabulary()
    return docs.select("doc_id", round_trip(spark, F.col("text"), ranks, pattern).alias("t")).select("doc_id", "t.*")
