"""N-gram Jaccard join (operator 9): MinHash banding, verified on full n-gram sets.

1. Every text becomes the set of 64-bit hashes of its word n-grams, a 128-bit digest
   of the set and a MinHash signature, of which bands of rows are hashed.  The number
   of bands follows from the recall wanted at the threshold.  Texts with equal sets
   are one class from here on, counted where they are read.
2. Classes are dealt by band hash.  A band's classes are joined to the least of them
   only, so a band that a third of all rows share costs that many rows, not pairs;
   connected, these edges give groups that hold both ends of every candidate pair.
3. A group is cut into tiles, and every two tiles of it meet in a task of their own,
   with the full n-gram sets.  Tasks return, for each class, how many rows it is
   similar to and the class that it is connected with, never pairs.
4. Connected again, these give the classes of the join.

Work on a group of m different texts that are all alike grows with m squared, as its
links do, in tiles of bounded size on any number of tasks; rows grow with m * m / TILE.

Words are runs of letters, digits and underscores, lower-cased.  A text of fewer words
than ``n`` has one n-gram, all its words; a text of no words has one, itself; null and
empty texts have none and are similar to nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import table, trim, written

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: Classes and n-grams of a tile; ids that are broadcast at most; columns multiplied at once.
TILE, TILE_GRAMS, BROADCAST_IDS, COLUMNS = 128, 1_000_000, 200_000, 8192
SEED, REMEMBERED = 20240, 100_000

_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Hashes of words; bounded, as it is emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_hashes = _Hashes()


def ngram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct uint64 hashes of the word n-grams."""
    if not text:
        return np.zeros(0, np.uint64)
    words = _WORD.findall(text.lower())
    if not words:
        return np.array([xxhash.xxh64_intdigest(text, SEED + 1)], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands that finds a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class MinHash:
    def __init__(self, bands: int, rows: int) -> None:
        r = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.factor = (r.integers(0, 2**63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.plus = r.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        """int64 hash of each band, different for different bands."""
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), 512):
                np.minimum(least, (grams[at : at + 512, None] * self.factor + self.plus).min(axis=0), out=least)
        cells = least.reshape(self.bands, self.rows)
        return np.array([xxhash.xxh64_intdigest(cells[b].tobytes(), b) for b in range(self.bands)], np.uint64).view(np.int64)


def set_digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def signatures(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """(id, th, text) -> (id, th, sid, n_grams, bands); sid is null for an empty set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinHash(bands, per_band)
        for pdf in batches:
            sids, sizes, found = [], [], []
            for text in pdf.text:
                grams = ngram_set(text, n)
                sizes.append(len(grams))
                sids.append(set_digest(grams) if len(grams) else None)
                found.append(hasher.band_hashes(grams) if len(grams) else [])
            yield pdf[["id", "th"]].assign(sid=sids, n_grams=sizes, bands=found)
        trim()

    return rows.mapInPandas(sign, f"id {rows.schema['id'].dataType.simpleString()}, th long, sid binary, n_grams long, bands array<long>")


def _meet(threshold: float):
    """Two tiles of a group, or one with itself."""

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = key[1], key[2]
        pdf = pdf.drop_duplicates("sid").sort_values("sid", ignore_index=True)
        m = len(pdf)
        sets = [np.frombuffer(x, np.uint64) for x in pdf.grams]
        sizes = np.array([len(x) for x in sets])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
        _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
        column = column.ravel()
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column.ravel()[order]
        common = np.zeros((m, m), np.float64)
        top = column[-1] + 1 if len(column) else 0
        for start in range(0, top, COLUMNS):
            mine = slice(*np.searchsorted(column, (start, start + COLUMNS)))
            part = np.zeros((m, min(COLUMNS, top - start)), np.float32)
            part[owner[mine], column[mine] - start] = 1
            common += part @ part.T
        linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if a != b:
            side = pdf.tile.to_numpy() == a
            linked &= side[:, None] != side[None, :]
        links = linked @ pdf["copies"].to_numpy(np.int64)
        label = np.arange(m)
        while True:  # least index connected; a few rounds
            low = np.where(linked, label[None, :], m).min(axis=1, initial=m)
            new = np.minimum(label, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = links > 0
        return pd.DataFrame({"sid": pdf.sid[some], "links": links[some], "other": pdf.sid.to_numpy()[label[some]]})

    return meet


def jaccard_join(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th (xxhash64 of its text), class_id, n_links, n_copies,
    and keep_th: with class_id, the th of the row that stands for the class.

    ``n_links``: other rows with Jaccard similarity >= ``threshold`` to it (``n_copies``
    of them have the very same set); ``class_id``: the least doc_id connected to it by
    such links, its own if there is none.  keep_th is null where the n-gram set is empty.

    Null ids are possible: such rows have class and links as others, and class_id null
    if no row connected to them has an id.  Rows that repeat an id are rows of their
    own.  Only the two columns are read.
    """
    bands = bands_for(threshold, recall, rows)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = written(signatures(source, n, bands, rows), "near-signatures")
    classes = written(
        # the row that stands for a class: the least id, with its own text; null ids last
        signed.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("r"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")).select("sid", F.col("r.id").alias("rep"), F.col("r.th").alias("th"), "copies", "n_grams", "bands"),
        "near-classes",
    )
    dealt = classes.select("sid", F.explode("bands").alias("band"))
    leads = dealt.groupBy("band").agg(F.min("sid").alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m")
    # each class to the least one of its bands; a band that very many share is a side of known size
    leads = written(leads, "near-leads")
    groups = components(dealt.join(leads, "band").where("sid <> lead").select(F.col("sid").alias("u"), F.col("lead").alias("v")))
    members = groups.withColumnRenamed("node", "sid").join(classes.select("sid", "rep", "copies", "n_grams", F.col("th").alias("rep_th")), "sid")
    # tables by group are written before they are joined, so that a group of very many classes can be split
    sizes = written(members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_grams") / TILE_GRAMS)).cast("int").alias("tiles")), "near-sizes")
    members = written(members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int")), "near-members")
    found = written(_met(source, members, n, threshold), "near-links")
    joined = components(found.select(F.col("sid").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("sid"), "component")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    placed = classes.select("sid", "rep", "th", "copies").join(joined, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = written(placed.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "th")).alias("k")).select("component", F.col("k.rep").alias("class_id"), F.col("k.th").alias("keep_th")), "near-names")
    # written, so that the last join reads both sides as they are dealt and a class with very many copies can be split
    result = written(placed.join(named, "component").join(links, "sid", "left").select("sid", "class_id", "keep_th", "copies", F.coalesce("links", F.lit(0)).alias("links")), "near-classes-named")
    out = signed.select("id", "th", "sid").join(result, "sid", "left")
    copies = F.coalesce(F.col("copies") - 1, F.lit(0))
    alone = F.col("sid").isNull()
    return out.select(F.col("id").alias("doc_id"), "th", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), (copies + F.coalesce("links", F.lit(0))).alias("n_links"), copies.alias("n_copies"), "keep_th")


def _met(source: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(sid, links, other) of every pair of tiles."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(grams=[ngram_set(x, n).tobytes() for x in pdf.text])

    wanted = members.select(F.col("rep").alias("m_id"), F.col("rep_th").alias("m_th"), "sid", "component", "tile", "tiles", "copies")
    if members.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = source.join(wanted, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).select("sid", "component", "tile", "tiles", "copies", "text")
    # rows that repeat an id and a text are one from here on; tasks drop their own before texts move
    texts = texts.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("component", "tile", "tiles", "copies", "text")])
    grams = texts.mapInPandas(sets, "sid binary, component binary, tile int, tiles int, copies long, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiles = grams.select("sid", "component", "tile", "copies", "grams", other.alias("o")).select("sid", "component", "tile", "copies", "grams", F.least("tile", "o").alias("a"), F.greatest("tile", "o").alias("b"))
    return tiles.groupBy("component", "a", "b").applyInPandas(_meet(threshold), "sid binary, links long, other binary")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all columns: the row of the least id and text hash
    (null ids last), once if it is repeated.  Documents with an empty n-gram set are
    similar to nothing, and all stay."""
    kept = jaccard_join(docs, id_col=id_col, text_col=text_col, **options).where("keep_th is not null").select(F.col("class_id").alias("j_id"), F.col("keep_th").alias("j_th")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.withColumn("k_id", F.col("row")[id_col]).withColumn("k_th", F.xxhash64(F.col("row")[text_col]))
    empty = F.coalesce(F.col("row")[text_col], F.lit("")) == ""
    joined = rows.where(~empty).join(kept, F.col("k_id").eqNullSafe(F.col("j_id")) & (F.col("k_th") == F.col("j_th")))
    return joined.dropDuplicates(["k_id", "k_th"]).select("row.*").unionByName(rows.where(empty).select("row.*"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
