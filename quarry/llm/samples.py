"""Labelled and unlabelled samples of bounded size, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def share_of(n: int, most: int) -> float:
    """The share of n rows that ``most`` are."""
    return min(1.0, most / n) if n else 1.0


def sampled(salt: str, share: float, key: str = "id") -> Column:
    """Whether a row is in a sample of a share of the rows, by a hash of its key.  A smaller
    sample of one salt is in any larger one."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), key), 11) / F.lit(float(1 << 53)) < share


def near(rows: DataFrame, key: str, most: int, salt: str) -> DataFrame:
    """All rows if there are at most ``most``, else about that many (the hash of ``key``
    decides; the spread is that of a binomial).  No sort, and no row moves."""
    n = rows.count()
    return rows if n <= most else rows.where(sampled(salt, share_of(n, most), key))


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, most: int, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of about ``most`` documents, from labels of the rows whose fold
    isn't ``held_out``.  The ids are chosen from the labels alone and sent to the
    documents: numbers, as many as that.  Null labels, ids and texts are left out; an
    id with several labels takes the largest, equal texts their mean and least id."""
    known = labels.where(F.col(label).isNotNull() & (fold(F.col(id_col)) != held_out)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    chosen = near(known, "id", most, label)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")
    return rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "id").alias("text"), F.avg("label").alias("label"), F.min("id").alias("id")).select("id", "text", "label")
