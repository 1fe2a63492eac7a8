"""Catalog, detail and deletion of stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from ..schema import UNKNOWN

#: Chunks shown of a document.
PREVIEWS = 5


def _order(chunks: DataFrame) -> Column:
    """The stored order of chunks."""
    return F.struct(*[F.col(c) for c in ("section_no", "parent_no", "child_no", "chunk_id") if c in chunks.columns])


def catalog(chunks: DataFrame) -> DataFrame:
    """document_id, file_name, file_size, uploaded_at, chunk_count: a row for each document,
    with the attributes of its first chunk; latest upload first, unknown times last."""
    col = lambda name, kind: F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind)
    document = F.coalesce(F.col("document_id").cast("string"), F.lit(UNKNOWN))
    rows = chunks.select(document.alias("document_id"), col("file_name", "string").alias("file_name"), col("file_size", "long").alias("file_size"), col("uploaded_at", "timestamp").alias("uploaded_at"), _order(chunks).alias("o"))
    first = F.min_by(F.struct("file_name", "file_size", "uploaded_at"), "o")
    out = rows.groupBy("document_id").agg(first.alias("first"), F.count("*").alias("chunk_count"))
    return out.select("document_id", F.coalesce("first.file_name", "document_id").alias("file_name"), "first.file_size", "first.uploaded_at", "chunk_count").orderBy(F.col("uploaded_at").desc_nulls_last(), "document_id")


def detail(chunks: DataFrame, document_ids: list[str] | None = None) -> DataFrame:
    """document_id, chunk_count, page_numbers (sorted, distinct), previews: the first five
    chunks, each cut at 300 characters.

    A chunk's place among the first five is found by partial aggregation: what is
    gathered for a document are five candidates of each task."""
    rows = chunks if document_ids is None else chunks.where(F.col("document_id").isin(*document_ids))
    page = F.col("page_number").cast("int") if "page_number" in chunks.columns else F.lit(None).cast("int")
    rows = rows.select("document_id", page.alias("page"), _order(chunks).alias("o"), preview(F.col("content")).alias("preview"))
    first = rows.select("document_id", "o", "preview", F.row_number().over(Window.partitionBy("document_id").orderBy("o")).alias("n")).where(F.col("n") <= PREVIEWS)
    shown = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "preview"))).alias("shown"))
    counts = rows.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.sort_array(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("page_numbers"))
    return counts.join(shown, F.equal_null(counts["document_id"], shown["document_id"])).select(counts["document_id"], "chunk_count", "page_numbers", F.transform("shown", lambda x: x["preview"]).alias("previews"))


def without(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks of other documents than those in ``documents`` (document_id)."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti")
