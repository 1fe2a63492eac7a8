"""Cleaning of a document's elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.requests import is_blank

# Pages a document needs, and the share of them that a repeated line is on.
LEAST_PAGES, SHARE = 3, 0.4


def repeating_lines(elements: DataFrame) -> DataFrame:
    """(document_id, key) of short lines that stand on many pages of a document.

    Only documents with three or more numbered pages are looked at; a line must be on
    40 % of the pages that have any short line, and on three at least."""
    paged = elements.where("page_number > 0")
    many = paged.groupBy("document_id").agg(F.countDistinct("section_no").alias("pages")).where(F.col("pages") >= LEAST_PAGES).select("document_id")
    found = paged.where(~is_blank(F.col("text"))).select("document_id", "section_no", F.explode(T.lines(F.col("text"))).alias("line")).select("document_id", "section_no", T.repeat_key(F.col("line")).alias("key"))
    keys = found.where(F.length("key").between(*T.REPEAT_LENGTHS)).distinct()
    pages = keys.groupBy("document_id").agg(F.countDistinct("section_no").alias("n_pages"))
    counts = keys.groupBy("document_id", "key").agg(F.count("*").alias("n"))
    enough = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n_pages") * F.lit(SHARE)))
    return counts.join(pages, "document_id").where((F.col("n") >= enough) & ~T.looks_like_content(F.col("key"))).join(many, "document_id", "left_semi").select("document_id", "key")


def clean(elements: DataFrame) -> DataFrame:
    """The elements with cleaned text; those left blank go.  A document's repeated lines
    are few, and travel to its elements as one array."""
    keys = repeating_lines(elements).groupBy("document_id").agg(F.collect_set("key").alias("repeats"))
    cleaned = elements.where(~is_blank(F.col("text"))).join(keys, "document_id", "left").withColumn("text", T.clean_text(F.col("text"), F.col("repeats")))
    return cleaned.drop("repeats").where(~is_blank(F.col("text")))
