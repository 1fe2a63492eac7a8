"""Files of a folder as rows, and their elements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import requests
from . import readers

# The band of a page that is its body, the least sizes of embedded images.
BAND = (0.07, 0.93)
LEAST_AREA, LEAST_SIDE = 80 * 80, 40


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The readable files right in a folder: path, modificationTime, length, content.  The
    listing takes any name, so that extensions match in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.where(requests.is_supported(F.col("path")))


def read_elements(files: DataFrame) -> DataFrame:
    """document_id, section_no, page_number, element_no, kind, level, text, error.

    ``files`` has content and a path (or document_id and file_name).  A file that can't be
    read gives one row with ``error``; files go through workers a batch at a time."""
    ship(files.sparkSession)
    plugged = dict(readers.READERS)
    name = F.col("path") if "path" in files.columns else F.col("file_name")
    base = requests.base_name(name)
    rows = files.select(base.alias("document_id") if "document_id" not in files.columns else F.col("document_id"), requests.extension(base).alias("extension"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for document_id, extension, data in zip(pdf.document_id, pdf.extension, pdf.content, strict=True):
                try:
                    out += [(document_id, *e, None) for e in readers.elements_of(extension, bytes(data or b""), plugged)]
                except Exception as e:  # any fault of a file's format is a row, not the batch's end
                    out.append((document_id, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = ["document_id", "section_no", "page_number", "element_no", "kind", "level", "text", "error"]
            ints = dict.fromkeys(("section_no", "page_number", "element_no", "level"), "Int32")
            yield pd.DataFrame(out, columns=columns).astype(ints)

    return rows.mapInPandas(read, "document_id string, section_no int, page_number int, element_no int, kind string, level int, text string, error string")


def in_body(bottom: Column, top: Column, page_height: Column) -> Column:
    """Whether a letter lies strictly between a page's header and footer bands."""
    return (bottom > page_height * F.lit(BAND[0])) & (top < page_height * F.lit(BAND[1]))


def is_readable_image(width: Column, height: Column, bitmap_width: Column, bitmap_height: Column) -> Column:
    """Whether an embedded image is large enough for OCR."""
    return (width * height >= LEAST_AREA) & (bitmap_width >= LEAST_SIDE) & (bitmap_height >= LEAST_SIDE)
