"""Embedding of texts by a plugged-in model, in batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..deploy import ship

# Texts of a call, and the limits of a write batch.
CALL, WRITE, WRITE_MOST = 16, 32, 128


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def batch_size(asked: int = WRITE) -> int:
    """The size of a write batch, from 1 to 128."""
    return min(WRITE_MOST, max(1, asked))


def embed(df: DataFrame, embedder: Embedder, *, text_col: str = "content", call: int = CALL) -> DataFrame:
    """Adds ``embedding``; the model is called with at most ``call`` texts at a time."""
    ship(df.sparkSession)
    kept = df.drop("embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x or "" for x in pdf[text_col]]
            yield pdf.assign(embedding=[v for i in range(0, len(texts), call) for v in embedder.embed(texts[i : i + call])])

    return kept.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", embedding array<float>")
