"""Exact vector search by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..storage import written
from .index import ranked

#: Queries of a block, and the bytes of vectors that meet the chunks in one pass.
BLOCK, PASS_BYTES = 2048, 64 << 20


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def _unit(rows: list) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in rows])
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _blocks(queries: DataFrame) -> DataFrame:
    """block, ids, wanted, vectors: the queries packed into rows of about ``BLOCK``."""
    wanted = F.coalesce(F.col("document_id"), F.lit("")) if "document_id" in queries.columns else F.lit("")
    asked = queries.where("embedding is not null").select("query_id", wanted.alias("wanted"), "embedding")
    n = asked.count()
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BLOCK)))))
    kind = queries.schema["query_id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = _unit(pdf.embedding.tolist()).astype("<f8")
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "ids": [pdf.query_id.to_numpy()], "wanted": [pdf.wanted.to_numpy()], "vectors": [vectors.tobytes()]})

    return dealt.groupBy("block").applyInPandas(pack, f"block long, ids array<{kind}>, wanted array<string>, vectors binary")


def vector(queries: DataFrame, chunks: DataFrame, k: int = 50) -> DataFrame:
    """query_id, rnk, chunk_id, score of the ``k`` nearest chunks for each query.

    ``queries``: query_id, embedding, and document_id as filter; ``chunks``: chunk_id,
    document_id, embedding; all of one length; rows without an embedding take no part.

    The query set meets all chunks in blocks: the blocks of one pass go to the workers as
    matrices, a batch of chunks answers with its ``k`` best for each query, so what is
    shuffled doesn't grow with the corpus beyond k for each batch.  Blocks are packed on
    the executors and written; those of a pass have at most ``PASS_BYTES`` (one block at
    least), whatever the number of queries: larger batches take more passes, each of
    which is written before the next."""
    spark = queries.sparkSession
    ship(spark)
    blocks = written(_blocks(queries), "vector-queries")
    usable = chunks.where("embedding is not null").select("chunk_id", F.coalesce("document_id", F.lit("")).alias("document_id"), "embedding")
    id_type, chunk_type = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {id_type}, chunk_id {chunk_type}, score double"
    passes: list[list[int]] = []
    held = PASS_BYTES
    for block, size in sorted((r.block, r.size) for r in blocks.select("block", F.length("vectors").alias("size")).collect()):
        if held + size > PASS_BYTES:
            passes.append([])
            held = 0
        passes[-1].append(block)
        held += size
    found = [usable.mapInPandas(_nearest(spark, blocks.where(F.col("block").isin(*p)), k), schema) for p in passes]
    if not found:
        every = spark.createDataFrame([], schema)
    elif len(found) == 1:
        every = found[0]
    else:
        parts = [written(x, "vector-pass") for x in found]
        every = spark.read.schema(schema).parquet(*[x.quarry_folder for x in parts])
    return ranked(every, F.lit(k)).select("query_id", "rnk", "chunk_id", "score")


def _nearest(spark: SparkSession, blocks: DataFrame, k: int):
    """A batch of chunks -> its ``k`` best for each query of the blocks."""
    rows = [(list(r.ids), np.array(r.wanted, dtype=object), np.frombuffer(r.vectors, "<f8").reshape(len(r.ids), -1)) for r in blocks.collect()]
    shared = spark.sparkContext.broadcast(rows)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            unit = _unit(pdf.embedding.tolist())
            documents, chunk_ids = pdf.document_id.to_numpy(), pdf.chunk_id.to_numpy()
            by_id = np.argsort(chunk_ids, kind="stable")
            for ids, wanted, q in shared.value:
                scores = np.round(unit @ q.T, 6).T + 0.0
                scores[(wanted[:, None] != "") & (wanted[:, None] != documents[None, :])] = -np.inf
                order = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
                row = np.repeat(np.arange(len(ids)), order.shape[1])
                best = np.take_along_axis(scores, order, axis=1).ravel()
                ok = np.isfinite(best)
                yield pd.DataFrame({"query_id": np.array(ids, dtype=object)[row][ok], "chunk_id": chunk_ids[order.ravel()][ok], "score": best[ok]})

    return nearest
