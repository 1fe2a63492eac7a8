"""A training corpus from documents: five stages of the operators in quarry.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of documents.

Edge cases: null and empty texts are judged as empty ones by the classifiers, are
similar to nothing and have no words, so that the mix takes none of them; with too
little to learn from, classifiers keep every document.  Repeated rows are judged alike
and then are one.  Null ids and sources are kept as such.  Further columns of any name
travel along.  Empty documents or labels give empty results or classifiers that
learned nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, near, quality, toxicity
from quarry.llm.storage import discard, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier passes."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.score(F.col("text")) >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't make them toxic."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.scored(spark, F.col("text"))["score"] < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return near.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: documents repeated, and left out, as the budgets say."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix as token ids, with digests of them and of what they
    decode to: doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids."""
    ranks, pattern = bpe.vocabulary()
    return bpe.encoded_rows(docs, ranks, pattern, keep=["doc_id", "source"])


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: No stage but the last could be stated in SQL: the first learns a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1], 1):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{i}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
