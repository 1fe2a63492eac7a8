"""Fusion, reranking and the three search modes over a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import requests
from ..functions.lexicon import expand_query
from ..functions.text import tokenize, trim_space
from ..schema import UNKNOWN
from ..storage import few, written
from .index import Index, bm25, build_index, index_text, ranked
from .vector import vector

# Rank constant, candidates for each result, weights of the features.
RRF_K, MULTIPLIER = 60, 4
W_VECTOR, W_BM25, W_COVERAGE, W_PHRASE = 0.32, 0.28, 0.25, 0.15


@dataclass(frozen=True)
class SearchOptions:
    rrf_k: int = RRF_K
    candidate_multiplier: int = MULTIPLIER
    mode: str = requests.DEFAULT_MODE
    expand: bool = True


def rrf(lists: list[tuple[str | None, DataFrame]], k: int = RRF_K) -> DataFrame:
    """query_id, rnk, chunk_id, score and each list's own score, by reciprocal-rank fusion.

    ``lists``: (name, ranked); a name other than None keeps that list's score as
    ``<name>_score``; of lists with one name the first that has a value gives it.  Where
    all lists have document_id and text, hits without a chunk_id are told apart by these,
    and the two stay as columns.

    Lists are joined, not united: each is summed by hit first, so a join meets one row of
    each, and what follows finds the rows dealt as the lists were."""
    names = list(dict.fromkeys(name for name, _ in lists if name))
    told = all({"document_id", "text"} <= set(hits.columns) for _, hits in lists)
    one = F.lit(1.0) / (F.lit(float(max(1, k))) + F.col("rnk"))
    fused = None
    for no, (_, hits) in enumerate(lists):
        key = F.col("chunk_id")
        if told:
            key = F.coalesce(key.cast("string"), F.concat_ws("\n", F.col("document_id"), F.col("text")))
        rest = [F.min_by(c, "rnk").alias(f"{c}_{no}") for c in ("chunk_id", *(("document_id", "text") if told else ()))]
        part = hits.groupBy("query_id", key.alias("key")).agg(F.sum(one).alias(f"part_{no}"), F.min_by("score", "rnk").alias(f"own_{no}"), *rest)
        fused = part if fused is None else fused.join(part, ["query_id", "key"], "full_outer")
    each = range(len(lists))
    score = F.round(sum((F.coalesce(f"part_{no}", F.lit(0.0)) for no in each), F.lit(0.0)), 9).alias("score")
    first = lambda c, of=each: F.coalesce(*[f"{c}_{no}" for no in of])
    own = [first("own", [no for no in each if lists[no][0] == n]).alias(f"{n}_score") for n in names]
    told_by = [first(c).alias(c) for c in (("document_id", "text") if told else ())]
    rows = fused.select("query_id", "key", first("chunk_id").alias("chunk_id"), score, *own, *told_by)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("key"))
    return rows.withColumn("rnk", F.row_number().over(by_score)).select("query_id", "rnk", "chunk_id", "score", *[f"{n}_score" for n in names], *(["document_id", "text"] if told else []))


def coverage(query: Column, passage: Column) -> Column:
    """Share of the query's distinct tokens that the passage has; 0 without tokens."""
    q = F.array_distinct(tokenize(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokenize(passage))) / F.size(q)).otherwise(0.0)


def has_phrase(query: Column, passage: Column) -> Column:
    """Whether the passage contains the trimmed query (two characters or more), ignoring case."""
    q = trim_space(query)
    return (F.length(q) >= 2) & F.contains(F.lower(passage), F.lower(q))


def _features(rows: DataFrame) -> DataFrame:
    """Puts vec, kw, coverage, phrase and the weighted ``rerank_score`` in place of query_text
    and passage of candidates that have these, vector_score and bm25_score.  The two texts
    are read where they were joined and go no further."""
    best = F.max("bm25_score").over(Window.partitionBy("query_id"))
    most = F.when(best > 0, best).otherwise(1.0)
    out = (
        rows.withColumn("coverage", coverage(F.col("query_text"), F.col("passage")))
        .withColumn("phrase", F.when(has_phrase(F.col("query_text"), F.col("passage")), 1.0).otherwise(0.0))
        .drop("query_text", "passage")
        .withColumn("vec", F.coalesce("vector_score", F.lit(0.0)))
        .withColumn("kw", F.least(F.lit(1.0), F.coalesce("bm25_score", F.lit(0.0)) / most))
    )
    score = F.lit(W_VECTOR) * F.col("vec") + F.lit(W_BM25) * F.col("kw") + F.lit(W_COVERAGE) * F.col("coverage") + F.lit(W_PHRASE) * F.col("phrase")
    return out.withColumn("rerank_score", F.round(score, 6))


def rerank_features(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hits with their features: vec, kw (BM25 as share of the query's best), coverage,
    phrase, and the weighted ``score``.  Scores that a list lacks are 0.

    The hits are written first: they are the small side of the join with the corpus, and
    Spark then sees that they are."""
    asked = written(hits.drop("score", "rnk").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id"), "rerank-hits")
    pairs = asked.join(only(chunks, asked).select("chunk_id", F.col("content").alias("passage")), "chunk_id")
    return _features(pairs).withColumnRenamed("rerank_score", "score")


def only(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks of written hits.  Their ids meet the corpus before anything else does, so
    no other text is moved."""
    return chunks.join(few(hits.select("chunk_id").distinct(), hits.count()), "chunk_id", "left_semi")


def rerank(queries: DataFrame, hits: DataFrame, chunks: DataFrame, k: int = 50) -> DataFrame:
    scored = rerank_features(queries, hits, chunks)
    return ranked(scored, F.lit(k)).select("query_id", "rnk", "chunk_id", "score", "vector_score", "bm25_score")


def prepared(queries: DataFrame, options: SearchOptions) -> DataFrame:
    """Queries with resolved mode, limits and the expanded text; blank ones are left out."""
    given = lambda name, kind, default: F.col(name).cast(kind) if name in queries.columns else F.lit(default).cast(kind)
    rows = queries.where(~requests.is_blank(F.col("text"))).select(
        "query_id", "text", given("document_id", "string", None).alias("document_id"), requests.mode(given("mode", "string", None), options.mode).alias("mode"),
        requests.search_top_k(given("top_k", "int", 0)).alias("top_k"), given("embedding", "array<float>", None).alias("embedding"),
    )
    expanded = expand_query(F.col("text")) if options.expand else F.col("text")
    return rows.withColumn("expanded", expanded).withColumn("fetch", requests.fetch_size(F.col("top_k"), F.lit(options.candidate_multiplier)))


def search(queries: DataFrame, chunks: DataFrame, index: Index | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Results of each query in its mode, with the chunks' attributes.

    ``queries``: query_id, text, embedding (of the expanded text) and, as wanted,
    document_id, mode, top_k.  ``vector`` ranks by cosine; ``hybrid`` fuses cosine and
    BM25 candidates; ``rerank`` scores the fused candidates by features of the text as
    it was asked.

    All modes share one table of candidates, written once: those of ``vector`` are fused
    from one list, which keeps its order.  It meets the corpus in one join, for the
    passages and the attributes of hits of either list, and is ranked once more by the
    score of the query's mode."""
    asked = written(prepared(queries, options), "search-queries")
    cut = lambda hits: hits.join(asked.select("query_id", "fetch"), "query_id").where(F.col("rnk") <= F.col("fetch")).drop("fetch")
    index = index or build_index(chunks, text=index_text(F.col("content"), F.col("entities") if "entities" in chunks.columns else None))
    worded = asked.where("mode <> 'vector'").select("query_id", "document_id", F.col("expanded").alias("text"))
    fused = cut(rrf([("vector", cut(vector(asked, chunks))), ("bm25", cut(bm25(worded, index)))], options.rrf_k))
    candidates = written(fused.withColumnRenamed("score", "rrf_score").drop("rnk").join(asked.select("query_id", "mode", "top_k", F.col("text").alias("query_text")), "query_id"), "search-candidates")
    found = _features(candidates.join(attributes(only(chunks, candidates)), "chunk_id").withColumn("passage", F.col("text")))
    score = F.when(F.col("mode") == "vector", F.col("vector_score")).when(F.col("mode") == "hybrid", F.col("rrf_score")).otherwise(F.col("rerank_score"))
    hits = ranked(found.withColumn("score", score), F.col("top_k"))
    own = [c for c in attributes(chunks).columns if c != "chunk_id"]
    return hits.select("chunk_id", "query_id", "rnk", "score", "vector_score", "bm25_score", "mode", *own)


def attributes(chunks: DataFrame) -> DataFrame:
    """What results show of a chunk, by chunk_id: text, context, page, parent and entities;
    context null if empty, page only above 0, parent null if empty or the chunk itself."""
    col = lambda name, kind: F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind)
    document = F.coalesce(F.nullif(col("document_id", "string"), F.lit("")), F.lit(UNKNOWN))
    parent = col("parent_text", "string")
    return chunks.select(
        "chunk_id", document.alias("document_id"), F.coalesce(F.nullif(col("file_name", "string"), F.lit("")), document).alias("file_name"), F.col("content").alias("text"),
        F.nullif(col("context", "string"), F.lit("")).alias("context"), F.when(col("page_number", "int") > 0, col("page_number", "int")).alias("page_number"),
        F.when((parent != "") & (parent != F.col("content")), parent).alias("parent_text"), col("entities", "array<string>").alias("entities"),
    )


def with_attributes(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(attributes(chunks), "chunk_id")
