"""The engine's operators as queries over the test tables.

``documents`` stand in for chunks (chunk_id = doc_id, document_id = source), the items
of ``benchmark`` for a batch of queries, and ``embeddings`` for the vectors of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import spread
from ..functions import completions, lexicon, requests
from ..functions import text as T
from ..operators import answer, catalog, chunking, cleaning, embedding, index, ingest, manifest, search
from ..operators.vector import vector
from ..sources import tables
from ..storage import new_folder
from .values import INPUTS


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``documents``, for work on each text."""
    return spread(_t(spark, sf_dir, "documents").select(*columns))


def values(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input over all rows of its table."""
    tables = {t: _t(spark, sf_dir, t) for t in ("documents", "conversations", "pages") if f"{{{t}}}" in INPUTS[name]}
    return spark.sql(INPUTS[name], **tables) if tables else spark.sql(INPUTS[name])


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    docs = _texts(spark, sf_dir, "doc_id", "source", "text", "n_chars").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), F.col("n_chars"))
    if not vectors:
        return docs
    # what results show of a chunk: empty contexts, pages from 0, parents that are the chunk itself or empty
    parent = F.when(F.col("chunk_id") % 3 == 0, F.col("content")).when(F.col("chunk_id") % 3 == 1, F.col("document_id")).otherwise("")
    docs = docs.withColumns({"context": F.when(F.col("n_chars") % 2 == 0, F.col("document_id")).otherwise(""), "page_number": (F.col("n_chars") % 3).cast("int"), "parent_text": parent})
    return docs.join(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries: query_id, text, embedding."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("document_id"), "embedding")


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build_index(chunks(spark, sf_dir))


def tokenize_terms(spark, sf_dir):
    tokens = T.tokenize(F.col("text"))
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def tokenize_han(spark, sf_dir):
    rows = values(spark, sf_dir, "mixed_texts").select("id", F.explode(T.tokenize(F.col("txt"))).alias("token"))
    return rows.groupBy("id", "token").agg(F.count("*").alias("n"))


def term_freq(spark, sf_dir):
    return index.build_index(chunks(spark, sf_dir)).postings.select(F.col("chunk_id").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))


def doc_freq(spark, sf_dir):
    return index.document_frequencies(index.build_index(chunks(spark, sf_dir)))


def corpus_stats(spark, sf_dir):
    return index.build_index(chunks(spark, sf_dir)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_batch(spark, sf_dir):
    return index.bm25(batch(spark, sf_dir), _index(spark, sf_dir), 10)


def bm25_topk(spark, sf_dir):
    return index.bm25(batch(spark, sf_dir), _index(spark, sf_dir), 50)


def bm25_filtered(spark, sf_dir):
    asked = batch(spark, sf_dir).withColumn("document_id", F.lit("src3"))
    return index.bm25(asked, _index(spark, sf_dir), 10)


def vector_batch(spark, sf_dir):
    return vector(batch(spark, sf_dir), stored_vectors(spark, sf_dir), 10)


def vector_topk(spark, sf_dir):
    return vector(batch(spark, sf_dir), stored_vectors(spark, sf_dir), 50)


def vector_filtered(spark, sf_dir):
    asked = batch(spark, sf_dir).withColumn("document_id", F.lit("label1"))
    return vector(asked, stored_vectors(spark, sf_dir), 10)


def _lists(spark, sf_dir, fetch=20):
    asked = batch(spark, sf_dir)
    near = vector(asked, chunks(spark, sf_dir, True).where("embedding is not null"), fetch)
    return asked, near, index.bm25(asked, _index(spark, sf_dir), fetch)


def rrf_hybrid(spark, sf_dir):
    _, near, words = _lists(spark, sf_dir)
    return search.rrf([(None, near), (None, words)]).where("rnk <= 5")


def rrf_merge_scores(spark, sf_dir):
    _, near, words = _lists(spark, sf_dir)
    return search.rrf([("vector", near), ("bm25", words)])


def rerank_features(spark, sf_dir):
    asked, near, words = _lists(spark, sf_dir)
    found = search.rerank_features(asked, search.rrf([("vector", near), ("bm25", words)]).where("rnk <= 20"), chunks(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("vec", 6).alias("vec"), F.round("kw", 6).alias("kw"), F.round("coverage", 6).alias("coverage"), "phrase", "score")


def rerank_topk(spark, sf_dir):
    asked, near, words = _lists(spark, sf_dir)
    return search.rerank(asked, search.rrf([("vector", near), ("bm25", words)]).where("rnk <= 20"), chunks(spark, sf_dir), 5).select("query_id", "rnk", "chunk_id", "score")


def search_modes(spark, sf_dir):
    """Every query in each of the three modes: query_id * 10 + mode."""
    modes = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("mode")) for i, m in enumerate(requests.MODES)]))
    asked = batch(spark, sf_dir).select("query_id", "text", "embedding", modes.alias("m")).select((F.col("query_id") * 10 + F.col("m.no")).alias("query_id"), "text", "embedding", "m.mode", F.lit(5).alias("top_k"))
    hits = search.search(asked, chunks(spark, sf_dir, True), _index(spark, sf_dir))  # indexed without vectors: else their join would deal all texts anew
    return hits.select("query_id", "mode", "rnk", "chunk_id", "document_id", "score", "context", "page_number", "parent_text", F.length("text").alias("n_text"))


def clean_text(spark, sf_dir):
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", T.clean_text(F.col("text")).alias("text"))


def clean_elements(spark, sf_dir):
    return cleaning.clean(values(spark, sf_dir, "page_elements")).select("document_id", "section_no", "element_no", "text")


def repeating_lines(spark, sf_dir):
    return cleaning.repeating_lines(values(spark, sf_dir, "page_elements"))


def collapse_space(spark, sf_dir):
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", T.collapse_space(F.col("text")).alias("text"))


def visible_chars(spark, sf_dir):
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", T.visible_chars(F.col("text")).alias("n"), T.has_usable_text(F.col("text")).alias("usable"))


def page_line_filter(spark, sf_dir):
    return values(spark, sf_dir, "page_lines").select("id", T.is_page_line(T.collapse_space(F.col("line"))).alias("is_page"))


def paragraphs(spark, sf_dir):
    return values(spark, sf_dir, "blocks").select("id", F.posexplode(T.paragraphs(F.col("txt"))).alias("no", "paragraph"))


def ocr_scores(spark, sf_dir):
    return values(spark, sf_dir, "ocr_texts").select("id", F.round(T.ocr_score(F.col("txt"), F.col("confidence").cast("double")), 6).alias("score"), T.ocr_normalize(F.col("txt")).alias("text"))


def _elements(spark, sf_dir):
    """Documents as elements: a section for each, its lines as paragraphs."""
    docs = _texts(spark, sf_dir, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("section_no"), F.lit(None).cast("int").alias("page_number"), F.posexplode(F.split("text", "\n")).alias("element_no", "text")).withColumn("kind", F.lit("para"))


def parent_chunks(spark, sf_dir):
    return chunking.parent_chunks(_elements(spark, sf_dir)).select("document_id", "parent_no", "title", F.sha2("text", 256).alias("text_sha256"))


def child_chunks(spark, sf_dir):
    return chunking.chunk(_elements(spark, sf_dir)).select("document_id", "parent_no", "child_no", "content", "context")


def sliding_split(spark, sf_dir):
    pieces = chunking.split_long(F.col("text"), 280, 240)
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(pieces).alias("no", "piece"))


def entity_tag(spark, sf_dir):
    return values(spark, sf_dir, "questions").select("id", F.posexplode(lexicon.tag(F.col("txt"))).alias("no", "tag"))


def expand_query(spark, sf_dir):
    return values(spark, sf_dir, "questions").select("id", lexicon.expand_query(F.col("txt")).alias("expanded"))


def _files(spark, sf_dir, *more):
    """Documents as uploads: each is a file of its own."""
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_no"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.encode("text", "UTF-8").alias("content"), *more)


def content_hash(spark, sf_dir):
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", T.content_hash(F.col("text")).alias("sha256"))


def dedup_first(spark, sf_dir):
    return ingest.first_of_each(ingest.accept(_files(spark, sf_dir))).select(F.col("file_no").alias("doc_id"), "status")


def dedup_anti(spark, sf_dir):
    """Files whose content no German document has, each content once."""
    files = ingest.accept(_files(spark, sf_dir))
    stored = _t(spark, sf_dir, "documents").where("lang = 'de'").select(T.content_hash(F.col("text")).alias("content_hash"))
    return ingest.new_files(files, stored).select(F.col("file_no").alias("doc_id"))


def replace_by_name(spark, sf_dir):
    """Sources replaced by one chunk each, if they have German documents."""
    old = chunks(spark, sf_dir).select("chunk_id", "document_id", "content")
    new = _t(spark, sf_dir, "documents").where("lang = 'de'").groupBy(F.col("source").alias("document_id")).agg(F.min("doc_id").alias("chunk_id"), F.lit("new").alias("content"))
    return ingest.replaced(old, new.select("chunk_id", "document_id", "content")).groupBy("document_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"))


def catalog_list(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumns({"file_size": F.col("n_chars"), "uploaded_at": F.timestamp_seconds(F.col("chunk_id") * 1000)})
    return catalog.catalog(rows).select("document_id", "file_name", "file_size", F.unix_timestamp("uploaded_at").alias("uploaded_s"), "chunk_count")


def detail(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("page_number", (F.col("n_chars") % 7).cast("int"))
    return catalog.detail(rows).select("document_id", "chunk_count", F.array_join("page_numbers", ",").alias("pages"), F.array_join("previews", "|").alias("previews"))


def catalog_delete(spark, sf_dir):
    gone = spark.sql("SELECT * FROM VALUES ('src1'), ('src7') AS t(document_id)")
    return catalog.without(chunks(spark, sf_dir), gone).groupBy("document_id").agg(F.count("*").alias("n"))


def task_rollup(spark, sf_dir):
    log = values(spark, sf_dir, "log").withColumn("event_ts", F.to_timestamp("event_ts"))
    return ingest.tasks(log).select("task_id", "total_files", "processed_files", "status")


def accept_files(spark, sf_dir):
    rows = values(spark, sf_dir, "uploads").withColumn("content", F.encode("file_name", "UTF-8"))
    return ingest.accept(rows).select("file_no", "status", requests.extension(F.col("file_name")).alias("extension"), F.coalesce(requests.media_type(F.col("file_name")), F.lit("-")).alias("media_type"))


def citations(spark, sf_dir):
    hits = values(spark, sf_dir, "hits").select(F.col("query_id"), F.col("rnk"), F.concat(F.lit("src"), F.col("doc").cast("string")).alias("document_id"), F.col("vs").cast("double").alias("vector_score"), F.col("s").cast("double").alias("score"), F.col("page").cast("int").alias("page_number")).withColumn("file_name", F.col("document_id"))
    return answer.cite(hits).select("query_id", F.col("source_no").cast("long").alias("source_no"), "document_id", F.array_join("page_numbers", ",").alias("pages"))


def history_last6(spark, sf_dir):
    return answer.last_turns(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


def last_user(spark, sf_dir):
    return answer.last_user(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")


def _results(spark, sf_dir):
    """Documents as the results of requests, twenty of each."""
    return _t(spark, sf_dir, "documents").select(
        (F.col("doc_id") - F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("rnk"), F.col("source").alias("file_name"), F.col("lang").alias("context"), (F.col("doc_id") % 3).cast("int").alias("page_number"),
        F.when(F.col("lang") == "de", F.array("lang", "source")).alias("entities"), "text", F.when(F.col("lang") == "fr", F.col("source")).alias("parent_text"),
    )


def prompt_context(spark, sf_dir):
    return answer.prompt_context(_results(spark, sf_dir)).select("query_id", F.sha2("context", 256).alias("context_sha256"))


def chat_prompts(spark, sf_dir):
    """The whole prompt of each conversation: its last question with what was found, after its history."""
    talk = _t(spark, sf_dir, "conversations")
    asked = answer.last_user(talk).select(F.col("conv_id").alias("query_id"), "text", "conv_id")
    rows = answer.build_prompt(asked, _results(spark, sf_dir), "Answer from the context.", answer.history(talk))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return rows.select("query_id", F.size("messages").alias("n_messages"), F.sha2(said, 256).alias("prompt_sha256"))


def message_parts(spark, sf_dir):
    rows = values(spark, sf_dir, "images").select("id", F.array("raw", F.lit("http://second")).alias("images"))
    return rows.select("id", requests.message_content(F.concat(F.lit("see "), F.col("id").cast("string")), F.when(F.col("id") % 3 > 0, F.col("images"))).alias("content"))


def upstream_errors(spark, sf_dir):
    return values(spark, sf_dir, "refusals").select("id", requests.upstream_error(F.col("status"), F.col("body")).alias("error"))


def newest_build(spark, sf_dir):
    return manifest.newest(values(spark, sf_dir, "builds"))


class _Sizes:
    """An embedder that needs no model: the length of a text, its blanks, how many texts a call has."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(x)), float(x.count(" ")), float(len(texts) <= embedding.CALL)] for x in texts]


def embedded(spark, sf_dir):
    rows = embedding.embed(chunks(spark, sf_dir).select("chunk_id", "content"), _Sizes())
    return rows.select("chunk_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("length", "blanks", "small_call"))])


def ingest_twice(spark, sf_dir):
    """Log of all documents as uploads, then of the German ones again with other contents
    and of the others as they were; what is stored at the end is read by ``stored_chunks``."""
    logs, _ = _ingested(spark, sf_dir)
    return logs[0].unionByName(logs[1]).select("task_id", "file_no", "status", "chunk_count")


def stored_chunks(spark, sf_dir):
    _, store = _ingested(spark, sf_dir)
    return store.read().select("document_id", "content_hash", "file_size")


def _ingested(spark, sf_dir):
    store = ingest.Store(spark, new_folder(spark, "ingest-twice"))
    to_chunks = lambda f: f.select(F.col("document_id").alias("chunk_id"), "document_id", F.decode("content", "UTF-8").alias("content"), "stamp").where("content <> ''")
    files, again = _files(spark, sf_dir), _files(spark, sf_dir, "lang")
    revised = again.withColumn("content", F.when(F.col("lang") == "de", F.encode(F.concat(F.decode("content", "UTF-8"), F.lit(" revised")), "UTF-8")).otherwise(F.col("content"))).drop("lang")
    logs = [ingest.ingest(batch, store, to_chunks, task_id=f"t{i}") for i, batch in enumerate((files, revised))]
    store.compact()
    store.vacuum()
    return logs, store


def mode_parse(spark, sf_dir):
    rows = values(spark, sf_dir, "answers").select("id", answer.parse_mode(F.col("raw"), F.col("best").cast("double")).alias("p"))
    return rows.select("id", "p.mode", "p.answer")


def sse_frames(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("role").alias("type"), F.col("turn").alias("seq")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", completions.event_frame(F.lit("delta"), payload).alias("frame"))


def delta_extract(spark, sf_dir):
    p = completions.event_payload(F.col("line"))
    return values(spark, sf_dir, "stream_lines").select("id", p.alias("payload")).select("id", completions.content_text(F.col("payload")).alias("content"), completions.reasoning_text(F.col("payload")).alias("reasoning"), F.col("payload").isNotNull().alias("valid"))


def finish_rewrite(spark, sf_dir):
    return values(spark, sf_dir, "stream_lines").select("id", completions.rewrite_line(F.col("line")).alias("line"))


def image_urls(spark, sf_dir):
    return values(spark, sf_dir, "images").select("id", requests.image_url(F.col("raw")).alias("url"))


def size_clamps(spark, sf_dir):
    k = F.col("asked")
    return values(spark, sf_dir, "sizes").select("asked", requests.search_top_k(k).alias("search_k"), requests.chat_top_k(k).alias("chat_k"), requests.fetch_size(requests.search_top_k(k), F.lit(4)).alias("fetch"))


def request_fields(spark, sf_dir):
    return values(spark, sf_dir, "fields").select("id", requests.mode(F.col("mode")).alias("mode"), requests.reasoning_effort(F.col("effort"), F.col("thinking")).alias("effort"), requests.completions_url(F.col("base"), "https://llm.example/v1/chat/completions").alias("url"), requests.is_blank(F.col("base")).alias("blank"))


def update_manifest(spark, sf_dir):
    files = values(spark, sf_dir, "packages")
    return manifest.manifest(values(spark, sf_dir, "settings"), values(spark, sf_dir, "manifest_requests"), files).select("request_id", "latest_version", "package_url", "platform", "channel", "force_update")


def table_markdown(spark, sf_dir):
    rows = values(spark, sf_dir, "cells").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("row_no", F.split("cells", ";").alias("c")))).alias("r"))
    only = F.transform("r", lambda x: x["c"])
    return rows.select("id", tables.table_markdown(only, F.array_max(F.transform(only, lambda c: F.size(c)))).alias("markdown"))


def answer_events(spark, sf_dir):
    """Every conversation as an answer: its turns are the pieces."""
    pieces = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("piece_no"), F.when(F.col("role") == "system", "reasoning").otherwise("content").alias("kind"), "text")
    asked = pieces.select("query_id").distinct()
    none = pieces.select("query_id", F.lit(0.4).alias("score"), F.lit(None).cast("double").alias("vector_score"))
    return answer.answer_events(asked, pieces, none)


def stream_ingest(spark, sf_dir):
    """All documents as files that arrive in a folder, ingested by a stream; the chunks."""
    from ..streaming.ingestion import ingest_stream

    work = new_folder(spark, "stream-ingest")
    incoming = f"{work}/incoming"
    _files(spark, sf_dir).withColumn("path", F.col("file_name")).write.mode("overwrite").parquet(incoming)
    store = ingest.Store(spark, f"{work}/store")
    made = spark.readStream.schema("file_no long, file_name string, content binary, path string").parquet(incoming)
    to_chunks = lambda f: f.select(F.col("file_name").alias("chunk_id"), "document_id", F.decode("content", "UTF-8").alias("content"), "stamp")
    query = ingest_stream(made.drop("file_no", "file_name"), store, to_chunks, f"{work}/checkpoint")
    query.awaitTermination()
    return store.read().select("document_id", "content_hash")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, tokenize_han, term_freq, doc_freq, corpus_stats, bm25_batch, bm25_topk, bm25_filtered, vector_batch, vector_topk, vector_filtered, rrf_hybrid, rrf_merge_scores,
        rerank_features, rerank_topk, search_modes, clean_text, clean_elements, repeating_lines, collapse_space, visible_chars, page_line_filter, paragraphs, ocr_scores, parent_chunks, child_chunks,
        sliding_split, entity_tag, expand_query, content_hash, dedup_first, dedup_anti, replace_by_name, catalog_list, detail, catalog_delete, task_rollup, accept_files, citations, history_last6,
        last_user, prompt_context, mode_parse, sse_frames, delta_extract, finish_rewrite, image_urls, size_clamps, request_fields, update_manifest, table_markdown, answer_events, stream_ingest,
        chat_prompts, message_parts, upstream_errors, newest_build, embedded, ingest_twice, stored_chunks,
    )
}
