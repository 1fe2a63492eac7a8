"""Citations, history, prompts and answer events."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import requests
from ..functions.text import trim_space

# Cutoffs of citations, markers and their modes, history kept, texts.
LEAST_SCORE, SPREAD, FALLBACK_SCORE, TURNS = 0.5, 0.15, 0.45, 6
MARKERS = {"[知识库]": "knowledge_base", "[模型]": "model"}
NO_CONTEXT = "（知识库为空或没有检索到任何内容）"
IMAGE_QUESTION = "请根据图片内容作答。"
IMAGE_NOTE = "\n\n用户消息中附有图片（image_url）。必须结合图片内容回答，禁止说看不到图片或没有图片。"
NOTHING_FOUND = "知识库中还没有找到与该问题相关的内容，也无法启用大模型推理（allowModelAnswer=false）。请先上传相关文档。"


def citation_score(vector_score: Column, score: Column) -> Column:
    """The cosine; the final score where there is none."""
    return F.coalesce(vector_score, score)


def cited(results: DataFrame) -> DataFrame:
    """The results close enough to the best of their query to count as its grounds."""
    own = citation_score(F.col("vector_score"), F.col("score"))
    cutoff = F.greatest(F.lit(LEAST_SCORE), F.round(F.max(own).over(Window.partitionBy("query_id")) - F.lit(SPREAD), 9))
    return results.withColumn("citation", own).withColumn("cutoff", cutoff).where(F.col("citation") >= F.col("cutoff")).drop("cutoff")


def cite(results: DataFrame) -> DataFrame:
    """query_id, source_no, document_id, file_name, page_numbers: the cited documents in
    the order of their first result, with their sorted distinct pages above 0."""
    grouped = cited(results).groupBy("query_id", "document_id").agg(
        F.min("rnk").alias("first"), F.min_by("file_name", "rnk").alias("file_name"), F.sort_array(F.collect_set(F.when(F.col("page_number") > 0, F.col("page_number")))).alias("page_numbers")
    )
    order = Window.partitionBy("query_id").orderBy("first", "document_id")
    return grouped.withColumn("source_no", F.row_number().over(order)).select("query_id", "source_no", "document_id", "file_name", "page_numbers")


def last_turns(conversations: DataFrame, n: int = TURNS) -> DataFrame:
    """The last ``n`` turns of each conversation; every role but assistant is a user."""
    latest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = conversations.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= n).drop("back")
    return kept.withColumn("role", F.when(F.lower("role") == "assistant", "assistant").otherwise("user"))


def history(conversations: DataFrame, n: int = TURNS) -> DataFrame:
    """conv_id, messages: array<struct<turn, role, content>> of the last turns, in order."""
    rows = last_turns(conversations, n)
    content = requests.message_content(F.col("text"), F.col("images") if "images" in rows.columns else F.lit(None).cast("array<string>"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))).alias("messages"))


def last_user(conversations: DataFrame) -> DataFrame:
    """The latest user message of each conversation."""
    user = conversations.where(F.lower("role") == "user")
    others = [F.col(c) for c in conversations.columns if c != "conv_id"]
    return user.groupBy("conv_id").agg(F.max_by(F.struct(*others), "turn").alias("m")).select("conv_id", "m.*")


def resolve_images(asked: DataFrame, conversations: DataFrame) -> DataFrame:
    """query_id, images: a request's own images; without any, those of the latest user
    message of its conversation; blank ones are left out."""
    latest = last_user(conversations).select(F.col("conv_id").alias("c"), F.col("images").alias("from_message"))
    joined = asked.join(latest, F.col("conv_id") == F.col("c"), "left")
    none = F.array().cast("array<string>")
    chosen = F.when(F.size(F.coalesce("images", none)) > 0, F.col("images")).otherwise(F.coalesce("from_message", none))
    return joined.select("query_id", F.filter(chosen, lambda x: x.isNotNull() & ~requests.is_blank(x)).alias("images"))


def context_block(no: Column, file_name: Column, context: Column, page: Column, entities: Column, text: Column, parent: Column) -> Column:
    """One numbered result of a prompt."""
    source = F.when(F.length(context) > 0, F.concat(F.lit("【"), file_name, F.lit(" | "), context, F.lit("】"))).otherwise(F.concat(F.lit("【"), file_name, F.lit("】")))
    where = F.when(page > 0, F.concat(F.lit("（第 "), page.cast("string"), F.lit(" 页）"))).otherwise("")
    tags = F.when(F.size(F.coalesce(entities, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" 实体:"), F.array_join(entities, "、"))).otherwise("")
    whole = F.when((F.length(parent) > 0) & (parent != text), F.concat(F.lit("\n（所属小节）\n"), parent)).otherwise("")
    return F.concat(F.lit("["), no.cast("string"), F.lit("] "), source, where, tags, F.lit("\n"), text, whole, F.lit("\n\n"))


def prompt_context(results: DataFrame) -> DataFrame:
    """query_id, context: the results of each query as the text of a prompt."""
    block = context_block(F.col("rnk"), F.col("file_name"), F.col("context"), F.col("page_number"), F.col("entities"), F.col("text"), F.col("parent_text"))
    parts = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", block.alias("block")))).alias("parts"))
    return parts.select("query_id", F.array_join(F.transform("parts", lambda p: p["block"]), "").alias("context"))


def build_prompt(asked: DataFrame, results: DataFrame, system: str, past: DataFrame | None = None) -> DataFrame:
    """query_id, messages: system, history and question with its context.

    ``asked``: query_id, text and, as given, images and conv_id (with ``past`` from
    ``history``).  Requests without a result say so in place of the context."""
    none = F.lit(None)
    images = F.col("images") if "images" in asked.columns else none.cast("array<string>")
    shown = F.size(F.filter(F.transform(F.coalesce(images, F.array().cast("array<string>")), requests.image_url), lambda u: u != "")) > 0
    question = F.when(requests.is_blank(F.col("text")), F.when(shown, IMAGE_QUESTION).otherwise("")).otherwise(trim_space(F.col("text")))
    joined = asked.join(prompt_context(results), "query_id", "left")
    kind = "array<struct<turn:bigint,role:string,content:string>>"
    if past is not None:
        joined = joined.join(past.select("conv_id", F.col("messages").cast(kind).alias("past")), "conv_id", "left")
    else:
        joined = joined.withColumn("past", none.cast(kind))
    user = F.concat(F.lit("【知识库上下文】\n"), F.coalesce("context", F.lit(NO_CONTEXT + "\n")), F.lit("\n\n【用户问题】\n"), question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    start = requests.message_content(F.concat(F.lit(system), F.when(shown, IMAGE_NOTE).otherwise("")), none.cast("array<string>"))
    earlier = F.transform(F.coalesce("past", F.array().cast(kind)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return joined.select("query_id", F.concat(F.array(message("system", start)), earlier, F.array(message("user", requests.message_content(user, images)))).alias("messages"))


def parse_mode(raw: Column, best: Column) -> Column:
    """struct<mode, answer>: by the marker at the start, which goes with the white space
    after it; without one by the best citation score (null: 0)."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+", "")
    fallback = F.when(F.coalesce(best, F.lit(0.0)) >= FALLBACK_SCORE, "knowledge_base").otherwise("model")
    mode, answer = fallback, text
    for marker, name in MARKERS.items():
        mode = F.when(text.startswith(marker), name).otherwise(mode)
        answer = F.when(text.startswith(marker), F.regexp_replace(F.substring(text, F.lit(len(marker) + 1), F.length(text)), r"^[\r\n \t]+", "")).otherwise(answer)
    return F.struct(mode.alias("mode"), answer.alias("answer"))


class AnswerMachine:
    """Pieces of an answer -> events.  One definition for batches and streams.

    Text is held back while it is blank or the start of a marker; the first text that
    is neither settles the mode.  In strict mode the mode is ``knowledge_base`` from the
    start and nothing is held back.  State is a tuple of (settled, held, full)."""

    START = (False, "", "")

    def __init__(self, best: float | None = None, strict: bool = False) -> None:
        self.best, self.strict = best or 0.0, strict

    def _settle(self, text: str) -> tuple[str, str]:
        text = text.lstrip()
        for marker, mode in MARKERS.items():
            if text.startswith(marker):
                return mode, text[len(marker) :].lstrip("\r\n \t")
        return ("knowledge_base" if self.best >= FALLBACK_SCORE else "model"), text

    def feed(self, state: tuple, pieces: Iterable[str]) -> tuple[tuple, list[tuple[str, str]]]:
        settled, held, full = state
        events = []
        for piece in pieces:
            if not piece:
                continue
            if not settled and self.strict:
                settled = "knowledge_base"
                events.append(("mode", settled))
            if settled:
                full += piece
                events.append(("delta", piece))
                continue
            held += piece
            text = held.lstrip()
            if not text or any(m.startswith(text) for m in MARKERS):
                continue
            settled, answer = self._settle(text)
            held = ""
            events.append(("mode", settled))
            if answer:
                full += answer
                events.append(("delta", answer))
        return (settled, held, full), events

    def finish(self, state: tuple) -> list[tuple[str, str]]:
        """The events that are left when no piece follows, ``end`` with the whole text last."""
        settled, held, full = state
        events = []
        if not settled:
            settled, answer = ("knowledge_base", held) if self.strict else self._settle(held)
            events.append(("mode", settled))
            if answer:
                full += answer
                events.append(("delta", answer))
        return [*events, ("end", full)]


def answer_events(asked: DataFrame, pieces: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, seq, type, text: the events of each request, in order.

    ``asked``: query_id and strict (no answer without grounds); ``pieces``: query_id,
    piece_no, kind (reasoning or content), text.  A strict request without results gets
    a fixed answer.  Sources and references go with ``end`` where its mode is
    ``knowledge_base``: join ``cite`` and the results by query_id."""
    ship(asked.sparkSession)
    best = results.groupBy("query_id").agg(F.max(citation_score(F.col("vector_score"), F.col("score"))).alias("best"), F.count("*").alias("n_results"))
    strict = F.coalesce(F.col("strict"), F.lit(False)) if "strict" in asked.columns else F.lit(False)
    given = pieces.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "kind", "text"))).alias("pieces"))
    joined = asked.select("query_id", strict.alias("strict")).join(best, "query_id", "left").join(given, "query_id", "left")

    @F.pandas_udf("array<struct<type:string,text:string>>")
    def events(strict: pd.Series, best: pd.Series, n: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for is_strict, score, found, parts in zip(strict, best, n, pieces, strict=True):
            rows, state = [("meta", None)], AnswerMachine.START
            machine = AnswerMachine(None if pd.isna(score) else score, bool(is_strict))
            if is_strict and not (found and found > 0):
                rows += [("mode", "knowledge_base"), ("delta", NOTHING_FOUND), ("end", NOTHING_FOUND)]
            else:
                for p in parts if parts is not None else ():
                    if p["kind"] == "reasoning":
                        rows.append(("reasoning", p["text"]))
                    else:
                        state, new = machine.feed(state, [p["text"]])
                        rows += new
                rows += machine.finish(state)
            out.append([{"type": t, "text": x} for t, x in rows])
        return pd.Series(out)

    made = joined.select("query_id", F.posexplode(events("strict", "best", "n_results", "pieces")).alias("seq", "e"))
    return made.select("query_id", "seq", "e.type", "e.text")
