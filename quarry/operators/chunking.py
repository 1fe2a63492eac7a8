"""Parent and child chunks by token budgets.

Budgets are greedy and reset, which no window function expresses: they are folds over
a section's ordered elements, and over a parent's lines, by ``aggregate`` in the JVM.
Folds run within a section or a parent, so tasks never gather more than one of those.

Folds keep places of lines and elements, not their texts, which are cut out at the end.

The counter of tokens is pluggable: it splits a whole array of texts at once, so it may
also be a vectorized Python function (as a trained tokenizer is).  The one here takes a
run of Latin letters or digits, one Han character, or one other visible character as a
token.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import tag
from ..functions.requests import is_blank
from ..functions.text import named, trim_space
from .cleaning import clean


class TokenCounter(Protocol):
    def tokens(self, texts: Column) -> Column:
        """array<array<string>> of an array<string>: for each text strings that, joined, are
        the text, as many as it has tokens (some may be empty, where a token is a part of
        a character)."""


class RegexTokens:
    """White space belongs to the token after it."""

    PATTERN = r"(?U)\s*(?:[A-Za-z0-9_]+|\S)"

    def tokens(self, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.regexp_extract_all(x, F.lit(self.PATTERN), F.lit(0)))


@dataclass(frozen=True)
class ChunkOptions:
    """Tokens of a parent and of a child, overlap of children, lengths."""

    parent_tokens: int = 800
    child_tokens: int = 280
    overlap_tokens: int = 40
    title_length: int = 80
    parent_length: int = 1800
    counter: TokenCounter = RegexTokens()


def windows(tokens: Column, size: int, step: int) -> Column:
    """Windows of ``size`` tokens every ``step``; the window that reaches the end is last."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")) * step
    pieces = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: trim_space(F.array_join(F.slice(tokens, i + 1, size), "")))
    return F.when(n > 0, F.filter(pieces, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def split_long(text: Column, size: int, step: int, counter: TokenCounter = RegexTokens()) -> Column:
    """The windows of a text."""
    return named(counter.tokens(F.array(text)), lambda t: windows(t[0], size, step))


def split_tokens(text: Column, most: int, counter: TokenCounter = RegexTokens()) -> Column:
    """Pieces of at most ``most`` tokens, without overlap."""
    return split_long(text, most, most, counter)


def lines_of(parent: Column) -> Column:
    """The trimmed lines of a parent that aren't empty."""
    return F.filter(F.transform(F.split(parent, "\n", -1), trim_space), lambda x: x != "")


def pack_children(lines: Column, tokens: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """array<string>: lines, each with its tokens, packed into children of at most the budget.

    A full child leaves its last lines, up to the overlap, to the next one (which may then
    exceed the budget by them); a line above the budget is cut into windows, without
    overlap before or after it."""
    size, overlap = options.child_tokens, options.overlap_tokens
    cost = lambda i: F.greatest(F.lit(1), F.size(F.get(tokens, i)))
    # out: runs (first, last) of lines, last -1 for one that is cut by itself; a child holds the lines from start to at - 1
    state = lambda out, at, start, n: F.struct(out.alias("out"), at.alias("at"), start.alias("start"), n.alias("n"))
    run = lambda first, last: F.array(F.struct(first.alias("first"), last.alias("last")))
    begin = state(F.array().cast("array<struct<first:int,last:int>>"), F.lit(0), F.lit(0), F.lit(0))
    put = lambda s: F.when(s["start"] < s["at"], F.concat(s["out"], run(s["start"], s["at"] - 1))).otherwise(s["out"])

    def tail(s: Column) -> Column:
        """Where the last lines begin that have the overlap, and their tokens."""
        take = lambda k, i: F.when(k["n"] < overlap, F.struct(i.alias("first"), (k["n"] + cost(i)).alias("n"))).otherwise(k)
        return F.aggregate(F.sequence(s["at"] - 1, s["start"], F.lit(-1)), F.struct(s["at"].alias("first"), F.lit(0).alias("n")), take)

    def step(s: Column, i: Column) -> Column:
        n, after = cost(i), s["at"] + 1
        lone = state(F.concat(put(s), run(i, F.lit(-1))), after, after, F.lit(0))
        full = named(tail(s), lambda k: state(put(s), after, k["first"], k["n"] + n))
        more = state(s["out"], after, s["start"], s["n"] + n)
        return F.when(n > size, lone).when((s["n"] + n > size) & (s["start"] < s["at"]), full).otherwise(more)

    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    text = lambda r: F.when(r["last"] < 0, windows(F.get(tokens, r["first"]), size, max(1, size - overlap))).otherwise(F.array(F.array_join(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), "\n")))
    return F.flatten(F.transform(F.aggregate(places, begin, step, put), text))


def split_children(parent: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """The children of a parent's text, with a counter of built-in expressions."""
    return named(lines_of(parent), lambda x: named(options.counter.tokens(x), lambda t: pack_children(x, t, options)))


def pack_parents(elements: Column, tokens: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """array<struct<heading, text>> from a section's ordered array<struct<kind, text>>, each
    element with its tokens.

    A heading starts a parent and is its first line; so does an element that the budget
    has no room for, under the heading before it but without its line."""
    words = lambda i: F.coalesce(F.get(elements, i)["text"], F.lit(""))
    cost = lambda i: F.greatest(F.lit(1), F.size(F.get(tokens, i)))
    # out: the place of a parent's heading (-1 without one), of its first element and of its last
    state = lambda out, head, first, last, n: F.struct(out.alias("out"), head.alias("head"), first.alias("first"), last.alias("last"), n.alias("n"))
    put = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct(s["head"].alias("head"), s["first"].alias("first"), s["last"].alias("last"))))).otherwise(s["out"])
    none = F.lit(-1)
    begin = state(F.array().cast("array<struct<head:int,first:int,last:int>>"), none, none, none, F.lit(0))

    def step(s: Column, i: Column) -> Column:
        n, blank = cost(i), is_blank(words(i))
        head = state(put(s), i, i, i, F.when(blank, F.lit(0)).otherwise(n))
        full = state(put(s), s["head"], i, i, n)
        more = state(s["out"], s["head"], F.when(s["n"] > 0, s["first"]).otherwise(i), i, s["n"] + n)
        over = (s["n"] + n > options.parent_tokens) & (s["n"] > 0)
        return F.when(F.get(elements, i)["kind"] == "header", head).when(blank, s).when(over, full).otherwise(more)

    places = F.when(F.size(elements) > 0, F.sequence(F.lit(0), F.size(elements) - 1)).otherwise(F.array().cast("array<int>"))
    held = lambda r: F.filter(F.transform(F.slice(elements, r["first"] + 1, r["last"] - r["first"] + 1), lambda e: F.coalesce(e["text"], F.lit(""))), lambda x: ~is_blank(x))
    parent = lambda r: F.struct(F.when(r["head"] >= 0, words(r["head"])).otherwise("").alias("heading"), F.array_join(held(r), "\n").alias("text"))
    return F.transform(F.aggregate(places, begin, step, put), parent)


def split_parents(elements: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """The parents of a section's elements, with a counter of built-in expressions."""
    texts = F.transform(elements, lambda e: F.coalesce(e["text"], F.lit("")))
    return named(options.counter.tokens(texts), lambda t: pack_parents(elements, t, options))


def title_of(heading: Column, parent: Column, length: int = 80) -> Column:
    """The heading, else the parent's first line, cut."""
    return F.left(F.when(~is_blank(heading), heading).otherwise(F.split(parent, "\n")[0]), F.lit(length))


def parent_chunks(elements: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """document_id, section_no, page_number, parent_no, parent_id, title, text."""
    rows = elements.groupBy("document_id", "section_no").agg(F.min("page_number").alias("page_number"), F.array_sort(F.collect_list(F.struct("element_no", "kind", "text"))).alias("elements"))
    # tokens are a column of their own, so that a counter may be a Python function
    counted = rows.withColumn("tokens", options.counter.tokens(F.transform("elements", lambda e: F.coalesce(e["text"], F.lit("")))))
    parents = counted.select("document_id", "section_no", "page_number", F.posexplode(pack_parents(F.col("elements"), F.col("tokens"), options)).alias("parent_no", "p"))
    key = F.sha2(F.concat_ws("\n", "document_id", F.col("section_no").cast("string"), F.col("parent_no").cast("string")), 256)
    return parents.select("document_id", "section_no", "page_number", "parent_no", key.alias("parent_id"), title_of(F.col("p.heading"), F.col("p.text"), options.title_length).alias("title"), F.col("p.text").alias("text"))


def chunk(elements: DataFrame, options: ChunkOptions = ChunkOptions(), cleaned: bool = False) -> DataFrame:
    """Elements -> chunks: cleaned, packed into parents and children, tagged.  Ids follow
    from document and ordinals, so the same input gives the same chunks."""
    parents = parent_chunks(elements if cleaned else clean(elements), options).withColumn("lines", lines_of(F.col("text")))
    counted = parents.withColumn("tokens", options.counter.tokens(F.col("lines")))
    rows = counted.select("*", F.posexplode(pack_children(F.col("lines"), F.col("tokens"), options)).alias("child_no", "content"))
    key = F.sha2(F.concat_ws("\n", "parent_id", F.col("child_no").cast("string")), 256)
    return rows.select(
        key.alias("chunk_id"), "document_id", "section_no", "parent_no", "child_no", "parent_id", F.left("text", F.lit(options.parent_length)).alias("parent_text"), "content",
        F.col("title").alias("context"), F.when(F.col("page_number") > 0, F.col("page_number")).alias("page_number"), tag(F.concat_ws("\n", "content", "title")).alias("entities"),
    )
