"""Answers by a plugged-in generator: a stream of lines, and one call where it says nothing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import completions, requests
from ..storage import written

#: Lines that a worker hands on at once.
LINES = 256


class UpstreamError(Exception):
    """A call that the service refused: its status and body."""

    def __init__(self, status: int, body: str = "") -> None:
        super().__init__(status, body)
        self.status, self.body = status, body


class Generator(Protocol):
    """Both take a request's messages (role, content as JSON) and reasoning effort."""

    def stream(self, messages: list[dict], effort: str) -> Iterable[str]:
        """The lines of a completion stream."""

    def complete(self, messages: list[dict], effort: str) -> str:
        """The JSON payload of a completion that isn't streamed."""


def _call(asked: DataFrame, lines, first: int) -> DataFrame:
    """query_id, line_no (from ``first``), line, status, body; a request that fails has
    what came before, then a row with status."""
    key = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["query_id", "line_no", "line", "status", "body"]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                no = first
                try:
                    for line in lines([m if isinstance(m, dict) else m.asDict() for m in row.messages], row.effort):
                        out.append((row.query_id, no, line, None, None))
                        no += 1
                        if len(out) >= LINES:
                            yield pd.DataFrame(out, columns=columns).astype({"status": "Int32"})
                            out = []
                except UpstreamError as e:
                    out.append((row.query_id, no, None, e.status, e.body))
            yield pd.DataFrame(out, columns=columns).astype({"status": "Int32"})

    return asked.mapInPandas(run, f"query_id {key}, line_no int, line string, status int, body string")


def _pieces(lines: DataFrame) -> DataFrame:
    """query_id, piece_no, kind, text: the reasoning of a line before its content."""
    payload = lines.select("query_id", "line_no", completions.event_payload(completions.rewrite_line(F.col("line"))).alias("p"), "status", "body")
    found = payload.select(
        "query_id", "line_no", F.when(F.col("status").isNull(), completions.reasoning_text(F.col("p"))).alias("reasoning"), F.when(F.col("status").isNull(), completions.content_text(F.col("p"))).alias("content"),
        F.when(F.col("status").isNotNull(), requests.upstream_error(F.col("status"), F.col("body"))).alias("error"),
    )
    kinds = [(2 * i, name) for i, name in enumerate(("reasoning", "content", "error"))]
    rows = F.filter(F.array(*[F.struct((F.col("line_no") * 6 + n).alias("piece_no"), F.lit(k).alias("kind"), F.col(k).alias("text")) for n, k in kinds]), lambda x: x["text"] != "")
    return found.select("query_id", F.inline(rows))


def generate(asked: DataFrame, generator: Generator) -> DataFrame:
    """query_id, piece_no, kind (reasoning, content, error), text of each request.

    ``asked``: query_id, messages (``answer.build_prompt``) and, as given, effort.  Every
    request is streamed once; one whose stream ended without an error and without any
    text that could be decoded is asked again without a stream.  What calls return is
    written before it is read, so no call is repeated by a later step; one that fails is a
    piece of kind ``error``.  Requests go to workers as the rows are dealt."""
    ship(asked.sparkSession)
    effort = F.col("effort") if "effort" in asked.columns else F.lit("none")
    rows = asked.select("query_id", "messages", effort.alias("effort"))
    streamed = written(_pieces(written(_call(rows, generator.stream, 0), "generated-lines")), "generated-pieces")
    silent = rows.join(streamed.where("kind <> 'reasoning'").select("query_id").distinct(), "query_id", "left_anti")
    # a payload that stands alone is read as the line of a stream; it comes after all that was streamed
    once = written(_call(silent, lambda messages, effort: [generator.complete(messages, effort)], 1 << 20), "generated-whole")
    return streamed.unionByName(_pieces(once))
