"""Decoding of completion streams: event lines, text of JSON payloads, repairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

# Finish reasons that clients know, the last payload of a stream.
KNOWN_REASONS = ["stop", "length", "tool_calls", "function_call", "content_filter"]
DONE = "[DONE]"


def event_payload(line: Column) -> Column:
    """What a stream line carries; null for blank lines, the end mark and broken JSON."""
    t = trim_space(line)
    payload = trim_space(F.regexp_replace(t, "(?i)^data:", ""))
    return F.when((payload != "") & (payload != DONE) & F.try_parse_json(payload).isNotNull(), payload)


def _string(v: Column, path: str) -> Column:
    """A member that is a JSON string, else null."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, path, "string"))


def _text(v: Column) -> Column:
    """Text of a JSON value: a string, the parts of an array, or an object's text, content
    and (not inside arrays) reasoning_content, however deep they nest."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        import json

        def of(value: str | None) -> str:
            out, waiting = [], [json.loads(value)] if value else []
            while waiting:  # a stack, so that depth is not bounded by Python's
                x = waiting.pop()
                if isinstance(x, str):
                    out.append(x)
                elif isinstance(x, dict):
                    waiting += [x.get("reasoning_content"), x.get("content"), x.get("text")]
                elif isinstance(x, list):
                    for part in reversed(x):
                        waiting += [part] if isinstance(part, str) else [part.get("content"), part.get("text")] if isinstance(part, dict) else []
            return "".join(out).encode("utf-8", "replace").decode()

        return values.map(of, na_action=None)

    return F.coalesce(text(F.to_json(v)), F.lit(""))


def _first(payload: Column, places: list[list[str]]) -> Column:
    """The first place whose members together have any text."""
    v = F.try_parse_json(payload)
    found = [F.concat(*[_text(F.try_variant_get(v, p, "variant")) for p in paths]) for paths in places]
    return F.coalesce(F.get(F.filter(F.array(*found), lambda x: x != ""), F.lit(0)), F.lit(""))


def content_text(payload: Column) -> Column:
    """The answer text of a payload: of the first choice's delta, its message, or the root."""
    return _first(payload, [["$.choices[0].delta.content", "$.choices[0].delta.text"], ["$.choices[0].message.content", "$.choices[0].message.text"], ["$.content", "$.output_text"]])


def reasoning_text(payload: Column) -> Column:
    """The reasoning text of a payload."""
    at = lambda place: [f"$.choices[0].{place}.reasoning_content", f"$.choices[0].{place}.reasoning"]
    return _first(payload, [at("delta"), at("message"), ["$.reasoning_content"]])


def rewrite_line(line: Column) -> Column:
    """Unknown finish reasons become ``stop``; an empty or null type on a line about tool
    calls becomes ``function``."""
    typed = F.when(F.contains(line, F.lit("tool_call")), F.regexp_replace(line, r'"type"\s*:\s*(?:""|null)', '"type":"function"')).otherwise(line)
    touched = F.contains(line, F.lit("finish_reason")) | F.contains(line, F.lit("tool_call"))
    known = "|".join(KNOWN_REASONS)
    return F.when(touched, F.regexp_replace(typed, rf'"finish_reason"\s*:\s*"(?!(?i:{known})")[^"]*"', '"finish_reason":"stop"')).otherwise(line)


def event_frame(kind: Column, payload: Column) -> Column:
    """A server-sent event: its type and JSON payload."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))
