"""Answer events of live requests: state is kept for each request between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..deploy import ship
from ..operators.answer import AnswerMachine

EVENTS = "query_id long, seq int, type string, text string"
STATE = "seq int, settled string, held string, full string, reasoning string"


def new_reasoning(known: str, upstream: str) -> tuple[str, str]:
    """(all reasoning so far, its new part): upstream text is either all of it so far, which
    then begins with what is known, or only the next part."""
    whole = upstream if upstream.startswith(known) else known + upstream
    return whole, whole[len(known) :]


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, settled, held, full, reasoning = state.get if state.exists else (0, "", "", "", "")
    rows = pd.concat(list(batches)).sort_values("piece_no")
    out: list[tuple[str, str | None]] = [("meta", None)] if not state.exists else []
    machine = AnswerMachine(float(rows.best.max()) if rows.best.notna().any() else None, bool(rows.strict.any()))
    now = (settled or False, held, full)
    ended = False
    for piece in rows.itertuples():
        if piece.kind == "reasoning":
            reasoning, part = new_reasoning(reasoning, piece.text or "")
            out += [("reasoning", part)] if part else []
        elif piece.kind == "end":
            out += machine.finish(now)
            ended = True
        else:
            now, events = machine.feed(now, [piece.text])
            out += events
    if ended:
        state.remove()
    else:
        state.update((seq + len(out), now[0] or "", now[1], now[2], reasoning))
    yield pd.DataFrame([(key[0], seq + i, t, x) for i, (t, x) in enumerate(out)], columns=["query_id", "seq", "type", "text"])


def answer_stream(pieces: DataFrame) -> DataFrame:
    """A stream of pieces -> a stream of events.

    ``pieces``: query_id, piece_no, kind (content, reasoning, end), text, and on each row
    the request's ``best`` citation score and ``strict``.  State is what the request has
    not shown yet and its text so far, and goes with its end."""
    ship(pieces.sparkSession)
    return pieces.groupBy("query_id").applyInPandasWithState(_advance, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
