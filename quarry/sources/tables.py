"""Tables of documents: grouping of rows by budget, and Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of an element, rows of a table element, overhead of a row.
ELEMENT_TOKENS, TABLE_ROWS, ROW_OVERHEAD = 700, 10, 8


def group_rows(rows: list[list[str]], count, most_tokens: int = ELEMENT_TOKENS, most_rows: int = TABLE_ROWS) -> list[tuple[str, list]]:
    """Rows of cells -> ("table", rows) and ("para", [cell]) elements in order.

    Blank rows go.  A group has at most ``most_rows`` rows and ``most_tokens`` tokens; a
    row that is over the budget by itself ends the group and becomes paragraphs."""
    out: list[tuple[str, list]] = []
    group: list[list[str]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            out.append(("table", group))
        group, held = [], 0

    for cells in (r for r in rows if any(r)):
        cost = count(" ".join(cells)) + ROW_OVERHEAD
        if cost > most_tokens:
            flush()
            out.extend(("para", [c]) for c in cells if c)
            continue
        if len(group) == most_rows or held + cost > most_tokens:
            flush()
        group.append(cells)
        held += cost
    flush()
    return out


def table_markdown(rows: Column, columns: Column) -> Column:
    """Markdown of array<array<string>> rows, filled up to ``columns`` cells: the first row
    is the header, and also the only data row where there is no other."""
    filled = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(columns - F.size(r), F.lit(0)).cast("int")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(filled(r), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), columns.cast("int")), F.lit("\n"))
    data = F.when(F.size(rows) > 1, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows)
    return F.concat(line(rows[0]), rule, F.array_join(F.transform(data, line), ""))


def markdown(rows: list[list[str]], columns: int) -> str:
    """The same for a reader that has the rows in hand."""
    line = lambda r: "| " + " | ".join(r + [""] * (columns - len(r))) + " |\n"
    return line(rows[0]) + "|" + " --- |" * columns + "\n" + "".join(map(line, rows[1:] or rows))
