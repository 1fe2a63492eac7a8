"""Text columns: tokens, cleaning, paragraphs, page-number lines, OCR text.

All are built-in expressions (higher-order functions included), so they stay in the
JVM.  Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as Han, a page-number line, an OCR misreading.
HAN = "一-鿿"
PAGE_LINE = (
    r"(?iU)^(?:第\s*\d+\s*页(?:\s*[\/共]\s*\d+\s*页)?|-+\s*\d+\s*-+|—\s*\d+\s*—|\d+\s*\/\s*\d+"
    r"|Page\s+\d+(?:\s*of\s*\d+)?|\d{1,3}|\[\d{1,3}\]|〔\d{1,3}〕)$"
)
PERCENT_READ_AS_9 = r"不超过([1-9]\d)9(?=[。．]|$)"
CLINICAL_WORDS = ["治疗", "诊断", "患者"]
REPEAT_LENGTHS = (2, 40)
GUARDED_LENGTH = 24
USABLE_CHARS = 40
GARBAGE_LENGTH = 6

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def named(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokenize(text: Column) -> Column:
    """array<string>: runs of ASCII letters, digits, ``_`` and ``-``, lower-cased, and
    every Han character, followed by the pair it makes with a Han character right
    before it; anything else separates.  Null and blank texts give no tokens."""
    # only A-Z is lower-cased, before the match: other letters that lower to ASCII stay out
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    runs = F.regexp_extract_all(t, F.lit(rf"[a-z0-9_-]+|[{HAN}]+"), F.lit(0))
    latin = lambda run: run.rlike(r"^[a-z0-9_-]")

    def han(run: Column) -> Column:
        at = lambda i: F.when(i == 1, F.array(F.substring(run, 1, 1))).otherwise(F.array(run.substr(i, F.lit(1)), run.substr(i - 1, F.lit(2))))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), at))

    mixed = F.flatten(F.transform(runs, lambda run: F.when(latin(run), F.array(run)).otherwise(han(run))))
    return F.when(t.rlike(f"[{HAN}]"), mixed).otherwise(runs)


def collapse_space(text: Column) -> Column:
    """Trimmed, with every run of (Unicode) white space as one space."""
    return F.regexp_replace(trim_space(text), r"(?U)\s+", " ")


def trim_space(text: Column) -> Column:
    """Trimmed of Unicode white space on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; CRLF and LF end a line."""
    return F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)


def is_page_line(line: Column) -> Column:
    """Whether a collapsed line is nothing but a page number."""
    return line.rlike(PAGE_LINE)


def repeat_key(line: Column) -> Column:
    """What makes two lines the same header, footer or watermark."""
    return F.lower(collapse_space(line))


def looks_like_content(key: Column) -> Column:
    """Long lines with a clinical word are never watermarks."""
    return (F.length(key) > GUARDED_LENGTH) & key.rlike("|".join(CLINICAL_WORDS))


def clean_text(text: Column, repeats: Column | None = None) -> Column:
    """Collapses the space of each line and drops page numbers, ``repeats`` (an array of
    keys) and all but one of blank lines in a row; trimmed.  Null stays null."""
    kept = F.transform(lines(text), collapse_space)
    kept = F.filter(kept, lambda x: ~is_page_line(x))
    if repeats is not None:
        keys = F.coalesce(repeats, F.array().cast("array<string>"))
        kept = F.filter(kept, lambda x: (F.length(x) == 0) | ~F.array_contains(keys, F.lower(x)))
    return trim_space(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, their lines trimmed; empty blocks are left out."""
    trimmed = F.array_join(F.transform(lines(F.coalesce(text, F.lit(""))), trim_space), "\n")
    return F.filter(F.transform(F.split(trimmed, "\n{2,}", -1), lambda x: F.regexp_replace(x, "^\n+|\n+$", "")), lambda x: F.length(x) > 0)


def visible_chars(text: Column) -> Column:
    """Number of characters that are neither white space nor control characters."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)[\s\p{Cntrl}]", "")), F.lit(0))


def has_usable_text(text: Column) -> Column:
    """Whether a page's own text is enough, so that it needs no OCR."""
    return visible_chars(text) >= USABLE_CHARS


def is_garbage_line(line: Column) -> Column:
    """A line of OCR noise: long enough, no Han, many Latin letters."""
    t = trim_space(line)
    return (F.length(t) >= GARBAGE_LENGTH) & (F.regexp_count(t, F.lit(f"[{HAN}]")) == 0) & (F.regexp_count(t, F.lit("[A-Za-z]")) >= GARBAGE_LENGTH)


def ocr_score(text: Column, confidence: Column) -> Column:
    """How plausible an OCR result is: confidence and Han characters for it, Latin letters
    and garbage lines against it."""
    han, latin = F.regexp_count(text, F.lit(f"[{HAN}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    garbage = F.size(F.filter(lines(text), is_garbage_line))
    return confidence * 100 + han * 2 - latin - garbage * 80


def ocr_best(readings: Column) -> Column:
    """Of an array<struct<text, confidence>> of one picture's readings in several layouts the
    text of the most plausible; the first of equals, empty without any that isn't blank."""
    told = F.filter(readings, lambda r: trim_space(r["text"]) != "")
    scored = F.transform(told, lambda r, i: F.struct(ocr_score(r["text"], r["confidence"]).alias("score"), (-i).alias("place"), r["text"].alias("text")))
    return F.coalesce(F.array_max(scored)["text"], F.lit(""))


def ocr_normalize(text: Column) -> Column:
    """OCR text without garbage lines and without space between Han characters, and with a
    percent sign that was read as 9 put right."""
    kept = F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), trim_space), lambda x: ~is_garbage_line(x))
    joined = trim_space(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))
    joined = F.regexp_replace(joined, rf"(?U)([{HAN}])\s+(?=[{HAN}])", "$1")
    return F.regexp_replace(joined, PERCENT_READ_AS_9, "不超过$1%")


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes (or of a text's UTF-8), lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def preview(text: Column, limit: int = 300) -> Column:
    """The first ``limit`` characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)
