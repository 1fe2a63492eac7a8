"""Columns of requests: limits, modes, file names, media types, images, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

# Limits of result sizes, modes, readable extensions, media types.
SEARCH_DEFAULT, SEARCH_MOST, CHAT_DEFAULT, CHAT_MOST, FETCH_MOST = 5, 50, 8, 20, 50
MODES, DEFAULT_MODE = ("vector", "hybrid", "rerank"), "rerank"
MEDIA_TYPES = {
    ".md": "text/markdown",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
}
EXTENSIONS = [".pdf", *MEDIA_TYPES]
EFFORTS = ("low", "medium", "high")
COMPLETIONS = "/chat/completions"


def _limit(asked: Column, default: int, most: int) -> Column:
    return F.least(F.when(asked <= 0, F.lit(default)).otherwise(asked), F.lit(most))


def search_top_k(asked: Column) -> Column:
    return _limit(asked, SEARCH_DEFAULT, SEARCH_MOST)


def chat_top_k(asked: Column) -> Column:
    return _limit(asked, CHAT_DEFAULT, CHAT_MOST)


def fetch_size(top_k: Column, multiplier: Column) -> Column:
    """How many candidates each list gives: a multiple of the results, at least as many
    as those, at most 50."""
    return F.least(F.greatest(top_k * F.greatest(multiplier, F.lit(1)), top_k), F.lit(FETCH_MOST))


def mode(asked: Column, configured: str = DEFAULT_MODE) -> Column:
    """A known mode, trimmed and lower-cased; null takes the configured one, anything else
    ``rerank``."""
    m = F.lower(trim_space(F.coalesce(asked, F.lit(configured))))
    return F.when(m.isin(*MODES), m).otherwise(F.lit(DEFAULT_MODE))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def extension(name: Column) -> Column:
    """The last ``.ext`` of a name, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.[^./\\]+$", 0))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def media_type(name: Column) -> Column:
    """Media type by extension; null where the general reader decides (PDF, unknown)."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(known, extension(name))


def is_supported(name: Column) -> Column:
    return extension(name).isin(*EXTENSIONS)


def is_acceptable_name(name: Column) -> Column:
    """Uploads need a base name that isn't blank and has no leading dot."""
    base = base_name(name)
    return ~is_blank(base) & ~base.startswith(".")


def image_url(raw: Column) -> Column:
    """Data and web addresses as they are; bare base64 as a data address, PNG by its first
    characters, else JPEG; blank is empty."""
    s = trim_space(F.coalesce(raw, F.lit("")))
    kind = F.when(s.startswith("iVBORw0KGgo"), "image/png").otherwise("image/jpeg")
    return F.when((s == "") | F.lower(s).rlike("^(data:image|https?://)"), s).otherwise(F.concat(F.lit("data:"), kind, F.lit(";base64,"), s))


def message_content(text: Column, images: Column) -> Column:
    """JSON of a message's content: a string without images, else an array of a text part
    (unless blank) and image parts."""
    urls = F.filter(F.transform(F.coalesce(images, F.array().cast("array<string>")), image_url), lambda u: u != "")
    parts = "array<struct<type:string,text:string,image_url:struct<url:string>>>"
    empty = F.array().cast(parts)
    nothing = F.lit(None).cast("struct<url:string>")
    words = F.when(is_blank(text), empty).otherwise(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.alias("image_url"))).cast(parts))
    shown = F.transform(urls, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url")))
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    return F.when(F.size(urls) == 0, quoted).otherwise(F.to_json(F.concat(words, shown)))


def reasoning_effort(effort: Column, thinking: Column) -> Column:
    """``none`` without thinking; low, medium and high as asked; else medium."""
    e = F.lower(trim_space(F.coalesce(effort, F.lit(""))))
    return F.when(~F.coalesce(thinking, F.lit(False)), "none").when(e.isin(*EFFORTS), e).otherwise("medium")


def completions_url(base: Column, default: str) -> Column:
    """The completions address of a service; ``default`` where none is configured."""
    b = F.regexp_replace(trim_space(F.coalesce(base, F.lit(""))), "/+$", "")
    return F.when(b == "", F.lit(default)).when(F.lower(b).endswith(COMPLETIONS), b).otherwise(F.concat(b, F.lit(COMPLETIONS)))


def upstream_error(status: Column, body: Column) -> Column:
    """A code and at most 240 characters of the body for a failed call."""
    snippet = F.left(trim_space(F.coalesce(body, F.lit(""))), F.lit(240))
    return F.when(status == 429, "429: busy or rate-limited").when(status == 401, "401: key not valid").otherwise(F.concat(status.cast("string"), F.lit(": "), snippet))


def public_config(model: Column) -> Column:
    """What clients may know of the generator: its name, and how it can be asked to think."""
    return F.struct(model.alias("model"), F.lit(True).alias("thinking_supported"), F.array(*[F.lit(x) for x in EFFORTS]).alias("reasoning_efforts"))
