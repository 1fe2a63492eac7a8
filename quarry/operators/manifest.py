"""Update manifests of client platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.requests import is_blank

# Platforms and the channel where none is given.
PLATFORMS, DEFAULT_PLATFORM, CHANNEL = ("win-x64", "win32-x64"), "win-x64", "stable"


def manifest(settings: DataFrame, asked: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The manifest for each request (request_id, platform, channel, origin).

    ``settings``: a row for each of the two platforms with enabled, latest_version,
    min_supported_version, package_url, sha256, force_update, release_notes.  A relative
    address is put behind the request's origin; it is empty where updates are disabled,
    version or address are blank, or a package of the origin is not in ``files``
    (path)."""
    second = F.lower("platform") == PLATFORMS[1]
    rows = asked.withColumn("p", F.when(second, PLATFORMS[1]).otherwise(DEFAULT_PLATFORM)).join(settings.withColumnRenamed("platform", "s_platform"), F.col("p") == F.col("s_platform"), "left")
    local = F.col("package_url").startswith("/")
    rows = rows.withColumn("url", F.when(local, F.concat("origin", "package_url")).otherwise(F.col("package_url")))
    ok = F.coalesce(F.col("enabled"), F.lit(False)) & ~is_blank(F.col("latest_version")) & ~is_blank(F.col("package_url"))
    if files is not None:
        there = files.select(F.col("path").alias("f_path")).distinct()
        own = F.lower("url").startswith(F.lower(F.concat("origin", F.lit("/"))))
        rows = rows.withColumn("f", F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+(/[^?#]*)", 1)).join(there, F.col("f") == F.col("f_path"), "left")
        ok = ok & (~own | F.col("f_path").isNotNull())
    text = lambda c: F.when(ok, F.col(c)).otherwise("")
    given = lambda c, default: F.when(ok, F.when(is_blank(F.col(c)), default).otherwise(F.col(c))).otherwise("")
    return rows.select(
        "request_id", text("latest_version").alias("latest_version"), text("min_supported_version").alias("min_supported_version"), text("url").alias("package_url"), text("sha256").alias("sha256"),
        (ok & F.coalesce(F.col("force_update"), F.lit(False))).alias("force_update"), text("release_notes").alias("release_notes"), given("platform", DEFAULT_PLATFORM).alias("platform"), given("channel", CHANNEL).alias("channel"),
    )


def newest(files: DataFrame, extension: str = ".zip") -> DataFrame:
    """The path of the latest file with an extension (path, modificationTime)."""
    return files.where(F.lower("path").endswith(extension)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
