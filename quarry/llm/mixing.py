"""Mixing sources to target weights (operator 4), in DataFrame functions only.

Every document gets a hash-random key.  Keys are dealt into fixed-width ranges,
so that (source, range) is a range partition of the source whose borders need no
sampling; a document's position in its source is the sum of all earlier ranges
(a small table) plus a running sum inside its own range.  One source may hold
any share of the rows: it is spread over all its ranges, and no task sees more
than one range of it at a time.  The mix takes the words of each source in key
order up to its exact budget, starting over for further epochs; the document on
which the budget ends is taken in part.

Edge cases: null texts have size 0 and are taken 0 times; a null source is a
source of its own (last in order); repeated rows count separately; an empty
table gives an empty result; only the named columns are read, so further
columns with any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import table, written

#: Words of a text: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A range of a large source holds about so many rows; smaller sources have up to 64 ranges.
ROWS_PER_RANGE = 4096


def word_count(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``n``, the place of each row in the order of ``by`` (nulls last), from 0.  Rows
    are dealt by ranges and numbered inside them; a range starts where those before it
    end, and only as many rows as there are ranges meet in one place."""
    key = F.col(by).asc_nulls_last()
    own = written(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()), "mix-numbers")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return own.join(starts, part == F.col("part")).withColumn("n", F.col("start") + place).drop("at", "part", "start")


def source_targets(sizes: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """(source, source_size) -> with target: all words shared by weight, at most
    ``cap`` times the source's size each, the excess reshared by weight.

    ``weights`` repeat over the sources by code point, null last.  The shares are
    min(cap * size, weight * level).  The level starts at an even share and rises as the
    excess of sources whose cap stands below it is reshared, until none is above; each
    step is one aggregation over the sources, however many there are.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    named = numbered(sizes, "source").withColumn("w", w).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    named = written(named.select("source", "source_size", "w", "limit"), "mix-weights")
    level, full = 0.0, None
    while True:
        over = F.col("limit") < F.col("w") * F.lit(level)
        free = lambda c, over=over: F.coalesce(F.sum(F.when(over, 0.0).otherwise(F.col(c))), F.lit(0.0))
        got = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)).alias("capped"), free("w").alias("w"), F.count_if(over).alias("full")).first()
        if got["full"] == full or not got["w"]:
            break
        full, level = got["full"], (got["all"] - got["capped"]) / got["w"]
    return named.select("source", "source_size", F.least(F.col("limit"), F.col("w") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, *, weights: list[float] = (1.0, 2.0, 3.0), cap: int = 3, seed: int = 7, keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, part
    (and the columns ``keep``, prefixed by nothing, which must not be among these).

    ``taken`` counts words over all epochs; ``taken div size`` is the number of
    whole copies and ``part`` the words of the one copy that the budget cuts.
    """
    # 63 bits, so that keys and their ranges have one order
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.coalesce(F.length(text_col), F.lit(-1))), 1)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("th"), *keep
    )
    # the narrow columns are written once, so that sums, targets and the mix itself read no text
    narrow = written(sized.select("doc_id", "source", "size", "key", "th"), "mix-sizes")
    by_source = written(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    ranges = F.greatest(F.ceil(F.col("rows") / ROWS_PER_RANGE), F.least(F.lit(64), F.ceil(F.col("rows") / 64)))
    targets = source_targets(by_source.select("source", "source_size"), list(weights), cap).join(by_source.select(F.col("source").alias("r_source"), ranges.alias("ranges")), F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source").withColumnRenamed("source", "t_source")
    targets = written(targets, "mix-targets")

    def dealt(rows: DataFrame) -> DataFrame:
        unit = F.shiftright("key", 10) / F.lit(float(1 << 53))
        return rows.join(targets, rows["source"].eqNullSafe(targets["t_source"])).withColumn("bin", F.floor(unit * F.col("ranges")).cast("long"))

    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = dealt(narrow).groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    starts = written(bins.select(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("start")), "mix-starts")
    # what is equal in all of these is one text under one id: whichever comes first is the same
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(sized if keep else narrow).withColumn("at", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(starts, placed["source"].eqNullSafe(starts["b_source"]) & (placed["bin"] == starts["b_bin"]))
    at = F.col("start") + F.col("at")
    budget = F.floor("target").cast("long")
    epochs = [F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("source_size") * e - at)) for e in range(cap)]
    taken = sum(epochs[1:], epochs[0])
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    return joined.withColumn("taken", taken.cast("long")).withColumn("part", part.cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken", "part", *keep)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a row for each whole
    copy, and the first ``part`` words (as they stand) of the one cut by the budget."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = F.col("row")
    flat = packed.select("row", row[id_col].alias("doc_id"), row[text_col].alias("text"), row[source_col].alias("source"))
    mixed = mix_sources(flat, keep=["row"], **options)
    copies = F.array_repeat(F.lit(-1).cast("long"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    words = F.explode(F.concat(copies, F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>"))))
    out = mixed.select("row", words.alias("words"))
    cut = F.array_join(F.slice(F.regexp_extract_all(row[text_col], F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = F.when(F.col("words") < 0, value).otherwise(cut)
        elif c == "n_chars":
            value = F.when(F.col("words") < 0, value).otherwise(F.length(cut).cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return out.select(*columns)


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
