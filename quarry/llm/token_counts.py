"""Token counts (operator 1): delta-maintained rollups.

A change has the contribution of a document before and after it; an insert has no
before, a delete no after, a revised count (another tokenizer version, a new text,
another source) both.  A batch of changes is summed to one signed row per source,
language and tokenizer version, and those rows are committed under the batch's id.
Totals are the sum of all committed rows: they never need the documents again.

A commit writes beside the committed batches and then renames, which either
happens or doesn't; a batch id that is committed is not committed again, so a
writer that fails may simply repeat its batch.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .storage import new_folder, table, written

#: Tokenizers that the query counts by: version -> the pattern whose matches are tokens.  A
#: contribution takes its number of tokens as a column, so any tokenizer can give it
#: (``bpe_tokens`` does by a trained vocabulary).
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "wordpunct-2": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}
KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def n_tokens(text: Column, version: str) -> Column:
    """Tokens of a text by a tokenizer version; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def bpe_tokens(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Tokens of a text by byte-level BPE with a public vocabulary; null texts have none."""
    ranks, pattern = bpe.vocabulary(path)
    return bpe.round_trip(spark, text, ranks, pattern)["n_tokens"]


def contribution(source: Column, lang: Column, version: str, tokens: Column) -> Column:
    return F.struct(source.alias("source"), lang.alias("lang"), F.lit(version).alias("tokenizer_version"), tokens.cast("long").alias("n_tokens"))


def signed_sums(changes: DataFrame) -> DataFrame:
    """(before, after) -> the change of each key's totals; keys that don't change are left out."""
    signs = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("c")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("c")))
    rows = changes.select(F.inline(F.filter(signs, lambda x: x["c"].isNotNull())))
    sums = rows.groupBy("c.source", "c.lang", "c.tokenizer_version").agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("c.n_tokens")).cast("long").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder.

    Null sources and languages are keys like others.  An empty batch commits and
    changes nothing.  Further columns of ``changes`` are not read.  The same
    contribution inserted twice counts twice: a change is identified by its batch
    only, and the totals of a key may fall below zero if more is deleted than was
    inserted.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        top = self._at(f"{self.path}/batches")
        return sorted(x.getPath().toString() for x in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _place(self, rows: DataFrame, name: str) -> bool:
        """Writes aside and renames to ``name``; False if that exists."""
        target = f"{self.path}/batches/{name}"
        if self._fs.exists(self._at(target)):
            return False
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        self._fs.mkdirs(self._at(f"{self.path}/batches"))
        return self._move(aside, target)

    def _move(self, aside: str, target: str) -> bool:
        """Renames a folder to one that doesn't exist; False, and it is removed, if it does."""
        if not self._fs.exists(self._at(target)) and self._fs.rename(self._at(aside), self._at(target)):
            # where another writer was first, a rename into its folder is undone
            inner = self._at(f"{target}/{aside.rpartition('/')[2]}")
            if not self._fs.exists(inner):
                return True
            self._fs.delete(inner, True)
        else:
            self._fs.delete(self._at(aside), True)
        return False

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of (before, after); False, and nothing done, if it is there."""
        return self._place(signed_sums(changes), "b" + hashlib.sha256(batch_id.encode()).hexdigest())

    def _base(self) -> tuple[int, str | None]:
        """Number and folder of the latest compaction; 0 and None without one."""
        top = self._at(f"{self.path}/bases")
        numbers = [int(x.getPath().getName()) for x in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return (n := max(numbers, default=0)), f"{self.path}/bases/{n}" if n else None

    def _rows(self) -> tuple[DataFrame, list[str], int]:
        """Rows whose sums are the totals, the batches that they hold, the base's number."""
        number, base = self._base()
        held = {r.name for r in self.spark.read.schema("name string").parquet(f"{base}/names").collect()} if base else set()
        batches = [x for x in self._batches() if x.rpartition("/")[2] not in held]
        places = [f"{base}/totals"] * bool(base) + batches
        rows = self.spark.read.schema(TOTALS).parquet(*places) if places else self.spark.createDataFrame([], TOTALS)
        return rows, sorted(held | {x.rpartition("/")[2] for x in batches}), number

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of every key that isn't zero."""
        sums = self._rows()[0].groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Sums all committed batches into one base, so that totals read that and what was
        committed later; False if another writer made the next base first.  It becomes
        the base by one rename.  Batches stay known by name (a row each), so that one sent
        again is still not committed again, and their files stay for readers of before."""
        rows, names, number = self._rows()
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.parquet(f"{aside}/names")
        self._fs.mkdirs(self._at(f"{self.path}/bases"))
        return self._move(aside, f"{self.path}/bases/{number + 1}")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all are inserted; those in other languages than
    English get a newer tokenizer; those that ``labels`` calls toxic are deleted.  The
    first two are then sent again, as after a failure, and change nothing.

    Counts by document are written once: revisions and deletes take them from there and
    count no text again.  After the batches the rollup is compacted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    none = F.lit(None)
    newer = ~F.col("lang").eqNullSafe("en")
    old, new = TOKENIZERS
    counted = written(docs.select("doc_id", "source", "lang", n_tokens(F.col("text"), old).alias(old), F.when(newer, n_tokens(F.col("text"), new)).alias(new)), "token-counts")
    of = lambda version: contribution(F.col("source"), F.col("lang"), version, F.col(f"`{version}`"))
    rollup = TokenRollup(spark, new_folder(spark, "token-rollup"))
    load = counted.select(none.alias("before"), of(old).alias("after"))
    revise = counted.where(newer).select(of(old).alias("before"), of(new).alias("after"))
    remove = counted.join(toxic, "doc_id", "left_semi").select(F.when(newer, of(new)).otherwise(of(old)).alias("before"), none.alias("after"))
    for batch_id, changes in (("load", load), ("revise", revise), ("remove", remove), ("load", load), ("revise", revise)):
        rollup.commit(batch_id, changes)
    rollup.compact()
    return rollup.totals()


OP1_SQL = r"""
WITH t AS (
  SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'wordpunct-2' END AS tokenizer_version,
         CASE WHEN lang = 'en' THEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
              ELSE len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) END AS n
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1))
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM t GROUP BY ALL
"""
