"""Incremental ingestion: acceptance, duplicate detection, versions, progress.

Files of a batch are in the order of ``file_no``; a batch without one, as of a stream,
is in the order of its paths, and its log numbers files by a hash of the path.  No
order is made over the whole batch.  What happens to a file is decided on its hash and
names; its content meets no shuffle unless too many files are taken and too many left.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import requests
from ..functions.text import content_hash
from ..schema import CHUNKS, INGEST_LOG
from ..storage import FEW, discard, few, written

#: Tasks that are listed; versions that a read puts together before they are compacted.
RECENT, MOST_DELTAS = 50, 16


def _key(files: DataFrame) -> str:
    return "file_no" if "file_no" in files.columns else "path"


def _order(files: DataFrame) -> Column:
    return F.col(_key(files))


def accept(files: DataFrame) -> DataFrame:
    """Files (file_no, path or file_name, content) with document_id, content_hash and
    status ``accepted`` or ``rejected`` (name not acceptable, or format not readable)."""
    name = requests.base_name(F.col("path" if "path" in files.columns else "file_name"))
    good = requests.is_acceptable_name(name) & requests.is_supported(name)
    return files.withColumns({"file_name": name, "document_id": name, "content_hash": content_hash(F.col("content")), "status": F.when(good, "accepted").otherwise("rejected"), "error": F.when(~good, "name or format not accepted")})


def first_of_each(files: DataFrame) -> DataFrame:
    """Marks accepted files whose bytes an earlier file of the batch has as ``skipped``."""
    order = Window.partitionBy("status", "content_hash").orderBy(_order(files))
    again = (F.col("status") == "accepted") & (F.row_number().over(order) > 1)
    return files.withColumn("status", F.when(again, "skipped").otherwise(F.col("status")))


def mark_known(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Marks accepted files whose bytes are stored already as ``skipped``.  The stored side
    is distinct hashes only, and null hashes match nothing."""
    known = chunks.where("content_hash is not null").select(F.col("content_hash").alias("known")).distinct()
    joined = files.join(known, F.col("content_hash") == F.col("known"), "left")
    return joined.withColumn("status", F.when((F.col("status") == "accepted") & F.col("known").isNotNull(), "skipped").otherwise(F.col("status"))).drop("known")


def new_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The files whose bytes no stored chunk comes from, each content once."""
    fresh = files.join(chunks.where("content_hash is not null").select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.withColumn("n", F.row_number().over(Window.partitionBy("content_hash").orderBy(_order(files)))).where("n = 1").drop("n")


def last_by_name(files: DataFrame) -> DataFrame:
    """Of several files of one name in a batch the last replaces the others."""
    return files.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(_order(files).desc()))).where("n = 1").drop("n")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chunks after documents are replaced by their new chunks."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


class Store:
    """Chunks in versions, each of which adds a folder and replaces nothing.

    A version has its new chunks and the names of documents that are gone from the
    versions before it.  It is written whole and becomes current by one rename of its
    pointer file, so readers see either version, and a run that fails leaves nothing to
    take back.  A read puts together the versions since the last compaction; after
    ``MOST_DELTAS`` of them the next write compacts.  ``vacuum`` removes what no current
    read needs."""

    def __init__(self, spark: SparkSession, path: str, schema: str = CHUNKS) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/current"))

    def _pointers(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(f"{self.path}/current"))]
        return sorted(int(x) for x in names if x.isdigit())

    def version(self) -> int:
        """The current version; 0 before anything is stored."""
        return max(self._pointers(), default=0)

    def _base(self, v: int) -> int:
        """The version that was last written whole, of those up to v."""
        return json.loads(self.spark.read.text(f"{self.path}/current/{v}").first()[0])["base"] if v else 0

    def _conformed(self, chunks: DataFrame) -> DataFrame:
        """Chunks with the types of the store's schema; further columns are kept."""
        kinds = {f.name: f.dataType for f in StructType.fromDDL(self.schema)}
        return chunks.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in chunks.columns if c != "store_version"])

    def read(self, version: int | None = None) -> DataFrame:
        """The chunks of a version, the current one if none is named."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], self.schema)
        base = self._base(v)
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/v{i}/chunks" for i in range(base, v + 1)])
        if base == v:
            return rows.drop("store_version")
        gone = self.spark.read.schema("document_id string, gone_version int").parquet(*[f"{self.path}/v{i}/gone" for i in range(base + 1, v + 1)])
        last = few(gone.groupBy(F.col("document_id").alias("gone_id")).agg(F.max("gone_version").alias("gone_version")), gone.count())
        joined = rows.join(last, F.col("document_id") == F.col("gone_id"), "left")
        return joined.where(F.coalesce("gone_version", F.lit(0)) <= F.col("store_version")).drop("gone_id", "gone_version", "store_version")

    def part(self, version: int) -> DataFrame:
        """The chunks that a version added."""
        return self.spark.read.parquet(f"{self.path}/v{version}/chunks").drop("store_version")

    def _commit(self, v: int, chunks: DataFrame, gone: DataFrame | None, base: int) -> int:
        aside = f"{self.path}/v{v}"
        self._fs.delete(self._at(aside), True)
        self._conformed(chunks).withColumn("store_version", F.lit(v)).write.parquet(f"{aside}/chunks")
        if gone is not None:
            gone.select(F.col("document_id").cast("string").alias("document_id"), F.lit(v).alias("gone_version")).write.parquet(f"{aside}/gone")
        made = self._at(f"{self.path}/{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps({"base": base}).encode()))
        out.close()
        if not self._fs.rename(made, self._at(f"{self.path}/current/{v}")):
            self._fs.delete(made, False)
            raise RuntimeError(f"version {v} was made current by another writer")
        return v

    def write(self, chunks: DataFrame) -> int:
        """Stores ``chunks`` as the whole of the next version and makes it current."""
        v = self.version() + 1
        return self._commit(v, chunks, None, v)

    def upsert(self, chunks: DataFrame, gone: DataFrame | None = None) -> int:
        """Adds chunks, in place of those stored of their documents and of the documents in
        ``gone`` (document_id).  Only what is new is written."""
        v = self.version()
        if v - self._base(v) >= MOST_DELTAS:
            v = self.compact()
        ids = gone if gone is not None else chunks
        return self._commit(v + 1, chunks, ids.select("document_id").where("document_id is not null").distinct(), self._base(v) or v + 1)

    def compact(self) -> int:
        """Writes the current chunks as one version; does nothing if they are."""
        v = self.version()
        return v if self._base(v) == v else self.write(self.read())

    def vacuum(self) -> None:
        """Removes versions from before the current one's base."""
        base = self._base(self.version())
        for v in [x for x in self._pointers() if x < base]:
            self._fs.delete(self._at(f"{self.path}/current/{v}"), False)
            self._fs.delete(self._at(f"{self.path}/v{v}"), True)

    def delete(self, document_ids: list[str]) -> int:
        """Deletes documents; the number of chunks that went, 0 if none is stored."""
        gone = self.read().where(F.col("document_id").isin(*document_ids)).count() if document_ids else 0
        if gone:
            ids = self.spark.createDataFrame([(x,) for x in document_ids], "document_id string")
            self.upsert(self.spark.createDataFrame([], self.schema), ids)
        return gone


def ingest(files: DataFrame, store: Store, to_chunks: Callable[[DataFrame], DataFrame], *, task_id: str, trigger: str = "upload") -> DataFrame:
    """Ingests a batch of files and returns its log rows.

    Rejected files stay rejected; contents that are stored, or that came earlier in the
    batch, are skipped; of one name the last file stays, and replaces what is stored
    under it.  ``to_chunks`` takes the imported files (document_id, file_name, content,
    ..., stamp) and returns chunks with document_id; a file of which it gives a row with
    an ``error`` is failed, and what is stored of it stays.  A file without chunks is
    imported with a count of 0, stores no hash, and leaves the document's old chunks.
    Chunks that carry on the ``stamp`` of their file need no join to get what it has."""
    order, key = _order(files), _key(files)
    size = F.length("content").cast("long") if "length" not in files.columns else F.col("length").cast("long")
    accepted = accept(files).withColumn("stamp", F.struct("file_name", size.alias("file_size"), "content_hash"))
    # written without contents: these are read once for their hashes and once for their chunks
    told = accepted.select(key, "document_id", "content_hash", "status", "error", "file_name", "stamp.file_size")
    marked = mark_known(first_of_each(told), store.read())
    last = F.max(F.when(F.col("status") == "accepted", order)).over(Window.partitionBy("document_id"))
    marked = written(marked.withColumn("status", F.when((F.col("status") == "accepted") & (order < last), "replaced").otherwise(F.col("status"))), "ingest-files")
    made = to_chunks(_taken(accepted, marked, key))
    errors = None
    if "error" in made.columns:
        # written, so that no file is read again for its faults
        made = written(made, "ingest-chunks")
        errors = made.where("error is not null").groupBy(F.col("document_id").alias("failed_id")).agg(F.min("error").alias("file_error"))
        good = made.where("error is null").drop("error").join(errors, F.col("document_id") == F.col("failed_id"), "left_anti")
    else:
        good = made
    good = good.drop("file_name", "file_size", "content_hash", "uploaded_at")
    if "stamp" in good.columns:
        good = good.select("*", "stamp.*").drop("stamp")
    else:
        good = good.join(marked.where("status = 'accepted'").select("document_id", "file_name", "file_size", "content_hash"), "document_id")
    good = good.withColumn("uploaded_at", F.current_timestamp())
    # what is new is written beside what is stored: the batch is compared with one version throughout
    version = store.upsert(good)
    counts = store.part(version).groupBy("document_id", "content_hash").agg(F.count("*").cast("int").alias("chunk_count"))
    out = marked.join(counts, ["document_id", "content_hash"], "left")
    failed, why = F.lit(False), F.col("error")
    if errors is not None:
        out = out.join(errors, F.col("document_id") == F.col("failed_id"), "left")
        failed = (F.col("status") == "accepted") & F.col("failed_id").isNotNull()
        why = F.coalesce("error", F.when(failed, F.col("file_error")))
    status = F.when(failed, "failed").when(F.col("status").isin("accepted", "replaced"), "imported").otherwise(F.col("status"))
    own = F.when(F.col("status") == "accepted", F.coalesce("chunk_count", F.lit(0))).otherwise(F.lit(0))
    number = F.col("file_no").cast("long") if "file_no" in files.columns else F.xxhash64("path")
    now = F.current_timestamp().alias("event_ts")
    rows = out.select(F.lit(task_id).alias("task_id"), F.lit(trigger).alias("trigger"), number.alias("file_no"), "file_name", "document_id", "content_hash", status.alias("status"), own.alias("chunk_count"), why.alias("error"), now)
    log = _logged(store, rows, task_id)
    discard(marked)
    if errors is not None:
        discard(made)
    return log


def _taken(accepted: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """Of the accepted files those that ``marked`` has as accepted still.

    The keys of the files that are taken, or else of those that are not, meet the contents
    by a broadcast if either are few, and by a shuffle otherwise.  Where files have no key
    or one that others have too, they are told apart by name and hash, copies by number."""
    is_taken = F.col("status") == "accepted"
    n, distinct, taken = marked.agg(F.count("*"), F.count_distinct(key), F.count_if(is_taken)).first()
    if n != distinct:
        same = [key, "document_id", "content_hash"]
        chosen = marked.where(is_taken).select(*[F.col(c).alias(f"taken_{c}") for c in same])
        on = [F.col(c).eqNullSafe(F.col(f"taken_{c}")) for c in same]
        copies = F.row_number().over(Window.partitionBy(*same).orderBy(key))
        return accepted.join(chosen, on).drop(*chosen.columns).withColumn("copy_no", copies).where("copy_no = 1").drop("copy_no")
    if n - taken <= min(taken, FEW):
        return accepted.join(few(marked.where(~is_taken).select(key), n - taken), key, "left_anti")
    return accepted.join(few(marked.where(is_taken).select(key), taken), key, "left_semi")


def _logged(store: Store, rows: DataFrame, task_id: str) -> DataFrame:
    """The rows as a table of their own: the log doesn't change when the store does."""
    path = f"{store.path}/log/{task_id}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return store.spark.read.schema(INGEST_LOG).parquet(path)


def ingest_each(files: DataFrame, store: Store, to_chunks: Callable[[DataFrame], DataFrame], *, task_id: str, trigger: str = "upload", attempts: int = 3, delay: float = 3.0) -> DataFrame:
    """``ingest`` of a batch of which some files may break it: a batch that fails is tried
    in halves, down to the files that fail by themselves.  These are tried ``attempts``
    times, and logged as failed.  Files of equal content or name stay in their order, as
    the first half is ingested before the second.  ``files`` must have ``file_no``; the
    numbers of a failing batch pass the driver."""

    def run(part: DataFrame, numbers: list[int] | None) -> list[DataFrame]:
        alone = numbers is not None and len(numbers) == 1
        try:
            once = lambda: ingest(part, store, to_chunks, task_id=task_id, trigger=trigger)
            return [retried(once, attempts, delay) if alone else once()]
        except Exception as fault:
            numbers = numbers or sorted(r.file_no for r in part.select("file_no").collect())
            if len(numbers) == 1:
                why = f"{type(fault).__name__}: {fault}"[:500]
                rows = accept(part).select(F.lit(task_id).alias("task_id"), F.lit(trigger).alias("trigger"), F.col("file_no").cast("long").alias("file_no"), "file_name", "document_id", "content_hash", F.lit("failed").alias("status"), F.lit(0).alias("chunk_count"), F.lit(why).alias("error"), F.current_timestamp().alias("event_ts"))
                return [_logged(store, rows, task_id)]
            half = len(numbers) // 2
            border = F.lit(numbers[half])
            return run(part.where(F.col("file_no") < border), numbers[:half]) + run(part.where(F.col("file_no") >= border), numbers[half:])

    logs = run(files, None)
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def tasks(log: DataFrame, limit: int = RECENT) -> DataFrame:
    """Progress of each task from its log: the latest state of each file, counted; the
    latest tasks first."""
    latest = log.groupBy("task_id", "file_no").agg(F.max_by(F.struct("status", "error", "trigger"), "event_ts").alias("s"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
    done = ~F.col("s.status").isin("pending", "processing")
    out = latest.groupBy("task_id").agg(
        F.first("s.trigger").alias("trigger"), F.count("*").alias("total_files"), F.count_if(done).alias("processed_files"), F.count_if(F.col("s.status") == "failed").alias("failed"),
        F.count_if(F.col("s.status") == "imported").alias("imported"), F.min("first_ts").alias("started_at"), F.max("last_ts").alias("last_event_at"), F.max(F.when(F.col("s.status") == "failed", F.col("s.error"))).alias("error"),
    )
    complete = F.col("processed_files") == F.col("total_files")
    unfinished = F.when(F.col("processed_files") == 0, "queued").otherwise("processing")
    status = F.when(~complete, unfinished).when((F.col("failed") > 0) & (F.col("imported") > 0), "partial_failed").when(F.col("failed") > 0, "failed").otherwise("completed")
    return out.select("task_id", "trigger", "total_files", "processed_files", status.alias("status"), "started_at", F.when(complete, F.col("last_event_at")).alias("finished_at"), "error").orderBy(F.col("started_at").desc(), "task_id").limit(limit)


def retried(run: Callable[[], DataFrame], attempts: int = 3, delay: float = 3.0) -> DataFrame:
    """Runs a batch again after a failure, up to ``attempts`` times in all."""
    for attempt in range(1, attempts + 1):
        try:
            return run()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(delay)
    raise AssertionError
