"""What a session needs around a plan: this package on its workers, a shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that may be dealt to all cores before it is worked on.
SMALL = 256 << 20

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, once per application.

    Python functions are sent to workers by reference, so workers must be able to
    import this package; on a cluster it may be installed on the driver alone."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def spread(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table that is small, and so may stand in fewer row groups than there are cores,
    dealt to all of them.  Larger ones, by Spark's estimate, stay as they are stored."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, for intermediate tables.

    It is the one named by ``spark.checkpoint.dir``; where that is unset, a temporary
    folder in local mode and the warehouse on a cluster.  Sets nothing on the session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return _folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.gettempdir() + f"/quarry-{spark.sparkContext.applicationId}")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
