"""Where operators of this subpackage keep intermediate tables.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
the driver and all executors share.  Only when that is unset is another place
taken: the warehouse on a cluster, a temporary folder in local mode.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship
from ..storage import discard, new_folder, written

__all__ = ["discard", "new_folder", "table", "trim", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; workers of the session can then import this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives freed memory of this worker back, so that one that waits for a task, or has
    served another stage, is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
