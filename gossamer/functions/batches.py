"""Arrow batches of bounded size, and workers that give memory back."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import SparkSession

#: A worker holds a batch several times over: as Arrow, as Python strings and as what is made of it.
BATCH_BYTES = 4_000_000
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession | None = None) -> None:
    """Lower the session's bound of a batch to ``BATCH_BYTES``; the bound in rows alone lets long texts fill a worker."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and int(re.sub(r"\D", "", spark.conf.get(_BOUND))) > BATCH_BYTES:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def end_of_task() -> None:
    """Give freed memory back to the system: workers are used again, and an idle one should be small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
