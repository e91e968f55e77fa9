"""Which operator's caches a Python worker holds.

Spark reuses workers, so what one operator remembers (pieces of words, hashes, decoded vocabularies) would stay while
another runs. An operator claims the worker before it fills a cache; the caches of all others are emptied.
Allocators keep what was freed, batch by batch more of it; ``trim`` gives it back to the system.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch where the session has Spark's own setting; a batch of texts is held on both sides of the pipe.
BATCH_ROWS = 2000
_clear: dict[str, Callable[[], None]] = {}
_owner = ""
#: Seconds between two returns of freed memory; one takes some milliseconds.
TRIM_EVERY = 0.5
_trimmed = 0.0
try:
    _libc_trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library, which has no such call
    _libc_trim = None


def cache(owner: str, clear: Callable[[], None]) -> None:
    """Registers how to empty an owner's caches."""
    _clear[owner] = clear


def claim(owner: str) -> None:
    global _owner
    if owner != _owner:
        _owner = owner
        for other, clear in _clear.items():
            if other != owner:
                clear()
        gc.collect()
        trim(at_once=True)


def trim(at_once: bool = False) -> None:
    """Returns freed memory to the system; for loops over batches, where most calls do nothing."""
    global _trimmed
    if at_once or time.monotonic() - _trimmed > TRIM_EVERY:
        pa.default_memory_pool().release_unused()
        if _libc_trim:
            _libc_trim(0)
        _trimmed = time.monotonic()


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's default size of Arrow batches; another size that the session has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
