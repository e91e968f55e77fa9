"""Written intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: such a table survives a lost executor,
and the task attempt that wrote a part is the only one whose rows are seen. The session's setting is used as
it is; only a session without one (tests, local mode) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Paths given out and not dropped since, in order.
_made: list[str] = []
#: Seconds between two collections of plans that nothing refers to, whose shuffle files Spark then deletes.
COLLECT_EVERY = 5.0
_collected = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a slash at its end."""
    sc = spark.sparkContext
    if set_by_cluster := sc.getConf().get("spark.checkpoint.dir"):
        return set_by_cluster.rstrip("/")
    app = sc.applicationId
    if app not in _local:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            _local[app] = tempfile.mkdtemp(prefix="loomgraph-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        else:  # the warehouse is the other folder that a cluster's machines share
            _local[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _local[app]


def place(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table or file set of this application."""
    path = f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a reader of what was written."""
    return table(df, label)[0]


def table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``save``; also returns the path, for ``drop``."""
    global _collected
    spark = df.sparkSession
    path = place(spark, label)
    if time.monotonic() - _collected > COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table that no returned DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """Write what ``make`` returns, as ``table`` does, and delete all intermediate tables that it wrote on the way."""
    before = set(_made)
    result, path = table(make(), label)
    for own in [p for p in _made if p not in before and p != path]:
        drop(spark, own)
    return result, path


def drop_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when all results are written."""
    drop(spark, f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}")
    _made.clear()
