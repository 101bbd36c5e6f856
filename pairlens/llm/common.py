"""Shared plumbing of the corpus operators: column names, worker caches, durable tables."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so that executors do not import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


def worker_cache(key: str, make: Callable[[], Any]) -> Any:
    """A value made once in each Python worker process and kept between its tasks."""
    holder = sys.modules.setdefault("_pairlens_worker", types.ModuleType("_pairlens_worker"))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on, idle, when its task ends."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name like ``base`` that clashes with none of ``columns`` (case-insensitively)."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text; a null counts as empty."""
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


#: Bytes of a batch that goes to a Python worker, so that very long texts do not pile up there.
BATCH_BYTES = "2m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, unless the session says how."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, str(2**31 - 1)) == str(2**31 - 1):
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset (tests, a single machine) a folder below the
    warehouse is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pairlens"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks that were running; nothing upstream is
    computed again, so row identities made upstream stay what they were.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/pairlens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the table of a ``durable`` frame that nothing unwritten depends on any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.durable_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``totals`` has for a long ``key`` by which it was aggregated, inner.

    The key is turned (bitwise not), so that the totals get an exchange of their own
    behind their aggregation: adaptive execution splits a hot key of a join only if
    both sides are plain exchanges.
    """
    name = fresh([*rows.columns, *totals.columns], "_turned")
    turned = totals.withColumn(name, F.bitwise_not(F.col(key))).drop(key)
    return rows.withColumn(name, F.bitwise_not(F.col(key))).join(turned, name).drop(name)
