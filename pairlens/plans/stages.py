"""Written intermediate tables: plans stay small, and a lost executor costs only the tasks it ran."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: both sides are shuffled and sorted, none is broadcast.

    Spark guesses sizes from compressed files or shuffles; what it takes for small can fill the driver.
    """
    return df.hint("merge")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below spark.checkpoint.dir, which all executors share, and read it back.

    Only where that is unset (tests, a single machine) the warehouse stands in.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pairlens"
    path = f"{base.rstrip('/')}/stages/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
