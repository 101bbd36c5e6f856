"""Postings or resumes as a stream of files: each micro-batch is one batch analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlens.dims import DEFAULT, SkillDictionary
from pairlens.functions import patterns as P
from pairlens.operators.match import MatchConfig
from pairlens.plans.analyze import analyze, every_pair
from pairlens.sources.documents import decoded, doc_type

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, raw_text) of text and Markdown files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(folder)
    kept = files.where((F.col("length") <= P.MAX_FILE_BYTES) & doc_type(F.col("path")).isin("text", "markdown"))
    return kept.select(F.col("path").alias("doc_id"), decoded(F.col("content")).alias("raw_text"))


def match_stream(postings: DataFrame, resumes: DataFrame, as_of: tuple[int, int], sink: Callable[[DataFrame, int], None], checkpoint: str, *, dictionary: SkillDictionary = DEFAULT, config: MatchConfig = MatchConfig()) -> StreamingQuery:
    """Match every arriving resume with all ``postings`` (a static table); ``sink`` gets each batch's reports.

    The checkpoint makes every file part of exactly one batch; a sink that
    overwrites by batch number makes the whole exactly-once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sink(analyze(postings, rows, as_of, pairs=every_pair(postings, rows), dictionary=dictionary, config=config).reports, number)

    return resumes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
