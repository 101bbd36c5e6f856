"""A corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns
of documents; the last returns the encoded documents.

Defined results: rows with a null or empty text are clean, nobody's copy, and
encoded as no ids; rows without id are kept or dropped by their text like others,
one of each near-duplicate group; repeated rows are copies; an empty table stays
empty; other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import byte_bpe, decontaminate, near_dup, surrogates, toxicity
from pairlens.llm.common import durable, fresh, remainder, table
from pairlens.llm.queries import BPE, GRAM, SURROGATE_KEY, WINDOW

#: Documents of at least this probability are rejected as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below ``TOXIC``, all columns kept."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    name = fresh(docs.columns, "_toxicity")
    return docs.withColumn(name, toxicity.assess(docs, model)["score"]).where(F.col(name) < TOXIC).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group by five-word shingles at 0.8, all columns kept."""
    return near_dup.keep_one(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark, all columns kept."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=WINDOW, gram=GRAM)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; n_chars, where there is one, follows the new text."""
    out = surrogates.replace(docs, SURROGATE_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed), and whether they decode to the text."""
    both = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"), byte_bpe.encode_and_decode(F.col("text"), *BPE).alias("b"))
    return both.select("doc_id", byte_bpe.id_count(F.col("b.ids")).alias("n_tokens"), F.col("b.ids").alias("ids"), (F.col("b.decoded") == F.col("raw")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("PII surrogates", replace_personal_data),
    ("byte-level BPE", encode),
]

#: Scores and merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else durable(docs, "pipeline"), sf_dir)
    return docs
