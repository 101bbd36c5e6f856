"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import byte_bpe, decontaminate, licenses, maxent_lm, near_dup, oracles, sharding, surrogates, topk, toxicity, warc
from pairlens.llm.common import durable, remainder, table

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SHARDS = 40
WINDOW, GRAM = 10, 5
#: The key of the surrogates; a deployment passes its own secret to ``surrogates.replace``.
SURROGATE_KEY = "pairlens"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; ids whose crc32 leaves 1 of 3 are held out from learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = remainder(F.col("doc_id"), 3)
    model = toxicity.fit(docs, labels, rest != 1)
    out = docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), toxicity.assess(docs, model).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.score").alias("score"), (F.col("found.score") >= 0.7).cast("int").alias("predicted"), F.size("found.passages").alias("n_passages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, SURROGATE_KEY, count="n_entities")


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; ids whose crc32 leaves 1 of 5 are held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = remainder(F.col("doc_id"), 5)
    model, counts = maxent_lm.fit(docs, F.coalesce(rest != 1, F.lit(True)))
    out = maxent_lm.score(docs, model, counts)
    held_out = F.coalesce(remainder(F.col("id"), 5) == 1, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    docs = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.transform("licenses", lambda m: m["license"])
    best = F.get(F.col("licenses"), 0)
    return docs.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(names), ",").alias("licenses"), best["license"].alias("best_license"), F.round(best["score"], 6).alias("best_score"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a Jaccard similarity of 0.8 or more."""
    out = near_dup.classes(table(spark, sf_dir, "documents"), width=2, percent=80)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, written and read back."""
    archives = durable(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products for every hundredth vector."""
    out = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return out.select("query_id", "rank", "vec_id", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode_and_decode(F.col("text"), *BPE).alias("b"))
    return docs.select("doc_id", byte_bpe.id_count(F.col("b.ids")).alias("n_tokens"), F.sha2("b.ids", 256).alias("ids_sha256"), F.sha2("b.decoded", 256).alias("decoded_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of ten benchmark words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), window=WINDOW, gram=GRAM)
    found = F.col("overlap")
    return out.select(
        "doc_id", found["n_words"].alias("n_words"), decontaminate.hit_words(found).alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"), (F.size(found["spans"]) > 0).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_surrogates": op3_surrogates,
        "op4_maxent_lm": op4_maxent_lm,
        "op5_licenses": op5_licenses,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_warc": op7_warc,
        "op8_topk": op8_topk,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_decontamination": op10_decontamination,
    }


oracle_sql = oracles.oracle_sql
