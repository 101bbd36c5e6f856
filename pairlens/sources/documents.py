"""Sources: text, Markdown, PDF and DOCX files, literal texts, labelled cases, request bodies."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions import patterns as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not import this package

CASES = "id string, note string, jd_text string, resume_text string, expected_verdict string, expected_matched array<string>, expected_missing array<string>"
REQUEST = "jd string, resume string, top int"
MOST_REQUEST_BYTES = 4 * 1024 * 1024


def doc_type(path: Column) -> Column:
    """The type that a path's ending tells; text by default."""
    ending, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("text")
    for name, kind in P.DOC_TYPES.items():
        out = F.when(ending == name, kind).otherwise(out)
    return out


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if they are valid, without a byte-order mark, else Latin-1."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^\ufeff", "")


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX body that are not blank, then its tables, a line a row with cells joined by bars."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{space}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
    parts = [words(p) for p in body.findall(f"{space}p")]
    for row in (r for t in body.findall(f"{space}tbl") for r in t.iter(f"{space}tr")):
        parts.append(" | ".join(filter(None, (words(c).strip() for c in row.findall(f"{space}tc")))))
    return "\n".join(p for p in parts if p.strip())


def pdf_text(data: bytes) -> str:
    """Texts of a PDF's pages; needs pypdf."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def office_text(content: Column, kind: Column) -> Column:
    """A struct (text, error) for PDF and DOCX bytes, by an Arrow-batched function."""
    readers = {"docx": docx_text, "pdf": pdf_text}

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, kinds in batches:
            rows = []
            for data, name in zip(contents, kinds):
                try:
                    rows.append((readers[name](data), None))
                except Exception as e:  # a broken or unreadable file is a rejected row, not a failed job
                    rows.append((None, f"could not parse {name}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return run(content, kind)


def read_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, path, doc_type, raw_text) of readable files, and (path, error) of rejected ones.

    Only PDF and DOCX bytes visit Python. Files above the size limit are dropped by length, before their content is read.
    """
    files = spark.read.format("binaryFile").load(paths).withColumn("doc_type", doc_type(F.col("path")))
    large = files.where(F.col("length") > P.MAX_FILE_BYTES).select("path", F.lit("the file is too large").alias("error"))
    small = files.where(F.col("length") <= P.MAX_FILE_BYTES)
    plain = small.where(F.col("doc_type").isin("text", "markdown")).select("path", "doc_type", decoded(F.col("content")).alias("raw_text"), F.lit(None).cast("string").alias("error"))
    office = small.where(F.col("doc_type").isin("pdf", "docx")).select("path", "doc_type", office_text(F.col("content"), F.col("doc_type")).alias("o")).select("path", "doc_type", F.col("o.text").alias("raw_text"), F.col("o.error").alias("error"))
    every = plain.unionByName(office).withColumn("error", F.when(F.col("error").isNull() & (F.coalesce(F.trim(F.regexp_replace("raw_text", r"\s+", " ")), F.lit("")) == ""), "the document is empty").otherwise(F.col("error")))
    return every.where("error is null").select(F.col("path").alias("doc_id"), "path", "doc_type", "raw_text"), every.where("error is not null").select("path", "error").unionByName(large)


def read_texts(texts: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Literal texts as documents; blank ones are rejected. A text is never taken for a path."""
    held = texts.select(F.col(id_column).alias("doc_id"), F.lit(None).cast("string").alias("path"), F.lit("text").alias("doc_type"), F.col(text_column).alias("raw_text"))
    blank = F.coalesce(F.trim(F.regexp_replace("raw_text", r"\s+", " ")), F.lit("")) == ""
    return held.where(~blank), held.where(blank).select("doc_id", F.lit("the document is empty").alias("error"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from a JSON file: a list, or an object with the list in ``cases``."""
    item = T.ArrayType(T.StructType.fromDDL(CASES))
    raw = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", item)).otherwise(F.from_json("value", T.StructType([T.StructField("cases", item)]))["cases"])
    out = raw.select(F.explode(listed).alias("c")).select("c.*")
    empty = F.array().cast("array<string>")
    return out.withColumns({"note": F.coalesce("note", F.lit("")), "expected_matched": F.coalesce("expected_matched", empty), "expected_missing": F.coalesce("expected_missing", empty)})


def read_requests(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(request_id, jd, resume, top) of JSON bodies (request_id, body), and the rejected ones with the reason; top lies within 1 and 200."""
    held = bodies.withColumn("_j", F.from_json(body, REQUEST))
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""
    reason = F.when(F.octet_length(body) > MOST_REQUEST_BYTES, "the body is too large").when(F.col("_j").isNull(), "the body is no JSON object").when(blank("_j.jd") | blank("_j.resume"), "jd and resume must not be blank")
    held = held.withColumn("error", reason)
    fine = held.where("error is null").select("request_id", "_j.jd", "_j.resume", F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce("_j.top", F.lit(40)))).alias("top"))
    return fine, held.where("error is not null").select("request_id", "error")
