"""From documents to numbered, section-tagged lines, and their neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pairlens.functions import patterns as P
from pairlens.functions import text as X


def doc_order() -> WindowSpec:
    """Lines of a document in order."""
    return Window.partitionBy("doc_id").orderBy("line_no")


def clean_lines(raw: Column, most_lines: int | None = P.MAX_LINES, most_chars: int | None = P.MAX_LINE_CHARS) -> Column:
    """array<struct<text, is_bullet>> of the retained lines of a text, in order; ``None`` lifts a limit."""

    def cleaned(line: Column) -> Column:
        bare = X.removed(F.translate(line, "\u00a0\u00ad", " "), r"[\s\x1c-\x1f]+$")
        return bare if most_chars is None else F.substring(bare, 1, most_chars)

    rows = F.transform(F.transform(F.split(raw, P.LINE_ENDS), cleaned), lambda t: F.struct(X.stripped(t).alias("text"), X.is_bullet(t).alias("is_bullet")))
    kept = F.filter(rows, lambda r: r["text"] != "")
    return kept if most_lines is None else F.slice(kept, 1, most_lines)


def split_lines(docs: DataFrame, **limits: int | None) -> DataFrame:
    """(doc_id, line_no, text, is_bullet) from (doc_id, raw_text); line numbers count retained lines from 1.

    Numbering happens inside each row, so no shuffle is needed.
    """
    at = docs.select("doc_id", F.posexplode(clean_lines(F.col("raw_text"), **limits)).alias("at", "line"))
    return at.select("doc_id", (F.col("at") + 1).alias("line_no"), F.col("line.text").alias("text"), F.col("line.is_bullet").alias("is_bullet"))


def read_lines(docs: DataFrame, **limits: int | None) -> DataFrame:
    """``split_lines`` with column section, that of the last heading up to a line.

    A text is cut at its headings before its lines become rows, so sections need no shuffle either.
    """

    def cut(lines: Column) -> Column:
        marked = F.transform(lines, lambda r, i: F.struct((i + 1).alias("at"), X.section_heading(r["text"], r["is_bullet"]).alias("section")))
        heads = F.concat(F.array(F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("section"))), F.filter(marked, lambda m: m["section"].isNotNull()))

        def stretch(heads: Column) -> Column:
            end = lambda i: F.coalesce(F.get(heads, i + 1)["at"], F.size(lines) + 1)
            return F.transform(heads, lambda h, i: F.struct(h["at"].alias("first"), h["section"].alias("section"), F.slice(lines, h["at"], end(i) - h["at"]).alias("lines")))

        return X.let(heads, stretch)

    parts = docs.select("doc_id", F.explode(X.let(clean_lines(F.col("raw_text"), **limits), cut)).alias("part"))
    rows = parts.select("doc_id", "part.first", "part.section", F.posexplode("part.lines").alias("at", "line"))
    return rows.select("doc_id", (F.col("first") + F.col("at")).alias("line_no"), F.col("line.text").alias("text"), F.col("line.is_bullet").alias("is_bullet"), "section")


def clause_context(lines: DataFrame, reach: int, out: str = "context") -> DataFrame:
    """``lines`` with the text of a line and its non-bullet neighbours of the same section.

    Steps go forward, then back, one further each time; the first that meets a
    bullet, another section or the end stops both.
    """
    going, before, after, order = F.lit(True), [], [], doc_order()
    for k in range(1, reach + 1):
        for shift, held in ((F.lead, after), (F.lag, before)):
            there = shift("line_no", k).over(order).isNotNull() & ~shift("is_bullet", k).over(order) & shift("section", k).over(order).eqNullSafe(F.col("section"))
            going = going & F.coalesce(there, F.lit(False))
            held.append(F.when(going, shift("text", k).over(order)))
    return lines.withColumn(out, F.concat_ws(" ", *reversed(before), "text", *after))


def chunks(lines: DataFrame, size: int = P.CHUNK_LINES, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, first_line, last_line, numbered): stretches of ``size`` lines that share ``overlap``."""
    step = max(1, size - overlap)
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    # chunk k holds lines k * step + 1 to k * step + size, and exists if the one before left lines over
    first = F.greatest(F.lit(0), F.ceil((F.col("line_no") - size) / step)).cast("int")
    last = F.floor((F.col("line_no") - 1) / step).cast("int")
    rows = lines.withColumn("_total", total).withColumn("chunk_no", F.explode(F.sequence(first, F.greatest(first, last))))
    rows = rows.where((F.col("chunk_no") == 0) | ((F.col("chunk_no") - 1) * step + size < F.col("_total")))
    numbered = F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.col("line_no").cast("string"), F.lit(": "), "text").alias("t"))))
    out = rows.groupBy("doc_id", "chunk_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), numbered.alias("_n"))
    return out.select("doc_id", "chunk_no", "first_line", "last_line", F.array_join(F.transform("_n", lambda r: r["t"]), "\n").alias("numbered"))


def evidence() -> Column:
    """Evidence struct of a line: its text up to 400 signs, number and section."""
    return F.struct(F.substring("text", 1, 400).alias("text"), F.col("line_no").alias("line"), F.col("section").alias("section"))


def resolve_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """``quotes`` (doc_id, quote_id, quote, line_hint) with evidence: the first line that holds the quote
    (or its first 60 signs, if it has more than 12), else the line nearest to the hint, else null."""
    needle = F.lower(X.collapsed(F.col("quote")))
    both = quotes.select("doc_id", "quote_id", needle.alias("_needle"), "line_hint").join(lines, "doc_id")
    hay = F.lower("text")
    held = (F.col("_needle") != "") & (hay.contains(F.col("_needle")) | ((F.length("_needle") > 12) & hay.contains(F.substring("_needle", 1, 60))))
    here = F.when(F.coalesce(held, F.lit(False)), F.struct(F.lit(0), F.col("line_no")))
    near = F.when(F.col("line_hint") > 0, F.struct(F.abs(F.col("line_no") - F.col("line_hint")) + 1, F.col("line_no")))
    best = both.withColumn("_rank", F.coalesce(here, near)).groupBy("doc_id", "quote_id").agg(F.min_by(evidence(), "_rank").alias("evidence"))
    return quotes.join(best, ["doc_id", "quote_id"], "left")
