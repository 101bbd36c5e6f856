"""Registered queries: each operator over whole test tables, with equivalent DuckDB SQL.

Where an operator works on documents or profiles, its input is built from the
tables: a conversation is a document whose turns are lines, a customer is one
whose orders are skills or spells of employment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens import case_queries
from pairlens.dims import SkillDictionary
from pairlens.functions import patterns as P
from pairlens.functions import text as X
from pairlens.operators import extract, lines, match, model_output, score
from pairlens.plans.analyze import analyze
from pairlens.plans.evaluate import prf
from pairlens.plans.stages import dealt
from pairlens.sources.documents import doc_type

#: Words that occur in the test documents, as a dictionary with aliases, a shared form and a two-word form.
WORDS = SkillDictionary({"License": ["license", "licence", "licensed"], "Public License": ["public license", "general public"], "Rest": ["rest", "the rest"], "This And": ["this and", "with the", "license"], "Von": ["von", "und der"]})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines: assistant turns are bullets, every fifth turn begins a section."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "text", (F.col("role") == "assistant").alias("is_bullet"), F.floor(F.col("turn") / 5).cast("string").alias("section"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(documents(spark, sf_dir)).select("doc_id", "line_no", F.length("text").alias("n_chars"), "is_bullet")


def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws("\n", F.col("c_name"), F.lit("Work Experience:"), F.concat(F.lit("- "), "c_mktsegment"), F.lit(""), F.when(F.col("c_custkey") % 2 == 0, "## Education"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "Key Skills"), F.lit("* skills list"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), raw.alias("raw_text"))
    return lines.read_lines(docs).select("doc_id", "line_no", "text", "section", "is_bullet")


def clause_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clause_context(turns(spark, sf_dir), 2).select("doc_id", "line_no", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def clause_context_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clause_context(turns(spark, sf_dir), 3).select("doc_id", "line_no", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, P.CHUNK_LINES, P.CHUNK_OVERLAP)


def chunk_overlap_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 10, 2)


def _chunks(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    out = lines.chunks(lines.read_lines(documents(spark, sf_dir)), size, overlap)
    return out.select("doc_id", "chunk_no", "first_line", "last_line", F.md5(F.col("numbered").cast("binary")).alias("numbered_md5"))


def mask_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-around is beyond the oracle's regular expressions, so telephone masking has a rows-only check."""
    return documents(spark, sf_dir).select("doc_id", X.mask_contacts(F.col("raw_text")).alias("masked"))


def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(X.removed(F.col("raw_text"), P.EMAIL, "[email]").cast("binary")).alias("masked_md5"))


def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(X.norm_key(F.col("raw_text")).cast("binary")).alias("key_md5"))


def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" and the ", "p_name", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(X.content_tokens(text)), " ").alias("tokens"))


def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.skill_hits(lines.read_lines(documents(spark, sf_dir)), WORDS).select("doc_id", "line_no", "canonical", "canon_ord")


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("place", "word"))
    known = SkillDictionary({"Brass": ["brass", "bras"], "Steel": ["steel", "part"], "Copper": ["copper", "small"], "Tin": ["tin", "tins"]})
    return known.with_canonical(words.withColumn("name", F.concat("word", F.lit("s"))), F.col("name")).select("p_partkey", "place", "name", "canonical")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ["required", "is a plus", "optional", "expert in", "familiar with", "a degree", "certified", "five years of", "12+ years", "MBA", "B.Tech", "diploma", "fluent"]))
    own = F.concat_ws(" ", "p_name", F.element_at(words, (F.col("p_partkey") % 13 + 1).cast("int")), "p_type", F.element_at(words, (F.col("p_size") % 13 + 1).cast("int")))
    held = table(spark, sf_dir, "part").select("p_partkey", own.alias("t"))
    return held.select("p_partkey", X.importance(F.col("t")).alias("importance"), X.proficiency(F.col("t")).alias("proficiency"), X.category(F.col("t"), F.lit("skills")).alias("category"), X.years(F.col("t")).alias("years"), X.degree_level(F.col("t")).alias("degree_level"), X.seniority(F.col("t")).alias("seniority"), X.looks_like_posting(F.col("t")).alias("is_posting"))


def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.element_at(F.array(*map(F.lit, [".pdf", ".DOCX", ".md", ".rtf", "", ".doc", ".xyz"])), (F.col("page_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", doc_type(path).alias("doc_type"))


def _profile_rows(spark: SparkSession, sf_dir: str, place: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    names = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority")))
    levels = F.element_at(F.array(*map(F.lit, ["unknown", "exposed", "working", "expert"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), at.alias(place), names.alias("name"), F.lit("skill").alias("category"), F.when(F.col("o_orderstatus") == "F", "must").otherwise("preferred").alias("importance"), levels.alias("proficiency"),
        F.col("o_orderkey").cast("double").alias("min_years"), F.col("o_orderkey").cast("double").alias("years"), F.lit(None).cast("struct<text:string,line:int,section:string>").alias("evidence"),
    )


def requirement_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.distinct_requirements(_profile_rows(spark, sf_dir, "req_pos")).select("doc_id", "req_pos", "name", "importance", "min_years")


def skill_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.distinct_skills(_profile_rows(spark, sf_dir, "skill_pos")).select("doc_id", "skill_pos", "name", "proficiency", "years")


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = X.month_index(F.year("o_orderdate"), F.month("o_orderdate"))
    ranges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), start.alias("start"), (start + F.col("o_orderkey") % 5).cast("int").alias("finish"))
    return extract.merged_intervals(ranges).select("doc_id", "start", "finish")


def employment_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order months as spells of employment in text, read back and merged."""
    orders = table(spark, sf_dir, "orders")
    key, until = F.col("o_orderkey"), F.add_months("o_orderdate", (F.col("o_orderkey") % 5).cast("int"))
    spelled = lambda day: F.when(key % 3 == 0, F.date_format(day, "MM/yyyy")).when(key % 3 == 1, F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "MMM. yyyy"))
    text = F.concat(spelled("o_orderdate"), F.when(key % 2 == 0, " - ").otherwise(" to "), F.when(key % 11 == 0, "Present").otherwise(spelled(until)), F.lit(": clerk"))
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), text.alias("text"), F.lit(None).cast("string").alias("section"))
    return extract.total_years(rows, (2026, 11))


def order_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as outcomes of their order."""
    importance = F.when(F.col("l_returnflag") == "A", "must").when(F.col("l_returnflag") == "N", "preferred").otherwise("nice_to_have")
    points = F.round(F.col("l_discount") * 10, 4).cast("decimal(10,4)")
    status = F.when(points >= F.lit(P.MET), "met").when(points >= F.lit(P.PARTIAL), "partial").when(F.col("l_linestatus") == "F", "contested").otherwise("missing")
    weight = F.when(importance == "must", 1.0).when(importance == "preferred", 0.45).otherwise(0.15)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jd_id"), F.lit(0).alias("resume_id"), F.col("l_linenumber").alias("req_pos"), "l_partkey", importance.alias("importance"), points.alias("score"), weight.alias("weight"), status.alias("status"))


def order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_outcomes(spark, sf_dir).groupBy("jd_id").agg(score.overall_score().alias("overall_score"), score.must_coverage().alias("coverage"), score.gated().alias("blocked"))
    return out.select("jd_id", "overall_score", "coverage", "blocked", score.verdict(F.col("overall_score"), F.col("coverage"), F.col("blocked"), True).alias("verdict"), score.verdict(F.col("overall_score"), F.col("coverage"), F.col("blocked"), False).alias("ungated"))


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of each order as one array, named by their parts."""
    known = F.when(F.col("req_pos") % 3 == 0, "exposed").when(F.col("req_pos") % 3 == 1, "working")
    place = (F.col("req_pos") * 100_000 + F.col("l_partkey")).cast("long")  # line numbers repeat within an order
    rows = order_outcomes(spark, sf_dir).withColumns({"req_pos": place, "name": F.concat(F.lit("part "), F.col("l_partkey").cast("string")), "matched_proficiency": known})
    return rows.groupBy("jd_id").agg(F.collect_list(F.struct("req_pos", "name", "l_partkey", "importance", "score", "weight", "status", "matched_proficiency")).alias("items"))


def _places(rows: DataFrame, items: Column) -> DataFrame:
    return rows.select("jd_id", F.posexplode(items).alias("place", "o")).select("jd_id", (F.col("place") + 1).alias("place"), "o.req_pos", "o.l_partkey")


def outcome_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(_order_items(spark, sf_dir), score.best_first(F.col("items")))


def topk_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(_order_items(spark, sf_dir), score.strengths(F.col("items")))


def order_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next steps for every order; every third has no dates, every second was read by rules, every fifth is one long clause."""
    rows, key = _order_items(spark, sf_dir), F.col("jd_id")
    count = F.when(key % 5 == 0, 1).when(key % 7 == 0, 0).otherwise(F.size("items"))
    out = score.suggestions(score.in_order(F.col("items")), count, F.when(key % 10 == 0, 90).otherwise(20), F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 4.5), key % 2 == 0)
    return rows.select("jd_id", F.size(out).alias("n"), F.array_join(out, "|").alias("suggestions"))


def years_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("double") / 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(match.years_score((F.col("p_partkey") % 12 + 1).cast("double"), held, 1.0), 6).alias("years_score"))


def union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of one customer's orders as the model's names, market segments as the rules'."""
    rows = _profile_rows(spark, sf_dir, "req_pos").select(*extract.REQUIREMENT)
    first = rows.where("req_pos <= 3")
    second = rows.where("req_pos > 2")
    both = model_output.merge_requirements(first, second, SkillDictionary({"Urgent": ["1 urgent"], "High": ["2 high", "1 urgents"]}))
    return both.select("doc_id", "req_pos", "name")


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Here it is: "), F.when(F.col("event_id") % 10 > 0, F.col("props")).otherwise(F.lit("nothing")), F.lit(" as asked {x"))
    kept = F.get_json_object(X.json_object(raw), "$")
    return table(spark, sf_dir, "events").select("event_id", (X.json_object(raw).isNotNull() & F.col("props").isNotNull() & (F.col("event_id") % 10 > 0)).alias("has_object"), F.length(F.regexp_replace(kept, r"\s", "")).alias("kept_chars"))


def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of every turn, looked up in its conversation."""
    rows = turns(spark, sf_dir)
    quotes = rows.select("doc_id", F.col("line_no").alias("quote_id"), F.substring("text", 5, 40).alias("quote"), (F.col("line_no") + 2).cast("int").alias("line_hint"))
    return lines.resolve_quotes(quotes, rows).select("doc_id", "quote_id", F.col("evidence.line").alias("line_no"))


def prf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    sums = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 10).alias("fold")).agg(F.count_if(q & t).alias("tp"), F.count_if(~q & t).alias("fp"), F.count_if(q & ~t).alias("fn"))
    return sums.select("fold", *(c.alias(n) for c, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"))))


def posting_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements by rules in all documents."""
    out = extract.requirements(lines.read_lines(documents(spark, sf_dir)), WORDS)
    return out.select("doc_id", "req_pos", "name", "category", "importance", "min_years", F.col("evidence.line").alias("line_no"))


def resume_skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills by rules in all documents; each word of the dictionary once a document, at its first line."""
    out, _ = extract.resume_skills(lines.read_lines(documents(spark, sf_dir)), WORDS)
    return out.select("doc_id", "skill_pos", "name", F.col("evidence.line").alias("line_no"))


def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers of matching over all orders: each customer's priorities against those of the other customers of its block of four keys."""
    needs = _profile_rows(spark, sf_dir, "req_pos").select(*extract.REQUIREMENT).withColumn("min_years", F.lit(None).cast("double"))
    skills = _profile_rows(spark, sf_dir, "skill_pos").select(*extract.SKILL)
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    one = customers.select(F.col("c_custkey").alias("jd_id"), F.floor(F.col("c_custkey") / 4).alias("block"))
    other = customers.select(F.col("c_custkey").alias("resume_id"), F.floor(F.col("c_custkey") / 4).alias("block"))
    pairs = one.join(dealt(other), "block").where("jd_id <> resume_id").select("jd_id", "resume_id")
    profiles = customers.select(F.col("c_custkey").alias("doc_id"), F.lit(None).cast("double").alias("total_years"), F.lit(None).cast("string").alias("highest_education"), F.lit(None).cast("struct<text:string,line:int,section:string>").alias("education_evidence"))
    names = SkillDictionary({"1 Urgent": [], "2 High": ["high"], "3 Medium": ["medium"]})
    out = match.match(pairs, extract.distinct_requirements(needs), extract.distinct_skills(skills), profiles, names)
    return out.select("jd_id", "resume_id", "req_pos", "name", "status", "method", F.round("score", 4).alias("score"))


POSTING = "Senior Data Engineer\nRequirements:\n- 5+ years of Python required\n- PostgreSQL and data pipelines mandatory\n- CI/CD experience required\n- Tableau is a plus\n- Bachelor's degree in Statistics required"
RESUMES = [
    ("a", "DANA REED\nEXPERIENCE\nEngineer, Northwind | 01/2019 - Present\n- Six years of Python and postgres\n- Built data pipelines with Jenkins\nEDUCATION\nB.Sc Statistics\nSKILLS\nPython, SQL, Tableau"),
    ("b", "KIM WEST\nEXPERIENCE\nAnalyst, Contoso | 03/2022 to 06/2023\n- One year of Python reporting\nSKILLS\nExcel, Power BI, Python"),
]


def analysis_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis over all documents: each as a posting, met by the other documents of its block of four ids."""
    every = documents(spark, sf_dir)
    side = lambda name: every.select(F.col("doc_id").alias(name), F.floor(F.col("doc_id") / 4).alias("block"))
    pairs = side("jd_id").join(side("resume_id"), "block").where("jd_id <> resume_id").select("jd_id", "resume_id")
    out = analyze(every, every, (2026, 11), pairs=pairs, dictionary=WORDS).reports
    return out.select("jd_id", "resume_id", "overall_score", "verdict", "must_have_coverage", F.transform("blockers", lambda o: o["name"]).alias("blockers"), F.transform("strengths", lambda o: o["name"]).alias("strengths"), "suggestions")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        doc_lines, section_ffill, clause_context, clause_context_3, chunk_overlap, chunk_overlap_10, mask_contacts, mask_email, norm_keys, content_tokens, dictionary_hits, alias_lookup, cues, doc_types, requirement_dedupe, skill_dedupe,
        interval_merge, employment_years, order_verdicts, outcome_order, topk_strengths, order_suggestions, years_scores, union_priority, json_recover, quote_lines, prf_eval, posting_requirements, resume_skill_rows, cascade_match, analysis_reports,
    ]
    return {f.__name__: f for f in every} | case_queries.queries()


# --- the same in DuckDB SQL --------------------------------------------------

_LINES = r"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::INT AS line_no, text, is_bullet FROM (
  SELECT doc_id, p, trim(l, E' \t') AS text, regexp_matches(l, '^\s*(?:[-*•–—●]|\d+[.)])\s+') AS is_bullet FROM (
    SELECT doc_id, p, left(regexp_replace(replace(replace(l, chr(160), ' '), chr(173), ''), '\s+$', ''), 2000) AS l
    FROM (SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents))
  ) WHERE trim(l, E' \t') <> ''
) QUALIFY line_no <= 4000
"""
_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '\s+([#+])', '\1', 'g'), '[^\p{{L}}\p{{N}}_+#.]+', ' ', 'g'), '\s+', ' ', 'g'), ' ([#+])', '\1', 'g'))"""
_CASE = lambda cases, other: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END"
_HAS = lambda column, pattern: f"regexp_matches({column}, '" + pattern.replace("'", "''") + "')"
_RANGES = "SELECT o_custkey AS doc_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 5 AS f FROM orders"
_SPELLS = _RANGES.replace(" AS f FROM", " AS f, o_orderkey FROM")
_SPELLS = f"SELECT doc_id, s, CASE WHEN o_orderkey % 11 = 0 THEN 2026 * 12 + 10 ELSE f END AS f FROM ({_SPELLS})"


def _islands(ranges: str) -> str:
    return f"""
SELECT doc_id, min(s)::INT AS start, max(f)::INT AS finish FROM (
  SELECT *, sum(CASE WHEN s <= m + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, max(f) OVER (PARTITION BY doc_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({ranges}))) GROUP BY doc_id, g
"""


_TURNS = "SELECT conv_id AS doc_id, turn AS line_no, text, role = 'assistant' AS is_bullet, turn // 5 AS section FROM conversations"
_PROFILE = """
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS pos, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE ' ' || lower(o_orderpriority) END AS name,
  CASE WHEN o_orderstatus = 'F' THEN 'must' ELSE 'preferred' END AS importance, ['unknown', 'exposed', 'working', 'expert'][o_orderkey % 4 + 1] AS proficiency, o_orderkey::DOUBLE AS years FROM orders
"""
_OUTCOMES = f"""
SELECT *, CASE importance WHEN 'must' THEN 1.0 WHEN 'preferred' THEN 0.45 ELSE 0.15 END AS weight,
  CASE WHEN score >= {P.MET} THEN 'met' WHEN score >= {P.PARTIAL} THEN 'partial' WHEN l_linestatus = 'F' THEN 'contested' ELSE 'missing' END AS status FROM (
  SELECT l_orderkey AS jd_id, l_linenumber AS req_pos, l_partkey, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'must' WHEN 'N' THEN 'preferred' ELSE 'nice_to_have' END AS importance, round(l_discount * 10, 4)::DECIMAL(10,4) AS score FROM lineitem)
"""
_PLACED = f"SELECT * REPLACE ((req_pos * 100000 + l_partkey)::BIGINT AS req_pos), req_pos AS line FROM ({_OUTCOMES})"


def _context_sql(reach: int) -> str:
    """Some steps each way; step k of a direction counts if all steps before it do."""
    w = "OVER (PARTITION BY doc_id ORDER BY line_no)"
    ok = lambda f, k: f"coalesce({f}(line_no, {k}) {w} IS NOT NULL AND NOT {f}(is_bullet, {k}) {w} AND {f}(section, {k}) {w} IS NOT DISTINCT FROM section, false)"
    steps = [(f, k) for k in range(1, reach + 1) for f in ("lead", "lag")]
    part = {s: f"CASE WHEN {' AND '.join(ok(*x) for x in steps[: i + 1])} THEN {s[0]}(text, {s[1]}) {w} END" for i, s in enumerate(steps)}
    order = [part["lag", k] for k in range(reach, 0, -1)] + ["text"] + [part["lead", k] for k in range(1, reach + 1)]
    return f"SELECT doc_id, line_no, md5(concat_ws(' ', {', '.join(order)})) AS context_md5 FROM ({_TURNS})"


def _chunks_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
WITH l AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_LINES})), c AS (
  SELECT doc_id, n, unnest(range(0, 1 + greatest(0, ceil((n - {size}) / {step}.0))::BIGINT)) AS chunk_no FROM (SELECT DISTINCT doc_id, n FROM l))
SELECT c.doc_id, c.chunk_no::INT AS chunk_no, min(line_no)::INT AS first_line, max(line_no)::INT AS last_line, md5(string_agg(line_no || ': ' || text, chr(10) ORDER BY line_no)) AS numbered_md5
FROM c JOIN l ON l.doc_id = c.doc_id AND l.line_no BETWEEN c.chunk_no * {step} + 1 AND c.chunk_no * {step} + {size} GROUP BY c.doc_id, c.chunk_no
"""


def _cues_sql() -> str:
    importance = _CASE([(_HAS("l", P.IMPORTANCE_HINTS[n]), f"'{n}'") for n in ("nice_to_have", "preferred", "must")], "'preferred'")
    proficiency = _CASE([(_HAS("l", p), f"'{n}'") for n, p in P.PROFICIENCY_CUES], "'working'")
    category = _CASE([(_HAS("l", p), f"'{n}'") for n, p in P.CATEGORY_CUES], "'skill'")
    digits, word = f"regexp_extract(t, '{P.YEARS}', 1)", f"lower(regexp_extract(t, '{P.YEARS_IN_WORDS}', 1))"
    named = _CASE([(f"{word} = '{w}'", f"{k}.0::DOUBLE") for k, w in enumerate(P.WORD_NUMBERS, 1)], "NULL")
    degree = _CASE([(_HAS("t", p), str(k)) for k, p in P.DEGREE_LEVELS], "0")
    senior = _CASE([(" OR ".join(f"contains(l, '{s}')" for s in signs), f"'{n}'") for n, signs in P.SENIORITY], "'unknown'")
    posting = " + ".join(f"contains(l, '{s}')::INT" for s in P.POSTING_SIGNALS)
    words = "['required', 'is a plus', 'optional', 'expert in', 'familiar with', 'a degree', 'certified', 'five years of', '12+ years', 'MBA', 'B.Tech', 'diploma', 'fluent']"
    return f"""
SELECT p_partkey, {importance} AS importance, {proficiency} AS proficiency, {category} AS category, CASE WHEN {digits} <> '' THEN CASE WHEN {digits}::INT <= 50 THEN {digits}::DOUBLE END ELSE {named} END AS years,
  {degree} AS degree_level, {senior} AS seniority, {posting} >= 2 AS is_posting
FROM (SELECT *, lower(t) AS l FROM (SELECT p_partkey, concat_ws(' ', p_name, {words}[p_partkey % 13 + 1], p_type, {words}[p_size % 13 + 1]) AS t FROM part))
"""


def _suggestions_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    say = P.ADVICE
    some = lambda test, text, most: f"coalesce(list({text} ORDER BY req_pos) FILTER ({test}), [])[1:{most}]"
    once = lambda test, text: f"CASE WHEN {test} THEN [{q(text)}] ELSE [] END"
    count = "CASE WHEN jd_id % 5 = 0 THEN 1 WHEN jd_id % 7 = 0 THEN 0 ELSE count(*) END"
    parts = [
        once(f"{count} = 0", say["nothing read"]), once(f"{count} = 1 AND jd_id % 10 = 0", say["one long"][0] + "90" + say["one long"][1]),
        some("importance = 'must' AND status IN ('missing', 'contested')", f"{q(say['blocker'][0])} || name || {q(say['blocker'][1])}", 1000),
        some("importance = 'must' AND status = 'partial'", f"{q(say['partial'][0])} || name || {q(say['partial'][1])} || level || {q(say['partial'][2])}", 3),
        some("importance <> 'must' AND status = 'contested'", f"{q(say['contested'][0])} || name || {q(say['contested'][1])} || printf('%.2f', score::DOUBLE) || {q(say['contested'][2])}", 3),
        once("jd_id % 2 = 0", say["degraded"]), once(f"jd_id % 3 <> 1 AND {count} > 0", say["no dates"]),
        some("importance = 'preferred' AND status = 'missing'", f"{q(say['preferred'][0])} || name || {q(say['preferred'][1])}", 4),
    ]
    every = parts[-1]
    for p in reversed(parts[:-1]):
        every = f"list_concat({p}, {every})"
    rows = f"SELECT *, 'part ' || l_partkey AS name, ['exposed', 'working', 'weak'][line % 3 + 1] AS level FROM ({_PLACED})"
    return f"SELECT jd_id, len(s)::INT AS n, array_to_string(s, '|') AS suggestions FROM (SELECT jd_id, ({every})[1:{P.SUGGESTIONS}] AS s FROM ({rows}) GROUP BY jd_id)"


def _alias_sql() -> str:
    rows = "('brass', 'Brass'), ('bras', 'Brass'), ('steel', 'Steel'), ('part', 'Steel'), ('copper', 'Copper'), ('small', 'Copper'), ('tin', 'Tin'), ('tins', 'Tin')"
    return f"""
WITH a(k, c) AS (VALUES {rows}), w AS (
  SELECT p_partkey, generate_subscripts(x, 1)::INT - 1 AS place, unnest(x) || 's' AS name FROM (SELECT p_partkey, string_split(concat_ws(' ', p_name, p_type), ' ') AS x FROM part)
), n AS (SELECT *, {_KEY.format('name')} AS k FROM w)
SELECT p_partkey, place, name, coalesce(a0.c, a1.c, a2.c, a3.c) AS canonical FROM n
LEFT JOIN a a0 ON a0.k = n.k LEFT JOIN a a1 ON a1.k = CASE WHEN n.k LIKE '%ies' AND length(n.k) > 5 THEN left(n.k, -3) || 'y' END
LEFT JOIN a a2 ON a2.k = CASE WHEN n.k LIKE '%es' AND length(n.k) > 4 THEN left(n.k, -2) END LEFT JOIN a a3 ON a3.k = CASE WHEN n.k LIKE '%s' AND n.k NOT LIKE '%ss' AND length(n.k) > 3 THEN left(n.k, -1) END
"""


def oracle_sql() -> dict[str, str]:
    forms = ", ".join(f"('{c}', '{k}', {o})" for c, k, _, o in WORDS.form_rows())
    stop = ", ".join(f"'{w}'" for w in P.STOPWORDS)
    verdict = lambda gate: _CASE([("blocked", "'weak'")] * gate + [(f"overall_score >= {s}" + f" AND coverage >= {c}" * gate, f"'{n}'") for n, s, c in P.VERDICTS], "'weak'")
    kinds = _CASE([(f"e = '{e}'", f"'{k}'") for e, k in P.DOC_TYPES.items()], "'text'")
    return {
        "doc_lines": f"SELECT doc_id, line_no, length(text)::INT AS n_chars, is_bullet FROM ({_LINES})",
        "section_ffill": r"""
WITH l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::INT AS line_no, l AS text, regexp_matches(l, '^\s*[-*]\s+') AS is_bullet FROM (
    SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS p FROM (SELECT c_custkey AS doc_id, list_filter([c_name, 'Work Experience:', '- ' || c_mktsegment, '', CASE WHEN c_custkey % 2 = 0 THEN '## Education' END, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'Key Skills' END, '* skills list'], lambda x: x <> '') AS a FROM customer))
), h AS (SELECT *, CASE WHEN is_bullet THEN NULL WHEN text = 'Work Experience:' THEN 'experience' WHEN text = '## Education' THEN 'education' WHEN text = 'Key Skills' THEN 'skills' END AS heading FROM l)
SELECT doc_id, line_no, text, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section, is_bullet FROM h
""",
        "clause_context": _context_sql(2),
        "clause_context_3": _context_sql(3),
        "chunk_overlap": _chunks_sql(P.CHUNK_LINES, P.CHUNK_OVERLAP),
        "chunk_overlap_10": _chunks_sql(10, 2),
        "mask_email": r"SELECT doc_id, md5(regexp_replace(text, '[\p{L}\p{M}\p{Nd}_.+-]+@[\p{L}\p{M}\p{Nd}_-]+\.[\p{L}\p{M}\p{Nd}_.]+', '[email]', 'g')) AS masked_md5 FROM documents",
        "norm_keys": f"SELECT doc_id, md5({_KEY.format('text')}) AS key_md5 FROM documents",
        "content_tokens": f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split({_KEY.format(chr(40) + 'concat_ws(' + repr(' and the ') + ', p_name, p_type, p_brand)' + chr(41))}, ' '), lambda w: length(w) > 1 AND w NOT IN ({stop})))), ' ') AS tokens FROM part",
        "dictionary_hits": f"""
WITH f(canonical, k, canon_ord) AS (VALUES {forms}), l AS (SELECT doc_id, line_no, ' ' || {_KEY.format('text')} || ' ' AS t FROM ({_LINES}))
SELECT DISTINCT doc_id, line_no, canonical, canon_ord FROM l JOIN f ON contains(t, ' ' || k || ' ')
""",
        "alias_lookup": _alias_sql(),
        "cues": _cues_sql(),
        "doc_types": f"SELECT page_id, {kinds} AS doc_type FROM (SELECT page_id, lower(regexp_extract(url || ['.pdf', '.DOCX', '.md', '.rtf', '', '.doc', '.xyz'][page_id % 7 + 1], '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)",
        "requirement_dedupe": f"""
WITH p AS ({_PROFILE}), g AS (
  SELECT doc_id, lower(trim(name)) AS k, min(pos) AS req_pos, arg_max(struct_pack(name := name, importance := importance, years := years), struct_pack(m := (importance = 'must')::INT, p := CASE WHEN importance = 'must' THEN pos ELSE -pos END)) AS r FROM p GROUP BY ALL)
SELECT doc_id, req_pos, r.name AS name, r.importance AS importance, r.years AS min_years FROM g
""",
        "skill_dedupe": f"""
WITH p AS ({_PROFILE}), g AS (
  SELECT doc_id, lower(trim(name)) AS k, min(pos) AS skill_pos, arg_max(struct_pack(name := name, proficiency := proficiency, years := years), struct_pack(s := CASE proficiency WHEN 'unknown' THEN 0.0 WHEN 'exposed' THEN 0.7 ELSE 1.0 END, p := -pos)) AS r FROM p GROUP BY ALL)
SELECT doc_id, skill_pos, r.name AS name, r.proficiency AS proficiency, r.years AS years FROM g
""",
        "interval_merge": _islands(_RANGES),
        "employment_years": f"SELECT doc_id, round_even(least(sum(finish - start + 1) / 12.0::DOUBLE, 60.0), 1)::DOUBLE AS total_years FROM ({_islands(_SPELLS)}) GROUP BY doc_id",
        "order_verdicts": f"""
WITH o AS ({_OUTCOMES}), a AS (
  SELECT jd_id, round_even(least(100.0, greatest(0.0, (sum(score::DECIMAL(10,4) * weight::DECIMAL(6,2)) * 100 / nullif(sum(weight::DECIMAL(6,2)), 0))::DOUBLE)), 1)::DOUBLE AS overall_score,
    coalesce(round(least(1.0, sum(CASE WHEN importance = 'must' AND status = 'met' THEN 1.0 WHEN importance = 'must' AND status = 'partial' THEN 0.5 ELSE 0.0 END)::DOUBLE / nullif(count(*) FILTER (importance = 'must'), 0)), 4), 1.0)::DOUBLE AS coverage,
    bool_or(importance = 'must' AND status IN ('missing', 'contested')) AS blocked FROM o GROUP BY jd_id)
SELECT jd_id, overall_score, coverage, blocked, {verdict(1)} AS verdict, {verdict(0)} AS ungated FROM a
""",
        "outcome_order": f"SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY weight DESC, score DESC, req_pos)::INT AS place, req_pos, l_partkey FROM ({_PLACED})",
        "topk_strengths": f"SELECT jd_id, place, req_pos, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY weight DESC, score DESC, req_pos)::INT AS place FROM ({_PLACED}) WHERE status = 'met') WHERE place <= {P.STRENGTHS}",
        "order_suggestions": _suggestions_sql(),
        "years_scores": f"""
SELECT p_partkey, round(CASE WHEN h IS NULL THEN {P.YEARS_UNSTATED} WHEN h / r >= 1 THEN 1.0 ELSE greatest(0.0, 1.0 - least({1 - P.YEARS_FLOOR}, (1.0 - h / r) * {P.YEARS_SLOPE})) END, 6)::DOUBLE AS years_score
FROM (SELECT p_partkey, (p_partkey % 12 + 1)::DOUBLE AS r, CASE WHEN p_size % 7 > 0 THEN p_size::DOUBLE / 5 END AS h FROM part)
""",
        "union_priority": f"""
WITH p AS ({_PROFILE}), b AS (SELECT *, 0 AS src FROM p WHERE pos <= 3 UNION ALL SELECT *, 1 AS src FROM p WHERE pos > 2), a(k, c) AS (VALUES ('urgent', 'Urgent'), ('high', 'High'), ('1 urgent', 'Urgent'), ('2 high', 'High'), ('1 urgents', 'High')),
k AS (SELECT b.*, coalesce(lower(a.c), {_KEY.format('name')}) AS key FROM b LEFT JOIN a ON a.k = {_KEY.format('name')})
SELECT doc_id, (src * 100000000 + pos)::INT AS req_pos, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY src, pos) AS n FROM k) WHERE n = 1
""",
        "json_recover": "SELECT event_id, props IS NOT NULL AND event_id % 10 > 0 AS has_object, CASE WHEN event_id % 10 > 0 THEN length(regexp_replace(props, '\\s', '', 'g'))::INT END AS kept_chars FROM events",
        "quote_lines": f"""
WITH l AS ({_TURNS}), q AS (SELECT doc_id, line_no AS quote_id, lower(trim(regexp_replace(substr(text, 5, 40), '\\s+', ' ', 'g'))) AS quote, line_no + 2 AS hint FROM l),
r AS (SELECT q.doc_id, quote_id, l.line_no, CASE WHEN quote <> '' AND (contains(lower(text), quote) OR (length(quote) > 12 AND contains(lower(text), left(quote, 60)))) THEN 0 ELSE abs(l.line_no - hint) + 1 END AS rank FROM q JOIN l ON l.doc_id = q.doc_id)
SELECT doc_id, quote_id, arg_min(line_no, struct_pack(r := rank, l := line_no)) AS line_no FROM r GROUP BY doc_id, quote_id
""",
        "resume_skill_rows": f"""
WITH f(canonical, k, canon_ord) AS (VALUES {forms}), l AS (SELECT doc_id, line_no, ' ' || {_KEY.format('text')} || ' ' AS t FROM ({_LINES})),
h AS (SELECT doc_id, canonical, min(struct_pack(l := line_no, o := canon_ord)) AS spot FROM l JOIN f ON contains(t, ' ' || k || ' ') GROUP BY doc_id, canonical)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot)::INT AS skill_pos, canonical AS name, spot.l AS line_no FROM h
""",
        "cascade_match": f"""
WITH p AS ({_PROFILE}), k AS (SELECT *, {_KEY.format('name')} AS key, CASE proficiency WHEN 'unknown' THEN 0.0 WHEN 'exposed' THEN 0.7 ELSE 1.0 END AS points FROM p),
n AS (SELECT doc_id, key, min(pos) AS req_pos, arg_max(name, struct_pack(m := (importance = 'must')::INT, p := CASE WHEN importance = 'must' THEN pos ELSE -pos END)) AS name FROM k GROUP BY ALL),
s AS (SELECT doc_id, key, arg_max(points, struct_pack(s := points, p := -pos)) AS points FROM k GROUP BY ALL),
b AS (SELECT x.c_custkey AS jd_id, y.c_custkey AS resume_id FROM customer x JOIN customer y ON x.c_custkey // 4 = y.c_custkey // 4 AND x.c_custkey <> y.c_custkey),
m AS (SELECT b.*, n.req_pos, n.name, s.points, n.key IN ('1 urgent', '2 high', '3 medium') AS known FROM b JOIN n ON n.doc_id = b.jd_id LEFT JOIN s ON s.doc_id = b.resume_id AND s.key = n.key),
o AS (SELECT *, CASE WHEN points IS NULL THEN 0.0 ELSE round(least(1.0, least(1.0, CASE WHEN known THEN 1.0 ELSE {P.SYNONYM_EXACTNESS} END + 0.1) * points), 4) END AS score FROM m)
SELECT jd_id, resume_id, req_pos, name, CASE WHEN points IS NULL THEN 'missing' WHEN score >= {P.MET} THEN 'met' WHEN score >= {P.PARTIAL} THEN 'partial' ELSE 'contested' END AS status,
  CASE WHEN points IS NULL THEN 'none' WHEN known THEN 'taxonomy' ELSE 'synonym' END AS method, score::DOUBLE AS score FROM o
""",
        "prf_eval": """
WITH s AS (SELECT doc_id % 10 AS fold, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn FROM labels GROUP BY 1),
p AS (SELECT fold, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM s)
SELECT fold, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM p
""",
    } | case_queries.oracle_sql()
