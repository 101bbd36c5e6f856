"""Queries over inputs composed of known lines: their SQL states what each operator must find in them, without its rules.

Every row of a table is a document, a pair or a request; which lines it has follows from its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.dims import SkillDictionary
from pairlens.functions import patterns as P
from pairlens.functions import text as X
from pairlens.operators import extract, lines, match, model_output
from pairlens.plans.analyze import analyze
from pairlens.plans.evaluate import evaluate, summarize
from pairlens.plans.stages import dealt
from pairlens.sources.documents import read_requests, read_texts

AS_OF = (2026, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_key() -> Column:
    return F.col("c_custkey")


def pick(values: list, key: Column) -> Column:
    """The value whose place is the key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def quoted(value: object) -> str:
    """A SQL literal."""
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def listed(rows: list[tuple]) -> str:
    """Rows of a VALUES table, each with its place."""
    return ", ".join(f"({k}, {', '.join(map(quoted, r))})" for k, r in enumerate(rows))


# --- lines ---------------------------------------------------------------------

#: A line; whether it is a heading, prose, asks for a degree, is labelled, has a verb of action; its requirement.
LINES = [
    ("Requirements:", True, False, False, True, False, "Requirements"),
    ("- Build and maintain billing services in Java", False, False, False, False, True, "Build and maintain billing services in Java"),
    ("We are proud of our teams because they build what people need.", False, True, False, False, True, "We are proud of our teams because they build what people need"),
    ("- Bachelor degree in Statistics required", False, False, True, False, False, "Bachelor degree in Statistics"),
    ("**Tools:** Git, Jenkins and Docker", False, False, False, True, False, "Tools:  Git, Jenkins and Docker"),
    ("EXPERIENCE", True, False, False, False, False, None),
    ("## Education", True, False, False, False, False, "## Education"),
    ("Preferred: hands-on work; it is a plus. You own it. Mostly.", False, True, False, True, True, "Preferred: hands-on work"),
    ("- Strong SQL must have", False, False, False, False, True, "Strong SQL"),
    ("Short one", False, False, False, False, False, None),
]
LINE_FACTS = ["heading", "prose", "degree", "labelled", "verb", "phrase"]


def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    rows = table(spark, sf_dir, "part").select("p_partkey", pick([r[0] for r in LINES], F.col("p_partkey")).alias("line"))
    found = X.is_heading(line), X.is_prose(line), X.asks_for_degree(line), X.is_labelled(line), X.has_action_verb(X.without_bullet(line)), X.requirement_phrase(X.clean_markdown(line))
    return rows.select("p_partkey", *(c.alias(n) for c, n in zip(found, LINE_FACTS)))


#: A name, what it reduces to, its parts.
NAMES = [
    ("K8s administration", "Kubernetes", "K8s administration"), ("Advanced SQL", "SQL", "Advanced SQL"), ("4+ years building dashboards in Power BI", "Power BI", "4+ years building dashboards in Power BI"),
    ("CI/CD pipelines", "CI/CD", "CI/CD pipelines"), ("Beekeeping", "Beekeeping", "Beekeeping"), ("SQL and CI/CD", "SQL", "SQL|CI/CD"), ("apples, pears or plums / figs", "apples, pears or plums / figs", "apples|pears|plums|figs"),
]


def name_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = SkillDictionary({"Kubernetes": ["k8s"], "SQL": [], "Power BI": [], "CI/CD": []})
    rows = table(spark, sf_dir, "part").select("p_partkey", pick([n for n, _, _ in NAMES], F.col("p_partkey")).alias("name"))
    return model_output.canonical_names(rows, ["p_partkey"], known).select("p_partkey", "reduced", F.array_join(X.compound_parts(F.col("name")), "|").alias("parts"))


def contact_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telephone numbers, addresses and links in a sentence."""
    text = F.concat(F.lit("Call +1 555 010 "), F.lpad((own_key() % 10000).cast("string"), 4, "0"), F.lit(" or write to c."), own_key().cast("string"), F.lit("@mail.example.org, see https://x.org/"), own_key().cast("string"), F.lit(" or github.com/c; room 12, 2024"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.mask_contacts(text).alias("masked"))


# --- sources --------------------------------------------------------------------


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad requests."""
    body = F.element_at(
        F.array(
            F.concat(F.lit('{"jd": "a", "resume": "b", "top": '), own_key().cast("string"), F.lit("}")), F.lit('{"resume": "b", "jd": "a"}'), F.lit('{"jd": "  ", "resume": "b"}'),
            F.lit('{"jd": "a"}'), F.lit('{"jd": "a", "resume": "b", "top": 900, "more": [1]}'), F.lit('{"jd": "a", "resume": "b", "top": -3}'),
        ), (own_key() % 6 + 1).cast("int"),
    )
    good, bad = read_requests(table(spark, sf_dir, "customer").select(own_key().alias("request_id"), body.alias("body")))
    return good.select("request_id", "jd", "top", F.lit(None).cast("string").alias("error")).unionByName(bad.select("request_id", F.lit(None).cast("string").alias("jd"), F.lit(None).cast("int").alias("top"), "error"))


def literal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as literal texts; blank ones are rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("text")).when(F.col("doc_id") % 2 == 0, F.lit(" \n\t ")).alias("t"))
    good, bad = read_texts(docs, "doc_id", "t")
    return good.select("doc_id", F.length("raw_text").alias("n_chars"), F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", F.lit(None).cast("int").alias("n_chars"), "error"))


# --- postings and resumes ------------------------------------------------------------

POSTING_SKILLS = SkillDictionary({"SQL": [], "Python": ["py"], "Tableau": []})


def posting_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named skills, degrees and clauses of postings: prose names nothing, a line that names a skill is no clause, the first of a name counts."""
    has = lambda test, line: F.when(test, line)
    text = F.concat_ws(
        "\n", F.lit("Data Engineer"), F.lit("Requirements:"), has(own_key() % 7 == 0, F.lit("We use SQL and Tableau every day because they help")),
        has(own_key() % 2 == 0, F.concat(F.lit("- "), (own_key() % 9 + 1).cast("string"), F.lit("+ years of SQL preferred"))), has(own_key() % 3 == 0, F.lit("- Bachelor degree in Statistics required")),
        has(own_key() % 3 == 1, F.concat(F.lit("- Build reliable billing systems for "), F.lower("c_mktsegment"))), has(own_key() % 5 < 3, F.lit("- Py is a plus")), has(own_key() % 4 < 2, F.lit("- SQL must be known")),
    )
    docs = table(spark, sf_dir, "customer").select(own_key().alias("doc_id"), text.alias("raw_text"))
    out = extract.requirements(lines.read_lines(docs), POSTING_SKILLS)
    return out.select("doc_id", "req_pos", "name", "category", "importance", "min_years", F.col("evidence.line").alias("line_no"))


def resume_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, seniority, employment, education and certificates of resumes."""
    text = F.concat_ws(
        "\n", pick(["Position: Data Analyst", "ann@mail.org", "Junior Clerk"], own_key()), F.when(own_key() % 3 == 1, F.lit("Senior Analyst")), F.lit("EXPERIENCE"),
        F.concat(F.lit("Clerk | 01/2019 - "), F.lpad((own_key() % 12 + 1).cast("string"), 2, "0"), F.lit("/2019")), F.when(own_key() % 2 == 1, F.lit("Analyst | Mar 2020 - Present")),
        F.lit("EDUCATION"), F.when(own_key() % 4 < 3, F.lit("B.Sc in Physics")), F.lit("CERTIFICATIONS"), F.when(own_key() % 5 < 4, F.lit("Issued: Cloud Architect, Scrum Master")), F.lit("SKILLS"), F.lit("SQL, Python"),
    )
    docs = table(spark, sf_dir, "customer").select(own_key().alias("doc_id"), text.alias("raw_text"))
    rows = lines.read_lines(docs)
    _, certificates = extract.resume_skills(rows, POSTING_SKILLS)
    out = extract.resume_profiles(docs, rows, certificates, AS_OF).join(extract.titles(rows), "doc_id")
    return out.select("doc_id", "title", "seniority", "total_years", "highest_education", F.col("education_evidence.line").alias("education_line"), F.array_join("certifications", ",").alias("certifications"))


# --- what a model says ------------------------------------------------------------------

SAID = {
    "requirements": '{"title": "Lead", "requirements": [{"name": "K8s administration", "importance": "must", "min_years": 2, "evidence": {"text": "k8s administration", "line": 9}}, '
    '{"name": "Advanced SQL", "importance": "must", "min_years": 4, "evidence": {"line": 3}}, {"name": "k8s"}, {"name": " "}]}',
    "skills": '{"skills": [{"name": "Py", "proficiency": "expert", "years": 3, "evidence": {"text": "no such line", "line": 2}}, {"name": "Weaving"}]}',
}


def _said(what: str) -> Callable[[DataFrame], DataFrame]:
    """A stand-in for a model: every fourth document gets an answer that never ends."""
    return lambda chunks: chunks.select("doc_id", "chunk_no", F.when(F.col("doc_id") % 4 == 3, F.lit('{"a": ')).otherwise(F.lit("Sure: " + SAID[what] + " done }")).alias("raw"))


def model_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's requirements and skills, repaired and merged with the rules."""
    known = SkillDictionary({"Kubernetes": ["k8s"], "SQL": [], "Python": ["py"]})
    docs = lambda text: table(spark, sf_dir, "customer").select(own_key().alias("doc_id"), F.lit(text).alias("raw_text"))
    postings, resumes = lines.read_lines(docs("Lead Engineer\n- K8s administration required\n- Advanced SQL, eight plus years\n- Python is a plus")), lines.read_lines(docs("SKILLS\nPython, SQL"))
    found, facts = model_output.model_requirements(postings, _said("requirements"), known)
    needs = model_output.merge_requirements(found, extract.requirements(postings, known), known).withColumn("side", F.lit("posting")).join(facts, "doc_id", "left")
    rules, _ = extract.resume_skills(resumes, known)
    skills, facts = model_output.model_skills(resumes, _said("skills"), rules, known)
    skills = skills.withColumn("side", F.lit("resume")).join(facts, "doc_id", "left")
    columns = lambda df, place, years: df.select("doc_id", "side", F.col(place).alias("place"), "name", F.col(years).alias("years"), F.col("evidence.line").alias("line_no"), F.coalesce("degraded", F.lit(True)).alias("degraded"))
    return columns(needs, "req_pos", "min_years").unionByName(columns(skills, "skill_pos", "years"))


# --- matching ----------------------------------------------------------------------------

TIER_SKILLS = SkillDictionary({"SQL": ["structured query language"], "Jenkins": [], "CI/CD": ["continuous integration"], "End To End Test Automation": ["end to end test automation suites"], "Tableau": []})
TIER_NEEDS = ["SQL", "Beekeeping", "Bachelor degree in Physics", "reports with structured query language", "juggling and end to end test automation", "CI/CD", "Tableau", "Weaving of baskets"]
DEGREES = ["B.Sc Physics", "M.Sc Chemistry", "PhD History", None]
EVIDENCE = "struct<text:string,line:int,section:string>"


def near(text: Column) -> Column:
    """A stand-in encoder: weaving and looms are near."""
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return F.when(F.lower(text).contains("weav"), pair(1.0, 0.0)).when(F.lower(text).contains("loom"), pair(0.8, 0.6)).otherwise(pair(0.0, 0.0))


def match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement for every tier of matching, each customer against its own resume and the next one's."""
    keys = table(spark, sf_dir, "customer").select(own_key().alias("doc_id"))
    own, none = F.col("doc_id"), F.lit(None).cast(EVIDENCE)
    quote = lambda text: F.struct(text.alias("text"), F.lit(1).alias("line"), F.lit("skills").alias("section"))
    need = lambda k, name: F.struct(F.lit(k).alias("req_pos"), F.lit(name).alias("name"), F.lit("education" if k == 3 else "skill").alias("category"), F.when(own % 2 == 0, "must").otherwise("preferred").alias("importance"), (F.when(F.lit(k == 1), own % 6)).cast("double").alias("min_years"), none.alias("evidence"))
    needs = keys.select("doc_id", F.inline(F.array(*(need(k, n) for k, n in enumerate(TIER_NEEDS, 1)))))
    skill = lambda k, name, level, years, text: F.struct(F.lit(k).alias("skill_pos"), F.lit(name).alias("name"), F.lit("skill").alias("category"), level.alias("proficiency"), years.alias("years"), text.alias("evidence"))
    level, unsaid = lambda name: F.lit(name), F.lit(None).cast("double")
    skills = keys.select("doc_id", F.inline(F.array(
        skill(1, "SQL", pick(["exposed", "working", "expert"], own), (own % 5).cast("double"), quote(F.concat(F.lit("Wrote SQL"), F.when(own % 3 == 0, " and Tableau").otherwise("")))),
        skill(2, "beekeeping", level("working"), unsaid, F.when(own % 2 == 0, quote(F.lit("Kept hives")))), skill(3, "End to End Test Automation", level("proficient"), unsaid, none),
        skill(4, "Jenkins", level("working"), unsaid, none), skill(5, "Loom work", level("expert"), unsaid, none),
    )))
    profiles = keys.select("doc_id", (own % 7).cast("double").alias("total_years"), pick(DEGREES, own).alias("highest_education"), none.alias("education_evidence"))
    pairs = keys.select(own.alias("jd_id"), F.explode(F.array(own, own + 1)).alias("resume_id")).join(dealt(keys.select(own.alias("resume_id"))), "resume_id", "left_semi").select("jd_id", "resume_id")
    out = match.match(pairs, needs, skills, profiles, TIER_SKILLS, match.MatchConfig(encode=near))
    return out.select("jd_id", "resume_id", "req_pos", "status", "method", F.round("score", 4).alias("score"), "matched_as", F.round("similarity", 4).alias("similarity"))


def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of neighbouring vectors."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("embedding") > 0)
    rows = table(spark, sf_dir, "embeddings").where(fine).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    units = rows.withColumn("l", length).where("l > 0").select("vec_id", F.transform("v", lambda x: x / F.col("l")).alias("u"))
    both = units.join(units.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w")), "vec_id").where(F.size("u") == F.size("w"))
    return both.select("vec_id", F.round(X.cosine(F.col("u"), F.col("w")), 6).alias("cosine"))


# --- whole cases ------------------------------------------------------------------------------

CASE_SKILLS = SkillDictionary({"SQL": [], "Python": [], "Tableau": [], "Kubernetes": ["k8s"]})
#: A posting, a resume, the verdict and the names (matched, missing) that a person expects.
CASES = [
    ("Analyst\nRequirements:\n- SQL required\n- Tableau required", "SKILLS\nSQL", "weak", ["SQL"], ["Tableau"]),
    ("Engineer\nRequirements:\n- Python required\n- SQL is a plus", "SKILLS\nPython, SQL", "strong", ["Python", "SQL"], []),
    ("Engineer\nRequirements:\n- Python required\n- SQL is a plus", "SKILLS\nPython", "strong", ["Python", "SQL"], []),
    ("Clerk\nRequirements:\n- Kubernetes required", "SKILLS\nK8s, SQL", "strong", [], ["Tableau"]),
]
#: For each: verdict, score, coverage, labels found, labels missed, gaps found, gaps missed, names too many, labels missed and names too many by name.
RESULTS = [
    ("weak", 50.0, 0.5, 1, 0, 1, 0, 0, "", ""), ("strong", 100.0, 1.0, 2, 0, 0, 0, 0, "", ""), ("plausible", 69.0, 1.0, 1, 1, 0, 0, 0, "SQL", ""), ("strong", 100.0, 1.0, 0, 0, 0, 1, 1, "", "Kubernetes"),
]
RESULT_COLUMNS = ["predicted_verdict", "overall_score", "must_have_coverage", "tp", "fn", "gap_tp", "gap_fn", "fp", "unmatched", "unexpected"]
_DEGRADED, _NO_DATES = P.ADVICE["degraded"], P.ADVICE["no dates"]
#: For each: blockers, strengths, title, suggestions.
REPORTS = [
    ("Tableau", "SQL", "Analyst", "Blocker: 'Tableau' is required but not evidenced. Add a concrete line showing it, or drop it from the resume if you have no example.|" + _DEGRADED + "|" + _NO_DATES),
    ("", "Python,SQL", "Engineer", _DEGRADED + "|" + _NO_DATES), ("", "Python", "Engineer", _DEGRADED + "|" + _NO_DATES + "|Preferred gap: 'SQL'. Worth one mention if you have any exposure."), ("", "Kubernetes", "Clerk", _DEGRADED + "|" + _NO_DATES),
]


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda k: F.element_at(F.array(*(F.array(*map(F.lit, c[k])).cast("array<string>") for c in CASES)), (own_key() % len(CASES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        own_key().cast("string").alias("id"), F.lit("").alias("note"), pick([c[0] for c in CASES], own_key()).alias("jd_text"), pick([c[1] for c in CASES], own_key()).alias("resume_text"), pick([c[2] for c in CASES], own_key()).alias("expected_verdict"),
        names(3).alias("expected_matched"), names(4).alias("expected_missing"),
    )


def case_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of every customer's case, held against what is expected."""
    out = evaluate(_cases(spark, sf_dir), AS_OF, dictionary=CASE_SKILLS)
    return out.withColumn("unmatched", F.array_join("unmatched_expected", ",")).withColumn("unexpected", F.array_join("unexpected_matched", ",")).select("id", "expected_verdict", *RESULT_COLUMNS, "bad_evidence")


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about all cases."""
    return summarize(evaluate(_cases(spark, sf_dir), AS_OF, dictionary=CASE_SKILLS))


def case_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockers, strengths and next steps of every customer's case."""
    cases = _cases(spark, sf_dir)
    side = lambda text: cases.select(F.col("id").alias("doc_id"), F.col(text).alias("raw_text"))
    out = analyze(side("jd_text"), side("resume_text"), AS_OF, pairs=cases.select(F.col("id").alias("jd_id"), F.col("id").alias("resume_id")), dictionary=CASE_SKILLS).reports
    names = lambda c: F.array_join(F.transform(c, lambda o: o["name"]), ",")
    return out.select("jd_id", "title", "verdict", names("blockers").alias("blockers"), names("strengths").alias("strengths"), F.array_join("suggestions", "|").alias("suggestions"), "degraded", "resume_extractor")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [line_predicates, name_reduction, contact_masks, request_bodies, literal_texts, posting_passes, resume_facts, model_profiles, match_tiers, vector_cosine, case_evaluation, case_summary, case_reports]
    return {f.__name__: f for f in every}


# --- the same in DuckDB SQL -------------------------------------------------------------------


def _tiers_sql() -> str:
    return f"""
WITH b AS (
  SELECT x.c_custkey AS k, y.c_custkey AS r FROM customer x JOIN customer y ON y.c_custkey IN (x.c_custkey, x.c_custkey + 1)
), f AS (
  SELECT *, k % 2 = 0 AS must, CASE r % 3 WHEN 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS sql_level, nullif(k % 6, 0)::DOUBLE AS wanted, coalesce(nullif(r % 5, 0), CASE WHEN k % 6 > 0 THEN nullif(r % 7, 0) END)::DOUBLE AS held, r % 4 < 3 AS degree FROM b
), y AS (
  SELECT *, CASE WHEN wanted IS NULL THEN 1.0 WHEN held IS NULL THEN {P.YEARS_UNSTATED} WHEN held >= wanted THEN 1.0 ELSE 1.0 - least({1 - P.YEARS_FLOOR}, (1.0 - held / wanted) * {P.YEARS_SLOPE}) END::DOUBLE AS years FROM f
), s AS (SELECT *, round(sql_level * years, 4) AS one FROM y
), o AS (
  SELECT k, r, 1 AS n, CASE WHEN one >= {P.MET} THEN 'met' WHEN one >= {P.PARTIAL} OR NOT must THEN 'partial' ELSE 'contested' END AS status, 'taxonomy' AS method, CASE WHEN one < {P.PARTIAL} AND NOT must THEN {P.CORROBORATED} ELSE one END AS score, 'SQL' AS matched_as, NULL::DOUBLE AS similarity FROM s
  UNION ALL SELECT k, r, 2, 'met', 'synonym', CASE WHEN r % 2 = 0 THEN {P.SYNONYM_EXACTNESS} ELSE 1.0 END, 'beekeeping', NULL FROM s
  UNION ALL SELECT k, r, 3, CASE WHEN degree THEN 'met' ELSE 'missing' END, CASE WHEN degree THEN 'taxonomy' ELSE 'none' END, CASE WHEN degree THEN 1.0 ELSE 0.0 END, (['B.Sc Physics', 'M.Sc Chemistry', 'PhD History', NULL])[r % 4 + 1], NULL FROM s
  UNION ALL SELECT k, r, 4, 'met', 'taxonomy', sql_level, 'SQL', NULL FROM s
  UNION ALL SELECT k, r, 5, 'met', 'taxonomy', 1.0, 'End to End Test Automation', NULL FROM s
  UNION ALL SELECT k, r, 6, 'contested', 'embedding', {P.BRIDGE_CREDIT}, 'Jenkins', {P.BRIDGE_CREDIT} FROM s
  UNION ALL SELECT k, r, 7, CASE WHEN NOT must AND r % 3 = 0 THEN 'partial' ELSE 'missing' END, CASE WHEN NOT must AND r % 3 = 0 THEN 'taxonomy' ELSE 'none' END, CASE WHEN NOT must AND r % 3 = 0 THEN {P.CORROBORATED} ELSE 0.0 END, NULL, NULL FROM s
  UNION ALL SELECT k, r, 8, 'met', 'embedding', 0.8, 'Loom work', 0.8 FROM s
)
SELECT k AS jd_id, r AS resume_id, n AS req_pos, status, method, round(score::DOUBLE, 4) AS score, matched_as, similarity::DOUBLE AS similarity FROM o
"""


def _passes_sql() -> str:
    flag = {"e": "c_custkey % 7 = 0", "a": "c_custkey % 2 = 0", "b": "c_custkey % 3 = 0", "c": "c_custkey % 3 = 1", "d": "c_custkey % 5 < 3", "f": "c_custkey % 4 < 2"}
    names = list(flag)
    at = {n: " + ".join(["3", *(f"({flag[m]})::INT" for m in names[: names.index(n)])]) for n in names}
    row = lambda n, test, order, name, category, importance, years: f"SELECT c_custkey, {order} AS pass, {at[n]} AS line_no, {name} AS name, '{category}' AS category, '{importance}' AS importance, {years} AS min_years FROM customer WHERE {test}"
    rows = [
        row("a", flag["a"], 1, "'SQL'", "skill", "preferred", "(c_custkey % 9 + 1)::DOUBLE"), row("f", f"{flag['f']} AND NOT ({flag['a']})", 1, "'SQL'", "skill", "must", "NULL::DOUBLE"), row("d", flag["d"], 1, "'Python'", "skill", "preferred", "NULL"),
        row("b", flag["b"], 2, "'Bachelor degree in Statistics'", "education", "must", "NULL"), row("c", flag["c"], 3, "'Build reliable billing systems for ' || lower(c_mktsegment)", "skill", "preferred", "NULL"),
    ]
    return f"SELECT c_custkey AS doc_id, row_number() OVER (PARTITION BY c_custkey ORDER BY pass, line_no)::INT AS req_pos, name, category, importance, min_years, line_no::INT AS line_no FROM ({' UNION ALL '.join(rows)})"


def oracle_sql() -> dict[str, str]:
    facts = ", ".join(LINE_FACTS)
    results = f"(VALUES {listed(RESULTS)}) t(place, {', '.join(RESULT_COLUMNS)})"
    expected = "CASE c_custkey % 4 WHEN 0 THEN 'weak' ELSE 'strong' END"
    ratio = lambda a, b: f"coalesce({a}::DOUBLE / nullif({b}, 0), 0)"
    p, r, g = ratio("sum(tp)", "sum(tp + fp)"), ratio("sum(tp)", "sum(tp + fn)"), ratio("sum(gap_tp)", "sum(gap_tp + gap_fn)")
    f1 = lambda a, b: f"round({ratio(f'(2 * {a} * {b})', f'({a} + {b})')}, 4)"
    gp = "CASE WHEN sum(gap_tp) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE"
    grade = lambda c: f"CASE {c} WHEN 'weak' THEN 0 WHEN 'stretch' THEN 1 WHEN 'plausible' THEN 2 ELSE 3 END"
    return {
        "line_predicates": f"SELECT p_partkey, {facts} FROM part JOIN (VALUES {listed([x[1:] for x in LINES])}) t(place, {facts}) ON p_partkey % {len(LINES)} = place",
        "name_reduction": f"SELECT p_partkey, reduced, parts FROM part JOIN (VALUES {listed([x[1:] for x in NAMES])}) t(place, reduced, parts) ON p_partkey % {len(NAMES)} = place",
        "contact_masks": "SELECT c_custkey, 'Call [phone] or write to [email], see [url] or [url] room 12, 2024' AS masked FROM customer",
        "request_bodies": """
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 6 NOT IN (2, 3) THEN 'a' END AS jd, CASE c_custkey % 6 WHEN 0 THEN greatest(1, least(200, c_custkey))::INT WHEN 1 THEN 40 WHEN 4 THEN 200 WHEN 5 THEN 1 END AS top,
  CASE WHEN c_custkey % 6 IN (2, 3) THEN 'jd and resume must not be blank' END AS error FROM customer
""",
        "literal_texts": r"""
SELECT doc_id, CASE WHEN fine THEN length(text)::INT END AS n_chars, CASE WHEN NOT fine THEN 'the document is empty' END AS error
FROM (SELECT *, doc_id % 7 > 0 AND coalesce(text, '') NOT SIMILAR TO '\s*' AS fine FROM documents)
""",
        "posting_passes": _passes_sql(),
        "resume_facts": """
SELECT c_custkey AS doc_id, ['Data Analyst', 'Senior Analyst', 'Junior Clerk'][c_custkey % 3 + 1] AS title, ['unknown', 'senior', 'entry'][c_custkey % 3 + 1] AS seniority,
  round_even((c_custkey % 12 + 1 + 81 * (c_custkey % 2)) / 12.0::DOUBLE, 1)::DOUBLE AS total_years, CASE WHEN c_custkey % 4 < 3 THEN 'B.Sc in Physics' END AS highest_education,
  CASE WHEN c_custkey % 4 < 3 THEN (1 + (c_custkey % 3 = 1)::INT + 2 + c_custkey % 2 + 2)::INT END AS education_line,
  CASE WHEN c_custkey % 5 < 4 THEN 'Cloud Architect,Scrum Master' ELSE '' END AS certifications FROM customer
""",
        "model_profiles": """
SELECT c_custkey AS doc_id, side, place::INT AS place, name, years::DOUBLE AS years, line_no::INT AS line_no, c_custkey % 4 = 3 AS degraded FROM customer JOIN (VALUES
  (false, 'posting', 0, 'Kubernetes', NULL, 2), (false, 'posting', 1, 'SQL', 8, 3), (false, 'posting', 100000003, 'Python', NULL, 4),
  (true, 'posting', 100000001, 'Kubernetes', NULL, 2), (true, 'posting', 100000002, 'SQL', 8, 3), (true, 'posting', 100000003, 'Python', NULL, 4),
  (false, 'resume', 0, 'Py', 3, 2), (false, 'resume', 1, 'Weaving', NULL, NULL), (false, 'resume', 100000002, 'SQL', NULL, 2),
  (true, 'resume', 100000001, 'Python', NULL, 2), (true, 'resume', 100000002, 'SQL', NULL, 2)
) t(broken, side, place, name, years, line_no) ON (c_custkey % 4 = 3) = broken
""",
        "match_tiers": _tiers_sql(),
        "vector_cosine": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)
SELECT a.vec_id, round(greatest(-1, least(1, list_cosine_similarity(a.v, b.v))), 6)::DOUBLE AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0
""",
        "case_evaluation": f"SELECT c_custkey::VARCHAR AS id, {expected} AS expected_verdict, {', '.join(f'{c}::BIGINT AS {c}' if c in ('tp', 'fn', 'gap_tp', 'gap_fn', 'fp') else f'{c}::DOUBLE AS {c}' if c in ('overall_score', 'must_have_coverage') else c for c in RESULT_COLUMNS)}, 0::BIGINT AS bad_evidence FROM customer JOIN {results} ON c_custkey % 4 = place",
        "case_summary": f"""
SELECT count(*) AS cases, round({p}, 4) AS precision, round({r}, 4) AS recall, {f1(p, r)} AS f1, {gp} AS gap_precision, round({g}, 4) AS gap_recall, {f1(gp, g)} AS gap_f1,
  round(avg((predicted_verdict = {expected})::INT), 4) AS verdict_exact, round(avg((abs({grade('predicted_verdict')} - {grade(expected)}) <= 1)::INT), 4) AS verdict_within_one, 1.0::DOUBLE AS evidence_accuracy, round(avg(overall_score::DOUBLE), 2) AS mean_score
FROM customer JOIN {results} ON c_custkey % 4 = place
""",
        "case_reports": f"SELECT c_custkey::VARCHAR AS jd_id, title, predicted_verdict AS verdict, blockers, strengths, suggestions, true AS degraded, 'rules' AS resume_extractor FROM customer JOIN (VALUES {listed(REPORTS)}) t(place, blockers, strengths, title, suggestions) ON c_custkey % 4 = place JOIN {results.replace(' t(place', ' u(p2')} ON c_custkey % 4 = p2",
    }
