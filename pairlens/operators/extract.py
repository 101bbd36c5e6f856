"""Profiles from lines: skill mentions, requirements of postings, skills of resumes, employment and education."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.dims import SkillDictionary
from pairlens.functions import patterns as P
from pairlens.functions import text as X
from pairlens.operators.lines import clause_context, evidence
from pairlens.plans.stages import dealt

REQUIREMENT = ["doc_id", "req_pos", "name", "category", "importance", "min_years", "evidence"]
SKILL = ["doc_id", "skill_pos", "name", "category", "proficiency", "years", "evidence"]


def skill_hits(lines: DataFrame, skills: SkillDictionary, sections: list[str] | None = None) -> DataFrame:
    """``lines`` with (canonical, canon_ord): a row for each skill that a line names in any spelling.

    Each distinct word of a line meets the forms that begin with it; a form counts
    if the line holds it whole and no earlier form of the same skill, so a line
    names a skill once without any shuffle.
    """
    rows = lines if sections is None else lines.where(F.col("section").isin(sections))
    keyed = rows.withColumn("_key", F.concat(F.lit(" "), X.norm_key(F.col("text")), F.lit(" ")))
    words = keyed.withColumn("first_word", F.explode(F.array_distinct(F.split(F.trim("_key"), " "))))
    forms = skills.small(skills.first_words(lines.sparkSession), len(skills.form_rows()))
    held = lambda form: F.col("_key").contains(F.concat(F.lit(" "), form, F.lit(" ")))
    return words.join(forms, "first_word").where(held(F.col("form_key")) & ~F.exists("before", held)).drop("first_word", "form_key", "before", "_key")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(df: DataFrame, out: str, *order: Column | str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def requirements(lines: DataFrame, skills: SkillDictionary, most: int | None = P.MAX_ITEMS) -> DataFrame:
    """Requirements of postings by rules: named skills, then degrees, then clauses with a verb of action; ``most`` a posting, or all."""
    known = clause_context(lines, 3).withColumn("_degree", X.asks_for_degree(F.col("text")))
    hits = skill_hits(known, skills).where(~X.is_prose(F.col("text")))
    own = F.col("context")
    named = hits.where(~X.asks_for_degree(own)).select(
        "doc_id", F.lit(1).alias("pass"), "line_no", "canon_ord", F.col("canonical").alias("key"), F.col("canonical").alias("name"), X.category(own, F.col("section")).alias("category"),
        X.importance(own).alias("importance"), X.years(own).alias("min_years"), evidence().alias("evidence"),
    )
    plain = X.without_bullet(F.col("text"))
    phrase = X.requirement_phrase(X.clean_markdown(plain))
    degrees = known.where("_degree").select(
        "doc_id", F.lit(2).alias("pass"), "line_no", F.lit(0).alias("canon_ord"), X.norm_key(phrase).alias("key"), phrase.alias("name"), F.lit("education").alias("category"),
        X.importance(F.col("text")).alias("importance"), F.lit(None).cast("double").alias("min_years"), evidence().alias("evidence"),
    )
    covered = hits.select("doc_id", "line_no").distinct()
    rest = known.where(~F.col("_degree") & (F.col("is_bullet") | X.is_labelled(F.col("text")))).where(X.has_action_verb(plain)).join(dealt(covered), ["doc_id", "line_no"], "left_anti")
    rest = rest.withColumn("_clause", X.without_label(plain)).where(F.length("_clause") >= 12)
    phrase = X.requirement_phrase(X.clean_markdown(F.col("_clause")))
    clauses = rest.select(
        "doc_id", F.lit(3).alias("pass"), "line_no", F.lit(0).alias("canon_ord"), X.norm_key(phrase).alias("key"), phrase.alias("name"), X.category(F.col("_clause"), F.col("section")).alias("category"),
        X.importance(F.col("_clause")).alias("importance"), X.years(F.col("_clause")).alias("min_years"), evidence().alias("evidence"),
    )
    every = named.unionByName(degrees).unionByName(clauses).where(F.col("name").isNotNull())
    first = first_by(every, ["doc_id", "key"], "pass", "line_no", "canon_ord")
    kept = numbered(first, "req_pos", "pass", "line_no", "canon_ord").where(F.lit(True) if most is None else F.col("req_pos") <= most).withColumn("name", F.substring("name", 1, 120))
    return distinct_requirements(kept.select(*REQUIREMENT))


def distinct_requirements(rows: DataFrame) -> DataFrame:
    """One requirement a name (case aside): the first, unless later ones are musts, then the last of those; at the first's place."""
    must = (F.col("importance") == "must").cast("int")
    rank = F.struct(must.alias("m"), F.when(F.col("importance") == "must", F.col("req_pos")).otherwise(-F.col("req_pos")).alias("p"))
    fields = F.struct("name", "category", "importance", "min_years", "evidence")
    # the first row keeps its place; a must only replaces a row that came before it
    out = rows.groupBy("doc_id", F.lower(F.trim("name")).alias("_key")).agg(F.min("req_pos").alias("req_pos"), F.max_by(fields, rank).alias("r"))
    return out.select("doc_id", "req_pos", "r.*").select(*REQUIREMENT)


def distinct_skills(rows: DataFrame) -> DataFrame:
    """One skill a name (case aside): the most proficient, the first of equals; at the first's place."""
    rank = F.struct(X.proficiency_score(F.col("proficiency")).alias("s"), (-F.col("skill_pos")).alias("p"))
    fields = F.struct("name", "category", "proficiency", "years", "evidence")
    out = rows.groupBy("doc_id", F.lower(F.trim("name")).alias("_key")).agg(F.min("skill_pos").alias("skill_pos"), F.max_by(fields, rank).alias("r"))
    return out.select("doc_id", "skill_pos", "r.*").select(*SKILL)


def certification_parts(lines: DataFrame) -> DataFrame:
    """``lines`` of the section on certifications with column part: each certificate named."""
    own = lines.where((F.col("section") == "certifications") & ~X.is_heading(F.col("text")))
    parts = own.select("*", F.posexplode(F.split(X.removed(F.col("text"), r"^[^:]{0,40}:\s*"), X.UNICODE + P.FRAGMENT_ENDS)).alias("part_no", "part"))
    return parts.withColumn("part", X.stripped(F.col("part"), r" .;\-")).where(F.length("part").between(3, 90) & ~X.found(F.col("part"), r"\d{4}\s*[-–]\s*$"))


def fragments(lines: DataFrame, section: str | None = None) -> DataFrame:
    """Short pieces of lines between separators, without section words, bare numbers and contacts."""
    rows = lines if section is None else lines.where(F.col("section") == section)
    parts = rows.select("*", F.posexplode(F.split(X.without_bullet(F.col("text")), X.UNICODE + P.FRAGMENT_ENDS)).alias("part_no", "part"))
    part = F.col("part")
    fine = F.length(part).between(2, 70) & ~F.lower(part).isin(P.SECTION_WORDS) & ~X.found(part, r"^[\d\s.,%/()-]+$") & ~X.found(part, P.EMAIL) & ~X.found(part, P.URL)
    return parts.withColumn("part", X.stripped(part, r" .;:\-")).where(fine)


def resume_skills(lines: DataFrame, skills: SkillDictionary, most: int | None = P.MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Skills of resumes by rules, ``most`` a resume, or all, and (doc_id, certifications) of all of them."""
    own, section = F.col("context"), F.col("section")
    hits = skill_hits(clause_context(lines, 2), skills).select(
        "doc_id", F.lit(1).alias("pass"), "line_no", F.col("canon_ord").alias("ord"), X.norm_key(F.col("canonical")).alias("key"), F.col("canonical").alias("name"), X.category(own, section).alias("category"),
        X.proficiency(own).alias("proficiency"), X.years(own).alias("years"), evidence().alias("evidence"),
    )
    hits = first_by(hits, ["doc_id", "key"], "line_no", "ord").drop("key")
    held = certification_parts(lines).select(
        "doc_id", F.lit(2).alias("pass"), "line_no", F.col("part_no").alias("ord"), F.col("part").alias("name"), F.lit("certification").alias("category"),
        F.lit("proficient").alias("proficiency"), F.lit(None).cast("double").alias("years"), evidence().alias("evidence"),
    )
    every = hits.unionByName(held)
    certificates = every.where("category = 'certification'").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("certifications"))
    kept = numbered(every, "skill_pos", "pass", "line_no", "ord").where(F.lit(True) if most is None else F.col("skill_pos") <= most)
    return distinct_skills(kept.select(*SKILL)), certificates


def merged_intervals(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, finish) of islands: closed ranges that overlap or touch become one."""
    order = Window.partitionBy(key).orderBy("start", "finish")
    reach = F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= reach + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranges.withColumn("_island", island).groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("finish").alias("finish")).drop("_island")


def total_years(lines: DataFrame, as_of: tuple[int, int]) -> DataFrame:
    """(doc_id, total_years): months of employment, each counted once, in years up to 60."""
    own = lines.where(F.col("section").isNull() | (F.col("section") == "experience"))
    ranges = own.select("doc_id", F.explode(X.date_ranges(F.col("text"), as_of)).alias("r")).select("doc_id", "r.start", "r.finish")
    months = merged_intervals(ranges).groupBy("doc_id").agg(F.sum(F.col("finish") - F.col("start") + 1).alias("months"))
    return months.select("doc_id", F.bround(F.least(F.col("months") / 12.0, F.lit(60.0)), 1).alias("total_years"))


def education(lines: DataFrame) -> DataFrame:
    """(doc_id, highest_education, education_evidence): the first degree line of the section, else outside all sections."""
    own = lines.where((F.col("section").isNull() | (F.col("section") == "education")) & X.found(F.col("text"), P.DEGREE_LINE))
    rank = F.struct(F.when(F.col("section") == "education", 0).otherwise(1), "line_no")
    best = own.groupBy("doc_id").agg(F.min_by(F.struct(F.substring(X.clean_markdown(F.col("text")), 1, 160).alias("t"), evidence().alias("e")), rank).alias("b"))
    return best.select("doc_id", F.col("b.t").alias("highest_education"), F.col("b.e").alias("education_evidence"))


def titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title, seniority): the first line's labelled title, else a short line of the first three without contacts."""
    labelled = F.substring(X.stripped(X.extracted(F.col("text"), P.TITLE, 1)), 1, 160)
    plain = F.when((F.col("line_no") <= 3) & ~X.found(F.col("text"), P.EMAIL) & ~X.found(F.col("text"), P.URL) & (F.length("text") <= 80), F.col("text"))
    best = F.coalesce(F.max(F.when(F.col("line_no") == 1, labelled)), F.min_by(plain, F.when(plain.isNotNull(), F.col("line_no"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    return lines.groupBy("doc_id").agg(best.alias("title"), X.seniority(whole).alias("seniority"))


def resume_profiles(docs: DataFrame, lines: DataFrame, certificates: DataFrame, as_of: tuple[int, int]) -> DataFrame:
    """One row for each document: total_years, highest_education, education_evidence, certifications."""
    out = docs.select("doc_id")
    for part in (total_years(lines, as_of), education(lines), certificates):
        out = out.join(dealt(part), "doc_id", "left")
    return out.withColumn("certifications", F.coalesce("certifications", F.array().cast("array<string>")))
