"""The whole analysis as one plan: documents of both sides to one report for each pair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.dims import DEFAULT, SkillDictionary
from pairlens.operators.extract import requirements, resume_profiles, resume_skills, titles
from pairlens.operators.lines import read_lines
from pairlens.operators.match import MatchConfig, match
from pairlens.operators.model_output import merge_requirements, model_requirements, model_skills
from pairlens.operators.score import reports
from pairlens.plans.stages import dealt, staged

Backend = Literal["auto", "llm", "rules"]


@dataclass(frozen=True)
class Analysis:
    """The tables of one run, each a lazy plan."""

    jd_lines: DataFrame
    resume_lines: DataFrame
    requirements: DataFrame
    skills: DataFrame
    profiles: DataFrame
    outcomes: DataFrame
    reports: DataFrame


def every_pair(postings: DataFrame, resumes: DataFrame) -> DataFrame:
    """(jd_id, resume_id) of every posting with every resume: N x M reports, for who wants that."""
    return postings.select(F.col("doc_id").alias("jd_id")).crossJoin(resumes.select(F.col("doc_id").alias("resume_id")))


def analyze(
    postings: DataFrame, resumes: DataFrame, as_of: tuple[int, int], *, pairs: DataFrame, dictionary: SkillDictionary = DEFAULT, config: MatchConfig = MatchConfig(),
    backend: Backend = "auto", generate: Callable[[DataFrame], DataFrame] | None = None,
) -> Analysis:
    """Match postings with resumes (doc_id, raw_text each); ``pairs`` (jd_id, resume_id) names what to compare.

    ``as_of`` (year, month) closes open employment. ``generate`` is a model, see
    ``operators.model_output``: its requirements and skills come before those of
    the rules, which read all documents too. Where it gives a document nothing, or
    with no model or the backend "rules", the rules stand alone; resumes they read alone, or of which the
    model failed on some chunk, are degraded.
    """
    model = None if backend == "rules" else generate
    # each is read several times; written, they also keep the plans of the joins small
    jd_lines, resume_lines = staged(read_lines(postings), "jd-lines"), staged(read_lines(resumes), "resume-lines")
    needs, heads = requirements(jd_lines, dictionary), titles(jd_lines)
    skills, certificates = resume_skills(resume_lines, dictionary)
    if model is None:
        heads = heads.withColumns({"company": F.lit(None).cast("string"), "jd_extractor": F.lit("rules")})
        facts = None
    else:
        found, told = model_requirements(jd_lines, model, dictionary)
        found, told = staged(found, "model-requirements"), staged(told, "model-facts")
        needs = merge_requirements(found, needs, dictionary)
        read = found.select("doc_id").distinct().withColumn("_read", F.lit(True))
        heads = heads.withColumnRenamed("title", "_title").join(dealt(told.select("doc_id", "title", "company")), "doc_id", "left").join(dealt(read), "doc_id", "left")
        heads = heads.select("doc_id", F.coalesce("title", "_title").alias("title"), "company", "seniority", F.when(F.col("_read"), "model").otherwise("rules").alias("jd_extractor"))
        skills, facts = model_skills(resume_lines, model, skills, dictionary)
        facts = staged(facts, "model-resumes")
    needs, skills = staged(needs, "requirements"), staged(skills, "skills")
    if facts is not None:
        certificates = skills.where("category = 'certification'").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("certifications"))
    profiles = resume_profiles(resumes, resume_lines, certificates, as_of)
    if facts is None:
        profiles = profiles.withColumns({"resume_extractor": F.lit("rules"), "degraded": F.lit(True)})
    else:
        profiles = profiles.join(dealt(facts), "doc_id", "left").withColumn("resume_extractor", F.when(F.col("degraded").isNotNull(), "model").otherwise("rules")).withColumn("degraded", F.coalesce("degraded", F.lit(True)))
    profiles = staged(profiles, "profiles")
    outcomes = staged(match(pairs, needs, skills, profiles, dictionary, config), "outcomes")
    return Analysis(jd_lines, resume_lines, needs, skills, profiles, outcomes, reports(pairs, outcomes, profiles, heads, config))
