"""Matching: ranked tiers of joins between requirements and resume skills, then scores.

Every tier emits candidates (pair, requirement, tier, order, skill); the first
by tier and order wins.  The nearest-vector tier is staged behind the others and
runs only where an encoder is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.dims import SkillDictionary
from pairlens.functions import patterns as P
from pairlens.functions import text as X
from pairlens.operators.extract import first_by
from pairlens.plans.stages import dealt, staged

PAIR = ["jd_id", "resume_id"]


@dataclass(frozen=True)
class MatchConfig:
    """Scoring knobs; ``encode`` maps a text column to a column of unit vectors.

    ``use_recency``, ``embedding_weight`` and ``evidence_credit`` are accepted and change nothing.
    """

    use_embeddings: bool = True
    use_recency: bool = False
    partial_credit: float = 0.5
    min_years_sensitivity: float = 1.0
    embedding_weight: float = 0.35
    evidence_credit: float = 1.0
    must_have_gate: bool = True
    encode: Callable[[Column], Column] | None = None

    def as_dict(self) -> dict[str, str]:
        return {k: str(getattr(self, k)) for k in ("use_embeddings", "partial_credit", "min_years_sensitivity", "embedding_weight", "must_have_gate")}


def index_skills(skills: DataFrame, dictionary: SkillDictionary) -> DataFrame:
    """``skills`` with canonical (null outside the dictionary), ``_indexed`` on the best of each canonical, ``_first`` its first place."""
    held = dictionary.with_canonical(skills, F.col("name"))
    rank = F.struct(X.proficiency_score(F.col("proficiency")).alias("s"), (-F.col("skill_pos")).alias("p"))
    best = held.where(F.col("canonical").isNotNull()).groupBy("doc_id", "canonical").agg(F.max_by("skill_pos", rank).alias("_best"), F.min("skill_pos").alias("_first"))
    out = held.join(dealt(best), ["doc_id", "canonical"], "left")
    return out.withColumn("_indexed", F.coalesce(F.col("skill_pos") == F.col("_best"), F.lit(False))).drop("_best")


def surface_index(indexed: DataFrame, dictionary: SkillDictionary) -> DataFrame:
    """(doc_id, surface_key, skill_pos): any spelling of an indexed skill, of the last canonical that has it; else the first skill of that name."""
    held = indexed.where("_indexed")
    forms = dictionary.small(dictionary.forms(indexed.sparkSession), len(dictionary.form_rows())).select(F.col("form_canonical").alias("canonical"), F.col("form_key").alias("surface_key"))
    spelled = held.join(forms, "canonical").select("doc_id", "surface_key", "skill_pos", F.lit(0).alias("kind"), (-F.col("_first")).alias("ord"))
    named = held.select("doc_id", X.norm_key(F.col("name")).alias("surface_key"), "skill_pos", F.lit(1).alias("kind"), F.col("_first").alias("ord"))
    others = indexed.where(F.col("canonical").isNull()).select("doc_id", X.norm_key(F.col("name")).alias("surface_key"), "skill_pos", F.lit(2).alias("kind"), F.col("skill_pos").alias("ord"))
    return first_by(spelled.unionByName(named).unionByName(others), ["doc_id", "surface_key"], "kind", "ord").select("doc_id", "surface_key", "skill_pos")


def sub_phrases(requirements: DataFrame, dictionary: SkillDictionary) -> DataFrame:
    """(jd_id, req_pos, canonical, tier, ord) of known phrases inside requirement names: windows of four to one words, then parts."""
    text = X.removed(F.col("name"), P.DURATION_NOISE, " ")

    def windows_of(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.array(*(F.lit(w) for w in (4, 3, 2, 1))), lambda w: F.struct((i * 10 - w).alias("ord"), F.array_join(F.slice(tokens, i, w), " ").alias("phrase")))))

    windows = X.let(X.words(text), windows_of)
    parts = F.transform(F.filter(X.compound_parts(text), lambda p: F.length(p) > 2), lambda p, i: F.struct(i.alias("ord"), p.alias("phrase")))
    rows = requirements.select("jd_id", "req_pos", F.explode(F.concat(F.transform(windows, lambda w: F.struct(F.lit(4).alias("tier"), w["ord"].cast("int").alias("ord"), w["phrase"].alias("phrase"))), F.transform(parts, lambda p: F.struct(F.lit(5).alias("tier"), p["ord"].cast("int").alias("ord"), p["phrase"].alias("phrase"))))).alias("c"))
    rows = rows.select("jd_id", "req_pos", "c.tier", "c.ord", "c.phrase").where(F.col("phrase") != "")
    return dictionary.with_canonical(rows, F.col("phrase")).where(F.col("canonical").isNotNull()).drop("phrase")


def bridges(dictionary: SkillDictionary, requirements: DataFrame) -> DataFrame:
    """(practice_canonical, practice_key, tool, ord) of the tools that put a practice to use."""
    rows = [(practice, tool, k * 100 + i) for k, (practice, tools) in enumerate(P.BRIDGES.items()) for i, tool in enumerate(tools)]
    table = requirements.sparkSession.createDataFrame(rows, "practice string, tool string, ord int")
    return dictionary.with_canonical(table, F.col("practice"), "practice_canonical").withColumn("practice_key", X.norm_key(F.col("practice")))


def match(pairs: DataFrame, requirements: DataFrame, skills: DataFrame, profiles: DataFrame, dictionary: SkillDictionary, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Outcomes: one row for each requirement of each pair (jd_id, resume_id).

    ``requirements`` and ``skills`` carry doc_id; ``profiles`` one row a resume.
    """
    needs = dictionary.with_canonical(requirements.withColumnRenamed("doc_id", "jd_id"), F.col("name"), "req_canonical").withColumn("req_key", X.norm_key(F.col("name")))
    needs = staged(needs, "needs")
    indexed = staged(index_skills(skills, dictionary).withColumnRenamed("doc_id", "resume_id"), "indexed")
    asked = pairs.select(*PAIR).join(dealt(needs), "jd_id")
    held = indexed.where("_indexed").select("resume_id", F.col("canonical").alias("req_canonical"), "skill_pos")
    candidate = lambda df, tier, method, similarity=None: df.select(*PAIR, "req_pos", F.lit(tier).alias("tier") if isinstance(tier, int) else tier, "ord", "skill_pos", F.lit(method).alias("method"), F.lit(similarity).cast("double").alias("similarity"))

    by_name = asked.join(dealt(held), ["resume_id", "req_canonical"]).withColumn("ord", F.lit(0))
    surfaces = surface_index(indexed.withColumnRenamed("resume_id", "doc_id"), dictionary).select(F.col("doc_id").alias("resume_id"), F.col("surface_key").alias("req_key"), "skill_pos")
    by_surface = asked.join(dealt(surfaces), ["resume_id", "req_key"]).withColumn("ord", F.lit(0))
    level = X.degree_level(F.col("name"))
    degree = asked.where("category = 'education'").join(dealt(profiles.select(F.col("doc_id").alias("resume_id"), "highest_education")), "resume_id")
    by_degree = degree.where((level > 0) & (X.degree_level(F.col("highest_education")) >= level)).withColumn("ord", F.lit(0)).withColumn("skill_pos", F.lit(-1))
    inside = pairs.select(*PAIR).join(dealt(sub_phrases(needs, dictionary).withColumnRenamed("canonical", "req_canonical")), "jd_id").join(dealt(held), ["resume_id", "req_canonical"])
    tools = F.broadcast(bridges(dictionary, requirements))  # a fixed, small table
    practices = needs.select("jd_id", "req_pos", "req_canonical", "req_key").join(tools, (F.col("req_canonical") == F.col("practice_canonical")) | (F.col("req_key") == F.col("practice_key")))
    through = pairs.select(*PAIR).join(dealt(practices.select("jd_id", "req_pos", F.col("tool").alias("req_canonical"), "ord")), "jd_id").join(dealt(held), ["resume_id", "req_canonical"])

    every = candidate(by_name, 1, "taxonomy").unionByName(candidate(by_surface, 2, "synonym")).unionByName(candidate(by_degree, 3, "taxonomy"))
    every = every.unionByName(candidate(inside, F.col("tier"), "taxonomy")).unionByName(candidate(through, 6, "embedding", P.BRIDGE_CREDIT))
    best = first_by(every, [*PAIR, "req_pos"], "tier", "ord", "skill_pos").select(*PAIR, "req_pos", "skill_pos", "method", "similarity")
    best = staged(best, "candidates")
    if config.use_embeddings and config.encode is not None:
        open_ = asked.where(F.col("req_canonical").isNull()).join(dealt(best), [*PAIR, "req_pos"], "left_anti")
        best = best.unionByName(nearest(open_, indexed, config.encode))

    theirs = indexed.select("resume_id", "skill_pos", F.col("name").alias("matched_as"), F.col("proficiency").alias("matched_proficiency"), F.col("years").alias("_years"), F.col("evidence").alias("resume_evidence"))
    out = asked.join(dealt(best), [*PAIR, "req_pos"], "left").join(dealt(theirs), ["resume_id", "skill_pos"], "left").join(dealt(profiles.withColumnRenamed("doc_id", "resume_id")), "resume_id", "left")
    return corroborate(scored(by_education(out), config), skills, dictionary)


def by_education(out: DataFrame) -> DataFrame:
    """Degrees stand in for a skill where tier 3 matched: expert if level or a subject agree, else working."""
    mine = F.col("skill_pos") == -1
    text = F.col("highest_education")
    shared = F.size(F.array_intersect(X.content_tokens(F.col("name")), X.content_tokens(text))) > 0
    exact = X.degree_level(text) == X.degree_level(F.col("name"))
    source = F.struct(F.substring(text, 1, 400).alias("text"), F.coalesce("education_evidence.line", F.lit(1)).alias("line"), F.coalesce("education_evidence.section", F.lit("education")).alias("section"))
    return out.withColumns({
        "matched_as": F.when(mine, F.substring(text, 1, 120)).otherwise(F.col("matched_as")),
        "matched_proficiency": F.when(mine, F.when(shared | exact, "expert").otherwise("working")).otherwise(F.col("matched_proficiency")),
        "resume_evidence": F.when(mine, source).otherwise(F.col("resume_evidence")),
    })


def years_score(required: Column, available: Column, sensitivity: float) -> Column:
    """Credit for stated years against a minimum: full when met, never below the floor."""
    ratio = F.try_divide(available, required)
    penalty = F.least(F.lit(1.0 - P.YEARS_FLOOR), (1.0 - ratio) * P.YEARS_SLOPE * sensitivity)
    return F.when(available.isNull(), P.YEARS_UNSTATED).when(ratio >= 1.0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - penalty))


def text_overlap(requirement: Column, source: Column) -> Column:
    wanted, there = X.content_tokens(requirement), X.content_tokens(source)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, there)).cast("double"), F.size(wanted)), F.lit(0.0))


def _short(number: Column) -> Column:
    """A number without a needless fraction."""
    return X.removed(number.cast("string"), r"\.0$")


def scored(out: DataFrame, config: MatchConfig) -> DataFrame:
    """Scores, states and explanations of matched requirements; unmatched ones are missing."""
    hit, method = F.col("skill_pos").isNotNull(), F.col("method")
    weight = F.lit("0").cast("decimal(4,2)")
    for name, value in P.IMPORTANCE_WEIGHTS.items():
        weight = F.when(F.col("importance") == name, F.lit(value).cast("decimal(4,2)")).otherwise(weight)
    overlap = text_overlap(F.col("name"), F.coalesce("resume_evidence.text", "matched_as"))
    exactness = F.when(method == "taxonomy", 1.0).when(method == "synonym", P.SYNONYM_EXACTNESS).otherwise(F.coalesce("similarity", F.lit(0.7)))
    required = F.nullif("min_years", F.lit(0.0))
    available = F.coalesce(F.nullif("_years", F.lit(0.0)), F.when(required.isNotNull(), F.nullif("total_years", F.lit(0.0))))
    years = F.when(required.isNotNull(), years_score(required, available, config.min_years_sensitivity)).otherwise(1.0)
    raw = F.least(F.lit(1.0), F.least(F.lit(1.0), exactness + 0.1 * overlap) * X.proficiency_score(F.col("matched_proficiency")) * years)
    held = out.withColumns({"weight": weight, "_overlap": overlap, "_raw": F.round(raw, 4), "_available": available})
    weak = F.coalesce(F.col("similarity") < P.NEAREST_LEAST, F.lit(False))
    status = F.when(F.col("_raw") >= P.MET, "met").when(F.col("_raw") >= P.PARTIAL, "partial").otherwise("contested")
    note = F.when(F.col("_available").isNull(), F.concat(F.lit(P.YEARS_NOTES[0]), _short(F.col("min_years")), F.lit(P.YEARS_NOTES[2]))).otherwise(
        F.concat(_short(F.col("_available")), F.lit(P.YEARS_NOTES[1]), _short(F.col("min_years")), F.lit(P.YEARS_NOTES[2]))
    )
    story = F.concat_ws(
        "; ", F.concat(F.lit(P.MATCHED_NOTE[0]), method, F.lit(P.MATCHED_NOTE[1]), F.col("matched_as"), F.lit(P.MATCHED_NOTE[2]), F.col("matched_proficiency"), F.lit(P.MATCHED_NOTE[3])), F.when(required.isNotNull(), note),
        F.when((F.col("_overlap") > 0) & (method == "embedding"), F.format_string(P.OVERLAP_NOTE, F.col("_overlap") * 100)),
    )
    return held.select(
        *PAIR, "req_pos", "name", "category", "importance", "min_years", "evidence", "weight",
        F.when(~hit, "missing").when(weak, "contested").otherwise(status).alias("status"),
        F.when(~hit, 0.0).when(weak, F.round(F.least("_raw", "similarity"), 4)).otherwise(F.col("_raw")).alias("score"),
        "matched_as", "matched_proficiency", "resume_evidence", F.coalesce(method, F.lit("none")).alias("method"), "similarity",
        F.when(hit, story).otherwise(P.MISSING_NOTE).alias("explanation"),
    )


def corroborate(outcomes: DataFrame, skills: DataFrame, dictionary: SkillDictionary) -> DataFrame:
    """Gaps that are no musts but stand in the text of some skill's evidence become partial.

    Only gaps are looked up, and each name once a resume, however many postings ask for it.
    """
    gap = F.col("status").isin("missing", "contested") & (F.col("importance") != "must") & (F.length("_key") >= 3)
    held = outcomes.withColumn("_key", X.norm_key(F.col("name")))
    wanted = held.where(gap).select("resume_id", "_key").distinct()
    forms = dictionary.forms(outcomes.sparkSession).groupBy("form_canonical").agg(F.collect_set("form_key").alias("_forms"))
    forms = forms.withColumn("_key", X.norm_key(F.col("form_canonical"))).drop("form_canonical")
    every = F.array_union(F.coalesce("_forms", F.array().cast("array<string>")), F.array("_key"))
    asked = wanted.join(dictionary.small(forms, dictionary.size()), "_key", "left").select("resume_id", "_key", F.explode(F.filter(every, lambda f: F.length(f) >= 3)).alias("_form"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("skill_pos", F.lower("evidence.text").alias("t")))), lambda r: r["t"])
    texts = skills.where(F.col("evidence").isNotNull()).groupBy(F.col("doc_id").alias("resume_id")).agg(F.concat(F.lit(" "), X.norm_key(F.array_join(ordered, " ")), F.lit(" ")).alias("_text"))
    seen = asked.join(dealt(texts), "resume_id").where(F.col("_text").contains(F.concat(F.lit(" "), "_form", F.lit(" ")))).select("resume_id", "_key").distinct()
    held = held.join(dealt(seen.withColumn("_seen", F.lit(True))), ["resume_id", "_key"], "left")
    rises = F.coalesce(gap & F.col("_seen"), F.lit(False))
    return held.withColumns({
        "status": F.when(rises, "partial").otherwise(F.col("status")), "score": F.when(rises, F.greatest(F.col("score"), F.lit(P.CORROBORATED))).otherwise(F.col("score")),
        "method": F.when(rises, "taxonomy").otherwise(F.col("method")),
        "explanation": F.when(rises, F.concat("explanation", F.lit(P.CORROBORATED_NOTE))).otherwise(F.col("explanation")),
    }).select(outcomes.columns)


def described(name: Column, evidence: Column) -> Column:
    """A name with the sentence that backs it."""
    return F.concat_ws(". ", name, evidence["text"])


def nearest(open_: DataFrame, indexed: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """The resume skill nearest to each open requirement by cosine, if near enough.

    Each side is encoded once; a resume's skills are at most ``MAX_ITEMS``, which bounds the join.
    """
    wanted = open_.select(*PAIR, "req_pos", encode(described(F.col("name"), F.col("evidence"))).alias("_mine"))
    pool = indexed.where((F.col("name") != "") & ~F.col("name").startswith("[")).select("resume_id", "skill_pos", encode(described(F.col("name"), F.col("evidence"))).alias("_theirs"))
    both = wanted.join(dealt(pool), "resume_id").withColumn("_cosine", X.cosine(F.col("_mine"), F.col("_theirs")))
    best = first_by(both, [*PAIR, "req_pos"], F.desc("_cosine"), "skill_pos").where(F.col("_cosine") >= P.NEAREST_LEAST)
    return best.select(*PAIR, "req_pos", "skill_pos", F.lit("embedding").alias("method"), F.round("_cosine", 4).alias("similarity"))
