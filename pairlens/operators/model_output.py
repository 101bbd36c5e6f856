"""Repair of a language model's extraction: JSON recovery, names, years, evidence, and merging with the rules.

The model itself is a hook: any function from rows (doc_id, chunk_no, numbered,
system, prompt, schema) to rows (doc_id, chunk_no, raw), for instance a
``mapInPandas`` around a local model.  ``system`` and ``prompt`` are what to ask,
``schema`` is the JSON schema that an answer keeps to.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.dims import SkillDictionary, shown
from pairlens.functions import patterns as P
from pairlens.functions import text as X
from pairlens.operators.extract import REQUIREMENT, SKILL, first_by
from pairlens.operators.lines import chunks, resolve_quotes
from pairlens.plans.stages import dealt

EVIDENCE_JSON = "struct<text:string,line:int>"
JD_JSON = f"title string, company string, requirements array<struct<name:string,category:string,importance:string,min_years:double,evidence:{EVIDENCE_JSON}>>"
RESUME_JSON = f"skills array<struct<name:string,category:string,proficiency:string,years:double,evidence:{EVIDENCE_JSON}>>"


#: What a model may answer in these fields.
CATEGORIES = ["skill", "experience", "education", "certification", "soft", "domain", "language", "other"]
IMPORTANCES = ["must", "preferred", "nice_to_have"]
PROFICIENCIES = ["exposed", "working", "proficient", "expert"]


def _answer(what: str, fields: dict, item: dict) -> str:
    """JSON schema of an object with some fields and a list of items with evidence."""
    evidence = {"type": "object", "properties": {"text": {"type": "string"}, "line": {"type": "integer", "minimum": 1}}, "required": ["text", "line"]}
    items = {"type": "object", "properties": {"name": {"type": "string"}, "category": {"enum": CATEGORIES}, **item, "evidence": evidence}, "required": ["name", "category", *(k for k, v in item.items() if "enum" in v)], "additionalProperties": False}
    return json.dumps({"type": "object", "properties": {**fields, what: {"type": "array", "items": items}}, "required": [what], "additionalProperties": False})


TEXT_OR_NULL, NUMBER_OR_NULL = {"type": ["string", "null"]}, {"type": ["number", "null"]}
SCHEMAS = {
    "posting": _answer("requirements", {"title": TEXT_OR_NULL, "company": TEXT_OR_NULL}, {"importance": {"enum": IMPORTANCES}, "min_years": NUMBER_OR_NULL}),
    "resume": _answer("skills", {}, {"proficiency": {"enum": PROFICIENCIES}, "years": NUMBER_OR_NULL}),
}
SYSTEM = {
    "posting": "Read a job posting whose lines are numbered and list what it asks for as JSON. Name each requirement once. Call it must where the text demands it, preferred where it wishes for it, nice_to_have otherwise. "
    "Give min_years only where a number of years is written. Quote the line that backs each entry, with its number, and add nothing that is not written.",
    "resume": "Read a resume whose lines are numbered and list what its author can do as JSON. Name each skill once, with the best proof the text has for it: exposed if only mentioned, working if applied, proficient if used alone and well, expert if led or deep. "
    "Give years only where a number of years is written. Quote the line that backs each entry, with its number, and add nothing that is not written.",
}
ASK = "Go through all lines below, from the first to the last, and make an entry for each that names something."


def prompted(chunks_: DataFrame, side: str) -> DataFrame:
    """Chunks with what a model is asked about them: system, prompt, schema. ``side``: posting or resume."""
    return chunks_.withColumns({"system": F.lit(SYSTEM[side]), "prompt": F.concat(F.lit(ASK + "\n\n"), "numbered"), "schema": F.lit(SCHEMAS[side])})


def recovered(raw: Column, schema: str) -> Column:
    """The JSON object in a model's text, null if there is none or it never ends."""
    text = X.json_object(raw)
    return F.when(F.get_json_object(text, "$").isNotNull(), F.from_json(text, schema))


def name_variants(name: Column) -> Column:
    """Reductions of a name to the skill in it: several words before one, longer before shorter."""
    bare = X.removed(X.removed(name, P.USE_SUFFIXES, " "), P.QUALIFIERS, " ")
    both = F.transform(F.array(bare, X.removed(bare, P.DURATION_CLAUSE, " ")), lambda v: X.removed(X.collapsed(X.removed(v, r"[^A-Za-z0-9+#.\-/ ]+", " ")), r"^[ -]+|[ -]+$"))
    parts = F.flatten(F.transform(both, lambda v: F.concat(F.array(v), F.transform(F.split(v, r"(?i)\s+(?:and|or)\s+|/|,"), F.trim))))
    keyed = F.transform(F.filter(parts, lambda v: v != ""), lambda v, i: F.struct((F.size(X.words(v)) == 1).alias("single"), (-F.length(v)).alias("short"), i.alias("i"), v.alias("v")))
    return F.array_distinct(F.transform(F.array_sort(keyed), lambda k: k["v"]))


def canonical_names(rows: DataFrame, key: list[str], dictionary: SkillDictionary, out: str = "reduced") -> DataFrame:
    """``rows`` (unique by ``key``) with ``out``: the canonical name that ``name`` reduces to, else the name."""
    tried = rows.select(*key, F.posexplode(F.concat(F.array("name"), name_variants(F.col("name")))).alias("_at", "_variant"))
    known = dictionary.with_canonical(tried, F.col("_variant"), "_canonical").where(F.col("_canonical").isNotNull())
    best = known.groupBy(*key).agg(F.min_by("_canonical", "_at").alias("_canonical"))
    return rows.join(dealt(best), key, "left").withColumn(out, F.coalesce("_canonical", "name")).drop("_canonical")


def label_keys(rows: DataFrame, key: list[str], dictionary: SkillDictionary, out: str = "label_key") -> DataFrame:
    """``rows`` with a key under which two names of one skill agree: its canonical name in lower case, else the normalised name."""
    held = dictionary.with_canonical(canonical_names(rows, key, dictionary, "_reduced"), F.col("_reduced"), "_label")
    return held.withColumn(out, F.coalesce(F.lower("_label"), X.norm_key(F.col("name")))).drop("_reduced", "_label")


def model_requirements(lines: DataFrame, generate: Callable[[DataFrame], DataFrame], dictionary: SkillDictionary) -> tuple[DataFrame, DataFrame]:
    """Requirements from a model over chunks of lines, repaired; and (doc_id, title, company, degraded).

    Evidence is looked up in the lines, years are read from it and from nowhere
    else, and chunks whose output is no JSON mark the document as degraded.
    """
    raw = generate(prompted(chunks(lines), "posting")).withColumn("_j", recovered(F.col("raw"), JD_JSON))
    facts = raw.groupBy("doc_id").agg(
        F.min_by(F.substring(F.trim("_j.title"), 1, 160), F.when(F.trim("_j.title") != "", F.col("chunk_no"))).alias("title"),
        F.min_by(F.substring(F.trim("_j.company"), 1, 160), F.when(F.trim("_j.company") != "", F.col("chunk_no"))).alias("company"), F.bool_or(F.col("_j").isNull()).alias("degraded"),
    )
    items = raw.select("doc_id", "chunk_no", F.posexplode("_j.requirements").alias("_i", "r")).where(F.trim("r.name") != "")
    items = items.select("doc_id", F.struct("chunk_no", "_i").alias("ord"), (F.col("chunk_no") * 100_000 + F.col("_i")).cast("int").alias("req_pos"), F.trim("r.name").alias("name"), "r.category", "r.importance", F.col("r.evidence.text").alias("quote"), F.col("r.evidence.line").alias("line_hint"))
    known = dictionary.with_canonical(items, F.col("name")).withColumn("_key", F.lower(shown(F.col("name"), F.col("canonical"))))
    known = first_by(known, ["doc_id", "_key"], "req_pos").drop("canonical", "_key", "ord")
    found = resolve_quotes(known.withColumnRenamed("req_pos", "quote_id"), lines).withColumnRenamed("quote_id", "req_pos")
    named = canonical_names(found, ["doc_id", "req_pos"], dictionary)
    out = named.withColumns({"name": F.substring("reduced", 1, 120), "min_years": X.years(F.col("evidence.text")), "category": F.coalesce("category", F.lit("skill")), "importance": F.coalesce("importance", F.lit("preferred"))})
    return out.select(*REQUIREMENT), facts


def model_skills(lines: DataFrame, generate: Callable[[DataFrame], DataFrame], rules: DataFrame, dictionary: SkillDictionary) -> tuple[DataFrame, DataFrame]:
    """Skills from a model, repaired, followed by the rules' skills that it missed; and (doc_id, degraded) of the documents that it read."""
    raw = generate(prompted(chunks(lines), "resume")).withColumn("_j", recovered(F.col("raw"), RESUME_JSON))
    facts = raw.groupBy("doc_id").agg(F.bool_or(F.col("_j").isNull()).alias("degraded"), F.sum(F.coalesce(F.size("_j.skills"), F.lit(0))).alias("n")).where("n > 0").drop("n")
    items = raw.select("doc_id", "chunk_no", F.posexplode("_j.skills").alias("_i", "r")).where(F.trim("r.name") != "")
    items = items.select(
        "doc_id", (F.col("chunk_no") * 100_000 + F.col("_i")).cast("int").alias("skill_pos"), F.substring(F.trim("r.name"), 1, 120).alias("name"), F.coalesce("r.category", F.lit("skill")).alias("category"),
        F.coalesce("r.proficiency", F.lit("working")).alias("proficiency"), "r.years", F.col("r.evidence.text").alias("quote"), F.col("r.evidence.line").alias("line_hint"),
    )
    found = resolve_quotes(items.withColumnRenamed("skill_pos", "quote_id"), lines).withColumnRenamed("quote_id", "skill_pos").select(*SKILL)
    return _first_of_both(found, rules, "skill_pos", dictionary), facts


def merge_requirements(model: DataFrame, rules: DataFrame, dictionary: SkillDictionary) -> DataFrame:
    """The model's requirements, then the rules' that it did not name."""
    return _first_of_both(model, rules, "req_pos", dictionary)


def _first_of_both(model: DataFrame, rules: DataFrame, place: str, dictionary: SkillDictionary) -> DataFrame:
    both = model.withColumn("_source", F.lit(0)).unionByName(rules.withColumn("_source", F.lit(1)))
    keyed = dictionary.with_canonical(both, F.col("name")).withColumn("_key", X.norm_key(shown(F.col("name"), F.col("canonical"))))
    first = first_by(keyed, ["doc_id", "_key"], "_source", place)
    return first.withColumn(place, F.col("_source") * 100_000_000 + F.col(place)).drop("_source", "_key", "canonical")
