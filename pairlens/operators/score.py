"""From outcomes to one report for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import patterns as P
from pairlens.operators.match import PAIR, MatchConfig
from pairlens.plans.stages import dealt

OUTCOME = ["req_pos", "name", "category", "importance", "min_years", "evidence", "weight", "status", "score", "matched_as", "matched_proficiency", "resume_evidence", "method", "similarity", "explanation"]


def weighted_mean(value: Column, weight: Column, scale: int = 1) -> Column:
    """An aggregate, times ``scale``: 0 if the weights sum to nothing. The sums are decimals, exact in any order, and divided once."""
    exact = F.sum(value.cast("decimal(10,4)") * weight.cast("decimal(6,2)")) * F.lit(scale).cast("decimal(3,0)")
    weights = F.sum(weight.cast("decimal(6,2)"))
    return F.coalesce(F.try_divide(exact.cast("double"), F.nullif(weights.cast("double"), F.lit(0.0))), F.lit(0.0))


def overall_score() -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted_mean(F.col("score"), F.col("weight"), 100))), 1)


def must_coverage(partial_credit: float = 0.5) -> Column:
    must = F.col("importance") == "must"
    got = F.sum(F.when(must & (F.col("status") == "met"), 1.0).when(must & (F.col("status") == "partial"), partial_credit).otherwise(0.0))
    return F.coalesce(F.round(F.least(F.lit(1.0), F.try_divide(got, F.nullif(F.count_if(must), F.lit(0)))), 4), F.lit(1.0))


def gated() -> Column:
    """An aggregate: whether a must is missing or contested."""
    return F.coalesce(F.bool_or((F.col("importance") == "must") & F.col("status").isin("missing", "contested")), F.lit(False))


def verdict(score: Column, coverage: Column, blocked: Column, gate: bool) -> Column:
    out = F.lit("weak")
    for name, least, floor in reversed(P.VERDICTS):
        fine = score >= least
        out = F.when(fine & (coverage >= floor) if gate else fine, name).otherwise(out)
    return F.when(blocked, "weak").otherwise(out) if gate else out


def best_first(items: Column) -> Column:
    """Outcomes by weight and score, both falling; equal ones keep the posting's order."""
    keyed = F.transform(items, lambda o: F.struct((-o["weight"]).alias("w"), (-o["score"]).alias("s"), o["req_pos"].alias("p"), o.alias("o")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(F.struct(a["w"], a["s"], a["p"]) < F.struct(b["w"], b["s"], b["p"]), -1).otherwise(1)), lambda k: k["o"])


def strengths(items: Column) -> Column:
    return F.slice(best_first(F.filter(items, lambda o: o["status"] == "met")), 1, P.STRENGTHS)


def in_order(items: Column) -> Column:
    return F.array_sort(items, lambda a, b: F.when(a["req_pos"] < b["req_pos"], -1).otherwise(1))


def suggestions(outcomes: Column, requirement_count: Column, longest: Column, total_years: Column, degraded: Column) -> Column:
    """At most twelve next steps, by kind: a thin posting, blockers, partial musts, contested others, degraded mode, no dates, preferred gaps."""
    pick = lambda test, most, text: F.transform(F.slice(F.filter(outcomes, test), 1, most), text)
    must = lambda o: o["importance"] == "must"
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    when = lambda test, line: F.when(test, F.array(line)).otherwise(F.array().cast("array<string>"))
    say = P.ADVICE
    every = F.concat(
        when(requirement_count == 0, F.lit(say["nothing read"])),
        when((requirement_count == 1) & (longest >= 80), text(say["one long"][0], longest.cast("string"), say["one long"][1])),
        pick(lambda o: must(o) & o["status"].isin("missing", "contested"), 1000, lambda o: text(say["blocker"][0], o["name"], say["blocker"][1])),
        pick(lambda o: must(o) & (o["status"] == "partial"), 3, lambda o: text(say["partial"][0], o["name"], say["partial"][1], F.coalesce(o["matched_proficiency"], F.lit("weak")), say["partial"][2])),
        pick(lambda o: ~must(o) & (o["status"] == "contested"), 3, lambda o: text(say["contested"][0], o["name"], say["contested"][1], F.format_string("%.2f", o["score"].cast("double")), say["contested"][2])),
        when(degraded, F.lit(say["degraded"])),
        when(F.coalesce(total_years == 0, F.lit(True)) & (requirement_count > 0), F.lit(say["no dates"])),
        pick(lambda o: (o["importance"] == "preferred") & (o["status"] == "missing"), 4, lambda o: text(say["preferred"][0], o["name"], say["preferred"][1])),
    )
    return F.slice(every, 1, P.SUGGESTIONS)


def reports(pairs: DataFrame, outcomes: DataFrame, profiles: DataFrame, postings: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """One row a pair: scores, verdict, ordered outcomes, blockers, strengths, suggestions and the configuration.

    ``postings``: doc_id, title, company, seniority, jd_extractor. ``profiles``: doc_id, total_years, highest_education, certifications, resume_extractor, degraded.
    """
    rows = outcomes.groupBy(*PAIR).agg(
        overall_score().alias("overall_score"), must_coverage(config.partial_credit).alias("must_have_coverage"), gated().alias("_blocked"),
        F.collect_list(F.struct(*OUTCOME)).alias("_all"), F.count(F.lit(1)).alias("n_requirements"), F.count_if(F.col("importance") == "must").alias("n_musts"), F.max(F.length("name")).alias("_longest"),
    )
    held = pairs.select(*PAIR).join(dealt(rows), PAIR, "left").join(dealt(profiles.select(F.col("doc_id").alias("resume_id"), "total_years", "highest_education", "certifications", "resume_extractor", "degraded")), "resume_id", "left").join(dealt(postings.withColumnRenamed("doc_id", "jd_id")), "jd_id", "left")
    kind = dict(rows.dtypes)["_all"]
    held = held.withColumns({
        "_all": F.coalesce("_all", F.array().cast(kind)), "overall_score": F.coalesce("overall_score", F.lit(0.0)), "must_have_coverage": F.coalesce("must_have_coverage", F.lit(1.0)),
        "_blocked": F.coalesce("_blocked", F.lit(False)), "n_requirements": F.coalesce("n_requirements", F.lit(0)), "n_musts": F.coalesce("n_musts", F.lit(0)), "_longest": F.coalesce("_longest", F.lit(0)),
    })
    inside = in_order(F.col("_all"))
    blockers = F.filter(inside, lambda o: (o["importance"] == "must") & o["status"].isin("missing", "contested"))
    settings = F.create_map(*(F.lit(x) for k, v in config.as_dict().items() for x in (k, v)))
    return held.select(
        *PAIR, "title", "company", "seniority", "overall_score", verdict(F.col("overall_score"), F.col("must_have_coverage"), F.col("_blocked"), config.must_have_gate).alias("verdict"), "must_have_coverage",
        "n_requirements", "n_musts", best_first(F.col("_all")).alias("outcomes"), (blockers if config.must_have_gate else F.array().cast(kind)).alias("blockers"),
        strengths(F.col("_all")).alias("strengths"),
        suggestions(inside, F.col("n_requirements"), F.col("_longest"), F.col("total_years"), F.coalesce("degraded", F.lit(True))).alias("suggestions"),
        "total_years", "highest_education", "certifications", "jd_extractor", "resume_extractor", F.coalesce("degraded", F.lit(True)).alias("degraded"), settings.alias("scoring_config"),
    )
