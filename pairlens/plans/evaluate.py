"""Evaluation over labelled cases: per-case results and one summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.dims import DEFAULT, SkillDictionary
from pairlens.functions import patterns as P
from pairlens.operators.match import MatchConfig
from pairlens.operators.model_output import label_keys
from pairlens.plans.analyze import analyze
from pairlens.plans.stages import dealt, staged


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F1, each 0 where undefined, to four places."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [F.round(precision, 4), F.round(recall, 4), F.round(f1, 4)]


def evaluate(cases: DataFrame, as_of: tuple[int, int], *, dictionary: SkillDictionary = DEFAULT, config: MatchConfig = MatchConfig(use_embeddings=False)) -> DataFrame:
    """One row a case: verdicts, score, counts of expected and found labels, and whether all evidence is where it says.

    ``cases``: id, jd_text, resume_text, expected_verdict, expected_matched, expected_missing.
    """
    postings = cases.select(F.col("id").alias("doc_id"), F.col("jd_text").alias("raw_text"))
    resumes = cases.select(F.col("id").alias("doc_id"), F.col("resume_text").alias("raw_text"))
    run = analyze(postings, resumes, as_of, pairs=cases.select(F.col("id").alias("jd_id"), F.col("id").alias("resume_id")), dictionary=dictionary, config=config)
    said = run.outcomes.select(F.col("jd_id").alias("id"), "name", F.when(F.col("status") == "missing", "missing").otherwise("matched").alias("side"), "resume_evidence")
    wanted = cases.select("id", F.explode("expected_matched").alias("name"), F.lit("matched").alias("side")).unionByName(cases.select("id", F.explode("expected_missing").alias("name"), F.lit("missing").alias("side")))
    every = said.select("id", "name").unionByName(wanted.select("id", "name")).distinct()
    keys = staged(label_keys(staged(every, "labels"), ["id", "name"], dictionary), "label-keys")
    got = said.join(dealt(keys), ["id", "name"]).select("id", "side", "name", "label_key").distinct()
    want = wanted.join(dealt(keys), ["id", "name"])
    met = want.join(dealt(got.select("id", "side", "label_key", F.lit(True).alias("_met")).distinct()), ["id", "side", "label_key"], "left")
    matched = F.col("side") == "matched"
    hits = met.groupBy("id").agg(
        F.count_if(matched & F.col("_met").isNotNull()).alias("tp"), F.count_if(matched & F.col("_met").isNull()).alias("fn"),
        F.count_if(~matched & F.col("_met").isNotNull()).alias("gap_tp"), F.count_if(~matched & F.col("_met").isNull()).alias("gap_fn"),
        F.array_sort(F.collect_list(F.when(matched & F.col("_met").isNull(), F.col("name")))).alias("unmatched_expected"),
    )
    extra = got.where(matched).join(dealt(want.select("id", "label_key").distinct()), ["id", "label_key"], "left_anti")
    extra = extra.groupBy("id").agg(F.count(F.lit(1)).alias("fp"), F.array_sort(F.collect_list("name")).alias("unexpected_matched"))
    cited = said.where((F.col("side") == "matched") & F.col("resume_evidence").isNotNull()).select("id", F.col("resume_evidence.line").alias("line_no"), F.col("resume_evidence.text").alias("_quote"))
    there = cited.join(dealt(run.resume_lines.select(F.col("doc_id").alias("id"), "line_no", "text")), ["id", "line_no"], "left")
    bad = there.groupBy("id").agg(F.count_if(~F.coalesce(F.col("text").contains(F.col("_quote")), F.lit(False))).alias("bad_evidence"))
    out = cases.select("id", "expected_verdict").join(dealt(run.reports.select(F.col("jd_id").alias("id"), F.col("verdict").alias("predicted_verdict"), "overall_score", "must_have_coverage")), "id", "left")
    for part in (hits, extra, bad):
        out = out.join(dealt(part), "id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("tp", "fn", "gap_tp", "gap_fn", "fp", "bad_evidence")} | {c: F.coalesce(c, empty) for c in ("unmatched_expected", "unexpected_matched")})


def grade(verdict: Column) -> Column:
    out = F.lit(-1)
    for name, value in P.VERDICT_ORDER.items():
        out = F.when(verdict == name, value).otherwise(out)
    return out


def summarize(results: DataFrame) -> DataFrame:
    """One row: quality of requirements and gaps, verdicts, evidence, mean score. Gaps have no false positives by definition."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "gap_tp", "gap_fn")]
    one = results.agg(
        F.count(F.lit(1)).alias("cases"), *sums, F.avg((F.col("predicted_verdict") == F.col("expected_verdict")).cast("double")).alias("exact"),
        F.avg((F.abs(grade(F.col("predicted_verdict")) - grade(F.col("expected_verdict"))) <= 1).cast("double")).alias("near"), F.avg((F.col("bad_evidence") == 0).cast("double")).alias("sound"), F.avg("overall_score").alias("mean"),
    )
    quality, gaps = prf(F.col("tp"), F.col("fp"), F.col("fn")), prf(F.col("gap_tp"), F.lit(0), F.col("gap_fn"))
    names = ("precision", "recall", "f1")
    return one.select(
        "cases", *(c.alias(n) for c, n in zip(quality, names)), *(c.alias(f"gap_{n}") for c, n in zip(gaps, names)), F.round("exact", 4).alias("verdict_exact"), F.round("near", 4).alias("verdict_within_one"),
        F.round("sound", 4).alias("evidence_accuracy"), F.round("mean", 2).alias("mean_score"),
    )


def format_results(results: DataFrame, summary: DataFrame) -> str:
    """Both as a plain table; the cases are few by nature."""
    rows = [f"{'case':32} {'expected':10} {'got':10} {'score':>6}  detail", "-" * 100]
    for r in results.orderBy("id").collect():
        detail = " ".join(f"{word}={value}" for word, value in (("missed", r.unmatched_expected), ("extra", r.unexpected_matched), ("bad_evidence", r.bad_evidence)) if value)
        rows.append(f"{r.id:32} {r.expected_verdict:10} {r.predicted_verdict:10} {r.overall_score:6.1f}  {detail or 'ok'}")
    s = summary.first()
    rows += [
        "-" * 100, f"cases={s.cases} mean_score={s.mean_score}", f"requirement  P={s.precision:.3f} R={s.recall:.3f} F1={s.f1:.3f}", f"verdict      exact={s.verdict_exact:.1%} within_one={s.verdict_within_one:.1%}",
        f"gap detection P={s.gap_precision:.3f} R={s.gap_recall:.3f} F1={s.gap_f1:.3f}", f"evidence accuracy={s.evidence_accuracy:.1%}",
    ]
    return "\n".join(rows)
