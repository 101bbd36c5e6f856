"""Reports as JSON rows, plain text or console text."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: What a verdict, an importance and a status are called.
VERDICTS = {"strong": "Strong match", "plausible": "Plausible match", "stretch": "Stretch", "weak": "Weak match"}
TAGS = {"must": "MUST", "preferred": "PREF", "nice_to_have": "NICE"}
MARKS = {"met": "MET", "partial": "PARTIAL", "contested": "CONTEST", "missing": "MISSING"}
RULE, WIDTH = "-" * 72, 72


def importance_tag(importance: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tag in TAGS.items():
        out = F.when(importance == name, tag).otherwise(out)
    return out


def as_json(reports: DataFrame) -> DataFrame:
    """(jd_id, resume_id, report): each report as one JSON object, ready for a text or JSON sink."""
    return reports.select("jd_id", "resume_id", F.to_json(F.struct("*")).alias("report"))


def write_json(reports: DataFrame, path: str) -> None:
    reports.write.mode("error").json(path)


def to_dict(report: Row) -> dict[str, Any]:
    return json.loads(json.dumps(report.asDict(recursive=True), default=str))


def heading(report: Row, between: str) -> str:
    return (report.title or "Untitled role") + (between + report.company if report.company else "")


def render_text(report: Row, top: int = 40) -> str:
    """One report as plain text with its first ``top`` requirements."""
    rows = [f"MATCH REPORT - {heading(report, ' at ')}", "=" * WIDTH]
    rows += [f"overall {report.overall_score:5.1f}/100   verdict: {VERDICTS[report.verdict]}", f"must-have coverage {report.must_have_coverage:.0%} ({report.n_musts} required items)   requirements assessed: {report.n_requirements}", f"extraction: jd={report.jd_extractor} resume={report.resume_extractor}"]
    rows += ["", "REQUIREMENT BREAKDOWN", RULE]
    for o in report.outcomes[:top]:
        source = f" [resume L{o.resume_evidence.line}]" if o.resume_evidence else ""
        rows.append(f"{TAGS[o.importance]:5} {o.status:9} {o.score:4.2f} w{float(o.weight):.2f}  {o.name}{source}")
        if o.matched_as and o.matched_as.lower() != o.name.lower():
            rows.append(f"        matched as: {o.matched_as} via {o.method}")
    if len(report.outcomes) > top:
        rows.append(f"... and {len(report.outcomes) - top} more")
    if report.blockers:
        rows += ["", "BLOCKERS (required and not evidenced)", RULE, *(f"  - {o.name}: {o.explanation}" for o in report.blockers)]
    rows += ["", "STRONGEST MATCHES", RULE, *(f"  + {o.name}" + (f" (resume L{o.resume_evidence.line})" if o.resume_evidence else "") for o in report.strengths[:6])]
    if report.suggestions:
        rows += ["", "WHAT TO DO NEXT", RULE, *(f"  {k}. {s}" for k, s in enumerate(report.suggestions, 1))]
    return "\n".join([*rows, "", f"scoring config: {dict(report.scoring_config)}"])


def render_console(report: Row, top: int = 30) -> str:
    """One report as an aligned table without colours."""
    level = f" ({report.seniority} level)" if report.seniority and report.seniority != "unknown" else ""
    rows = [f"{heading(report, ' - ')}{level}", f"{report.overall_score:.1f}/100   {VERDICTS[report.verdict]}   must-have coverage {report.must_have_coverage:.0%}   requirements assessed: {report.n_requirements}", ""]
    rows.append(f"{'':9}{'req':6}{'requirement':42}{'score':>6}  {'via':11}{'resume':>7}")
    for o in report.outcomes[:top]:
        rows.append(f"{MARKS[o.status]:9}{TAGS[o.importance]:6}{o.name[:41]:42}{o.score:6.2f}  {o.method:11}{f'L{o.resume_evidence.line}' if o.resume_evidence else '-':>7}")
    if len(report.outcomes) > top:
        rows.append(f"... and {len(report.outcomes) - top} more requirements")
    rows += [f"  x {o.name} - {o.explanation}" for o in report.blockers]
    rows += [f"  {k}. {s}" for k, s in enumerate(report.suggestions, 1)]
    return "\n".join(rows)


def render(report: Row, style: str = "console", top: int = 30) -> str:
    return (render_text if style == "text" else render_console)(report, top)
