from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pairlens import cli
from pairlens.dims import DEFAULT
from pairlens.operators import extract, match, model_output
from pairlens.operators.lines import read_lines
from pairlens.operators.match import MatchConfig
from pairlens.plans.analyze import analyze, every_pair
from pairlens.plans.evaluate import evaluate, summarize
from pairlens.report import as_json, render, to_dict
from pairlens.sources.documents import read_cases, read_files, read_requests, read_texts

AS_OF = (2026, 11)


def run(spark, posting, resume, **options):
    one = lambda t: spark.createDataFrame([("d", t)], "doc_id string, raw_text string")
    return analyze(one(posting), one(resume), AS_OF, pairs=every_pair(one(posting), one(resume)), **options)


@pytest.fixture(scope="module")
def knockout(spark):
    return run(spark, "Platform Engineer\nRequirements:\n- Kubernetes required\n- Docker preferred\n- SQL preferred\n- Git preferred", "SKILLS\nDocker, SQL, Git")


def test_a_missing_must_caps_the_verdict(knockout):
    report = knockout.reports.first()
    assert (report.overall_score, report.verdict, report.must_have_coverage) == (57.4, "weak", 0.0)
    assert [o.name for o in report.blockers] == ["Kubernetes"]
    assert report.suggestions[0].startswith("Blocker: 'Kubernetes'") and len(report.strengths) == 3


def test_reports_render(knockout):
    report = knockout.reports.first()
    for style in ("text", "console"):
        assert "Kubernetes" in render(report, style, 2) and "more" in render(report, style, 2)
    assert to_dict(report)["verdict"] == "weak" == json.loads(as_json(knockout.reports).first().report)["verdict"]


def test_years_and_bridges_and_corroboration(spark):
    posting = "Data Analyst\nRequirements:\n- 8+ years of SQL required\n- CI/CD experience required\n- Tableau preferred\n- Bachelor degree in Statistics required"
    resume = "EXPERIENCE\nAnalyst | 01/2020 - 12/2022\n- One year of SQL and dashboards\n- Ran Jenkins\nEDUCATION\nB.Tech Computing\nSKILLS\nSQL, Jenkins"
    got = {o.name: o for o in run(spark, posting, resume).outcomes.collect()}
    assert got["SQL"].status == "partial" and got["SQL"].score == 0.4
    assert (got["CI/CD"].status, got["CI/CD"].score, got["CI/CD"].similarity) == ("contested", 0.55, 0.55)
    assert got["Tableau"].status == "missing"
    assert got["Bachelor degree in Statistics"].status == "met"


def test_nearest_vectors_serve_unknown_names(spark):
    def encode(text):  # a stand-in encoder: two words count as close
        return F.when(F.lower(text).rlike("weav|loom"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))

    posting = "Artisan\nRequirements:\n- Experience with loom weaving patterns required"
    resume = "CERTIFICATIONS\nMaster weaver"
    config = MatchConfig(encode=encode)
    got = [o for o in run(spark, posting, resume, config=config).outcomes.collect()]
    assert [(o.method, o.matched_as, o.status) for o in got] == [("embedding", "Master weaver", "met")]
    assert run(spark, posting, resume).outcomes.first().status == "missing"


def test_dedupe_keeps_the_right_row(spark):
    rows = [("d", 1, "SQL", "preferred"), ("d", 2, " sql ", "must"), ("d", 3, "Git", "must"), ("d", 4, "git", "preferred"), ("d", 5, "SQL", "must")]
    df = spark.createDataFrame(rows, "doc_id string, req_pos int, name string, importance string").withColumns({"category": F.lit("skill"), "min_years": F.col("req_pos").cast("double"), "evidence": F.lit(None).cast("struct<text:string,line:int,section:string>")})
    got = sorted((r.req_pos, r.name, r.importance, r.min_years) for r in extract.distinct_requirements(df).collect())
    assert got == [(1, "SQL", "must", 5.0), (3, "Git", "must", 3.0)]


def test_model_output_is_repaired(spark):
    lines = read_lines(spark.createDataFrame([("d", "Lead Engineer\n- K8s administration required\n- Advanced SQL, eight plus years\n- Python is a plus")], "doc_id string, raw_text string"))
    said = 'Sure: {"title": "Lead", "requirements": [{"name": "K8s administration", "importance": "must", "min_years": 2, "evidence": {"text": "k8s administration", "line": 9}}, {"name": "Advanced SQL", "importance": "must", "min_years": 4, "evidence": {"line": 3}}, {"name": "k8s"}, {"name": " "}]} trailing }'
    generate = lambda chunks: chunks.select("doc_id", "chunk_no", F.lit(said).alias("raw"))
    needs, facts = model_output.model_requirements(lines, generate, DEFAULT)
    got = sorted(((r.name, r.min_years, r.evidence.line if r.evidence else None) for r in needs.collect()), key=str)
    assert got == [("Kubernetes", None, 2), ("Kubernetes", None, None), ("SQL", 8.0, 3)]
    assert facts.first().title == "Lead" and not facts.first().degraded
    merged = model_output.merge_requirements(needs, extract.requirements(lines, DEFAULT), DEFAULT)
    assert sorted(r.name for r in merged.collect()) == ["Kubernetes", "Python", "SQL"]
    bad, facts = model_output.model_requirements(lines, lambda c: c.select("doc_id", "chunk_no", F.lit('{"a": ').alias("raw")), DEFAULT)
    assert bad.count() == 0 and facts.first().degraded


def test_backends(spark):
    posting, resume = "Lead Engineer\n- K8s administration required\n- Python is a plus", "SKILLS\nPython, SQL"
    said = {
        "requirements": '{"title": "Head", "company": "Acme", "requirements": [{"name": "Beekeeping", "category": "skill", "importance": "must", "evidence": {"text": "K8s administration", "line": 2}}]}',
        "skills": '{"skills": [{"name": "beekeeping", "category": "certification", "proficiency": "expert", "evidence": {"text": "Python, SQL", "line": 2}}]}',
    }
    asked = []

    def generate(chunks, broken=False):
        row = chunks.first()
        asked.append((row.system, row.prompt, json.loads(row.schema)))
        side = "requirements" if "requirements" in row.schema else "skills"
        return chunks.select("doc_id", "chunk_no", F.lit('{"x": ' if broken else said[side]).alias("raw"))

    report = run(spark, posting, resume, generate=generate).reports.first()
    assert (report.title, report.company, report.jd_extractor, report.resume_extractor, report.degraded) == ("Head", "Acme", "model", "model", False)
    assert {o.name: o.status for o in report.outcomes}["Beekeeping"] == "met" and report.certifications == ["beekeeping"]
    assert not any("degraded" in s for s in report.suggestions) and "at Acme" in render(report, "text") and "jd=model resume=model" in render(report, "text")
    assert len(asked) == 2 and all("2: " in prompt and schema["type"] == "object" for _, prompt, schema in asked)
    for options in ({}, {"backend": "rules", "generate": generate}, {"backend": "llm", "generate": lambda c: generate(c, True)}):
        report = run(spark, posting, resume, **options).reports.first()
        assert (report.title, report.company, report.jd_extractor, report.resume_extractor, report.degraded) == ("Lead Engineer", None, "rules", "rules", True)
        assert any("degraded" in s for s in report.suggestions) and {o.name for o in report.outcomes} == {"Kubernetes", "Python"}


def test_partial_credit_counts_in_the_coverage(spark):
    posting, resume = "Analyst\nRequirements:\n- 8+ years of SQL required", "SKILLS\nOne year of SQL"
    coverage = lambda credit: run(spark, posting, resume, config=MatchConfig(partial_credit=credit)).reports.first().must_have_coverage
    assert [coverage(x) for x in (0.0, 0.5, 1.0)] == [0.0, 0.5, 1.0]


@pytest.mark.parametrize(("name", "reduced"), [("K8s administration", "Kubernetes"), ("Advanced SQL", "SQL"), ("4+ years building dashboards in Power BI", "Power BI"), ("CI/CD pipelines", "CI/CD"), ("Stakeholder management", "Communication"), ("Beekeeping", "Beekeeping")])
def test_names_reduce(spark, name, reduced):
    rows = spark.createDataFrame([(1, name)], "k int, name string")
    assert model_output.canonical_names(rows, ["k"], DEFAULT).first().reduced == reduced


def test_evaluation(spark, tmp_path):
    cases = {"cases": [{"id": "one", "jd_text": "Analyst\nRequirements:\n- SQL required\n- Tableau required", "resume_text": "SKILLS\nSQL", "expected_verdict": "weak", "expected_matched": ["SQL"], "expected_missing": ["Tableau"]}]}
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    results = evaluate(read_cases(spark, str(tmp_path / "cases.json")), AS_OF)
    summary = summarize(results).first()
    assert (summary.precision, summary.recall, summary.gap_f1, summary.verdict_exact, summary.evidence_accuracy) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "c.txt").write_text(" \n ")
    (tmp_path / "d.docx").write_bytes(b"broken")
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    text = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{text('Title')}{text(' ')}<w:tbl><w:tr><w:tc>{text('x')}</w:tc><w:tc>{text('y')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    good, bad = read_files(spark, str(tmp_path))
    assert {r.path.rsplit("/")[-1]: r.raw_text for r in good.collect()} == {"a.txt": "café", "b.md": "hello", "e.docx": "Title\nx | y"}
    assert sorted(r.path.rsplit("/")[-1] for r in bad.collect()) == ["c.txt", "d.docx"]
    fine, rejected = read_texts(spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "i int, t string"), "i", "t")
    assert (fine.count(), rejected.count()) == (1, 2)
    bodies = spark.createDataFrame([(1, '{"jd": "a", "resume": "b", "top": 900}'), (2, "no"), (3, '{"jd": " ", "resume": "b"}')], "request_id int, body string")
    fine, rejected = read_requests(bodies)
    assert [r.top for r in fine.collect()] == [200] and rejected.count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "jd.txt").write_text("Analyst\nRequirements:\n- SQL required\n- Tableau required")
    (tmp_path / "cv.txt").write_text("SKILLS\nSQL")
    args = ["--jd", str(tmp_path / "jd.txt"), "--resume", str(tmp_path / "cv.txt"), "--as-of", "2026-11", "--json", str(tmp_path / "out.json"), "--style", "text"]
    assert cli.main(args, spark) == cli.BLOCKED
    assert "Tableau" in capsys.readouterr().out and json.loads((tmp_path / "out.json").read_text())["verdict"] == "weak"
    assert cli.main(["--jd-text", "x", "--resume", str(tmp_path / "none")], spark) == cli.USAGE
    assert cli.main([*args, "--no-must-have-gate", "--quiet"], spark) == cli.OK


def test_stream(spark, tmp_path):
    from pairlens.streaming.matching import match_stream, stream_texts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cv.txt").write_text("SKILLS\nSQL")
    posting = spark.createDataFrame([("p", "Analyst\nRequirements:\n- SQL required")], "doc_id string, raw_text string")
    got = []
    query = match_stream(posting, stream_texts(spark, str(tmp_path / "in")), AS_OF, lambda reports, n: got.extend(r.verdict for r in reports.collect()), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert got == ["strong"]


def test_years_score(spark):
    row = spark.range(1).select(*(match.years_score(F.lit(8.0), F.lit(a).cast("double"), 1.0).alias(f"y{i}") for i, a in enumerate((None, 1.0, 6.0, 9.0)))).first()
    assert [round(x, 4) for x in row] == [0.85, 0.4, 0.6, 1.0]
