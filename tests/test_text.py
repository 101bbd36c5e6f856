from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairlens.dims import DEFAULT, SkillDictionary, shown
from pairlens.functions import text as X


def each(spark, values, use, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", use(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm_key_agrees_with_its_python_form(spark):
    texts = ["Node . js", "C #", "C++ ", "Café Résumé", "ﬁne Ｆull", "a/b\ttest", "retrieval-augmented", "", "  ", ".NET core", "naïve #1", None]
    from pairlens.functions.text import norm_key_of

    assert each(spark, texts, X.norm_key) == [None if t is None else norm_key_of(t) for t in texts]


def test_names_resolve(spark):
    names = ["torch", "k8s", "csharp", "rest apis", "google clouds", "C #", "unobtainium", "", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    out = DEFAULT.with_canonical(rows, F.col("name")).orderBy("i").select("canonical", shown(F.col("name"), F.col("canonical")).alias("s")).collect()
    assert [r.canonical for r in out] == ["PyTorch", "Kubernetes", "C#", "REST API", "GCP", "C#", None, None, None]
    assert out[6].s == "Unobtainium"


def test_first_owner_of_an_alias_wins_and_forms_are_shared():
    own = SkillDictionary({"Vision": ["cv"], "Computer Vision": ["cv", "vision"]})
    assert dict(own.alias_rows()) == {"computer vision": "Computer Vision", "vision": "Vision", "cv": "Vision"}
    assert sorted(c for c, k, *_ in own.form_rows() if k == "vision") == ["Computer Vision", "Vision"]


def test_cues(spark):
    assert each(spark, ["SQL required", "SQL must", "SQL is a plus", "good to have: SQL, required", "SQL"], X.importance) == ["must", "must", "preferred", "nice_to_have", "preferred"]
    assert each(spark, ["expert in Python, 5+ years", "working knowledge", "familiar with it", "did it"], X.proficiency) == ["expert", "working", "exposed", "working"]
    assert each(spark, ["6+ years of SQL", "Three years of SQL", "eight plus years", "99 years", "none", None], X.years) == [6.0, 3.0, 8.0, None, None, None]
    assert each(spark, ["PhD", "MBA", "B.Tech", "Diploma", "none", None], X.degree_level) == [5, 4, 3, 2, 0, 0]
    assert each(spark, ["You will be the engineer", "Send me", "B.E Civil", "MBA"], X.asks_for_degree) == [False, False, True, True]


def test_phrases(spark):
    assert each(spark, ["- Develop dashboards required", "short"], X.requirement_phrase) == ["Develop dashboards", None]
    assert each(spark, ["**Responsibilities:** develop dashboards"], X.without_label) == ["develop dashboards"]
    assert each(spark, ["it works because it must", "SQL and Python", "One. Two. Three"], X.is_prose) == [True, False, True]
    assert each(spark, ["Requirements: SQL", "Disclosure decision: withheld the inputs, because of it", "plain"], X.is_labelled) == [True, False, False]
    assert each(spark, ["Python and CI/CD, A / B or full-stack"], X.compound_parts) == [["Python", "CI/CD", "A", "B", "full-stack"]]


def test_contacts_are_masked(spark):
    assert each(spark, ["me@x.org +91 82812 12657 https://github.com/x", None, ""], X.mask_contacts) == ["[email] [phone] [url]", None, ""]
    assert each(spark, ["Responsibilities and requirements", "a note"], X.looks_like_posting) == [True, False]


@pytest.mark.parametrize(
    ("text", "months"),
    [("06/2023 - 07/2024", 14), ("Jun 2023 - Jul 2024", 14), ("01/2026 - Present", 11), ("June 2023 - July 2024", 0), ("13/2023 - 01/2024", 0), ("06/2021 - Acme", 7)],
)
def test_date_ranges(spark, text, months):
    got = each(spark, [text], lambda v: X.date_ranges(v, (2026, 11)))[0]
    assert sum(r.finish - r.start + 1 for r in got) == months


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([1.0, 0.0], [-2.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(X.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.6, -1.0]
