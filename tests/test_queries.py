from __future__ import annotations

import itertools
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from pairlens import case_queries, queries
from pairlens.operators import lines, match
from pairlens.plans import analyze as analyze_module
from pairlens.plans import evaluate as evaluate_module
from pairlens.plans import stages
from pairlens.plans.analyze import analyze, every_pair

SF = os.environ.get("PAIRLENS_TESTDATA", "/root/testdata/sf0.001")


def by_sql(name):
    con = duckdb.connect()
    for t in ("orders", "customer", "conversations", "part", "documents", "embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(queries.oracle_sql()[name])


def test_cascade_over_all_orders_equals_sql(spark):
    out, want = queries.queries()["cascade_match"](spark, SF), by_sql("cascade_match")
    assert out.columns == want.columns
    got = Counter(map(tuple, out.collect()))
    assert got == Counter(want.fetchall()) and max(r[2] for r in got) > 5 and all(r[0] != r[1] for r in got)


def test_quotes_of_all_turns_equal_sql(spark):
    out, want = queries.queries()["quote_lines"](spark, SF), by_sql("quote_lines")
    assert out.columns == want.columns and Counter(map(tuple, out.collect())) == Counter(want.fetchall())
    assert out.count() == queries.turns(spark, SF).count()


def rounded(row):
    return tuple(round(float(x), 6) if isinstance(x, float | Decimal) else x for x in row)


@pytest.mark.parametrize("name", [*case_queries.oracle_sql(), "clause_context_3", "employment_years", "outcome_order", "topk_strengths", "order_suggestions", "dictionary_hits", "section_ffill", "resume_skill_rows"])
def test_query_equals_sql(spark, name):
    out, want = queries.queries()[name](spark, SF), by_sql(name)
    assert sorted(out.columns) == sorted(want.columns)
    got = Counter(rounded(r[c] for c in want.columns) for r in out.collect())
    assert got and got == Counter(map(rounded, want.fetchall()))


def test_null_and_unmatched_quotes(spark):
    rows = spark.createDataFrame([(1, 1, "a first line here", None), (1, 2, "and a second line", None)], "doc_id long, line_no int, text string, section string")
    quotes = spark.createDataFrame([(1, 1, None, 2), (1, 2, "nowhere to be found", 1), (1, 3, "SECOND  line", 1), (2, 1, "a first", 1)], "doc_id long, quote_id int, quote string, line_hint int")
    got = {(r.doc_id, r.quote_id): r.evidence and r.evidence.line for r in lines.resolve_quotes(quotes, rows).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (1, 3): 2, (2, 1): None}


def test_analysis_reports_every_pair_of_the_table(spark):
    ids = [r.doc_id for r in queries.documents(spark, SF).select("doc_id").collect()]
    want = {(a, b) for a in ids for b in ids if a != b and a // 4 == b // 4}
    got = [(r.jd_id, r.resume_id) for r in queries.queries()["analysis_reports"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_analysis_of_one_posting_and_two_resumes(spark):
    many = lambda rows: spark.createDataFrame(rows, "doc_id string, raw_text string")
    postings, resumes = many([("p", queries.POSTING)]), many(queries.RESUMES)
    out = analyze(postings, resumes, (2026, 11), pairs=every_pair(postings, resumes)).reports
    got = {r.resume_id: r for r in out.collect()}
    assert set(got) == {"a", "b"} and got["a"].overall_score > got["b"].overall_score


def broadcast_files(plan):
    """The broadcasts of a plan, printed as a tree, that hold rows read from files."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.split("\n")]
    found = []
    for k, (deep, x) in enumerate(lines):
        if "BroadcastExchange" in x:
            below = list(itertools.takewhile(lambda y: y[0] > deep, lines[k + 1 :]))
            found += [x] if any("FileScan" in y for _, y in below) else []
    return found


@pytest.fixture
def plans(monkeypatch):
    """The plans that are written on the way, as they stand before they run."""
    held, write = [], stages.staged

    def noted(df, label):
        held.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    for module in (analyze_module, evaluate_module, match):
        monkeypatch.setattr(module, "staged", noted)
    return held


@pytest.mark.parametrize("name", ["cascade_match", "match_tiers", "case_evaluation", "case_summary"])
def test_nothing_that_grows_with_the_tables_is_broadcast(spark, plans, name):
    out = queries.queries()[name](spark, SF)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [x for p in plans for x in broadcast_files(p)]
    assert all("SortMergeJoin" in p for p in plans[-1:])
