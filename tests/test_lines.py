from __future__ import annotations


from pairlens.operators import lines as L
from pairlens.operators.extract import certification_parts, fragments, merged_intervals


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, raw_text string")


def test_lines_are_numbered_cleaned_and_capped(spark):
    rows = L.split_lines(docs(spark, "alpha\n\nbeta\r\n  gamma x­", None, "", " \n\t", "x" * 5000, "- one\n* two\n1. three\nplain\n-no")).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line_no, r.text, r.is_bullet) for r in rows if r.doc_id == 0] == [(0, 1, "alpha", False), (0, 2, "beta", False), (0, 3, "gamma x", False)]
    assert not [r for r in rows if r.doc_id in (1, 2, 3)]
    assert [len(r.text) for r in rows if r.doc_id == 4] == [2000]
    assert [r.is_bullet for r in rows if r.doc_id == 5] == [True, True, True, False, False]
    assert L.split_lines(docs(spark, "\n".join("ab" for _ in range(4100)))).count() == 4000
    assert L.read_lines(docs(spark, "\n".join("ab" for _ in range(4100))), most_lines=None).count() == 4100
    assert L.split_lines(docs(spark, "x" * 5000), most_chars=None).first().text == "x" * 5000


def test_sections_run_on(spark):
    rows = L.read_lines(docs(spark, "A NAME\nEXPERIENCE\nrole\nEducation:\ndegree\n- Skills\n## Skills\nlist")).orderBy("line_no").collect()
    assert [r.section for r in rows] == [None, "experience", "experience", "education", "education", "education", "skills", "skills"]


def test_context_stops_at_bullets_and_sections(spark):
    rows = spark.createDataFrame([(1, k, t, b, s) for k, (t, b, s) in enumerate([("a", True, "x"), ("b", False, "x"), ("c", False, "x"), ("d", False, "y"), ("e", True, "y")], 1)], "doc_id int, line_no int, text string, is_bullet boolean, section string")
    got = {r.line_no: r.context for r in L.clause_context(rows, 2).collect()}
    # line 1 goes forward once and finds nothing before it; line 2's step back meets a bullet
    assert got == {1: "a b", 2: "b c", 3: "c", 4: "d", 5: "e"}


def test_chunks_overlap(spark):
    rows = L.read_lines(docs(spark, "\n".join(f"l{k}" for k in range(1, 24)), "one"))
    got = [(r.doc_id, r.chunk_no, r.first_line, r.last_line) for r in L.chunks(rows, 10, 2).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(0, 0, 1, 10), (0, 1, 9, 18), (0, 2, 17, 23), (1, 0, 1, 1)]


def test_quotes_find_their_line(spark):
    rows = L.read_lines(docs(spark, "first\nSecond line here\nthird"))
    quotes = spark.createDataFrame([(0, 1, "second  LINE", None), (0, 2, "absent", 3), (0, 3, None, 9), (0, 4, None, None)], "doc_id int, quote_id int, quote string, line_hint int")
    got = {r.quote_id: r.evidence and r.evidence.line for r in L.resolve_quotes(quotes, rows).collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: None}


def test_intervals_merge(spark):
    ranges = spark.createDataFrame([("a", 1, 30), ("a", 13, 18), ("a", 25, 42), ("a", 43, 43), ("a", 50, 51), ("b", 1, 1)], "doc_id string, start int, finish int")
    assert sorted(tuple(r) for r in merged_intervals(ranges).collect()) == [("a", 1, 43), ("a", 50, 51), ("b", 1, 1)]


def test_certificates_and_fragments(spark):
    rows = L.read_lines(docs(spark, "CERTIFICATIONS\nIssued: Cloud architect, Scrum master\nab\nSKILLS\nSQL, Python / R\n12345"))
    assert [r.part for r in certification_parts(rows).orderBy("line_no", "part_no").collect()] == ["Cloud architect", "Scrum master"]
    assert [r.part for r in fragments(rows, "skills").orderBy("line_no", "part_no").collect()] == ["SQL", "Python"]


def test_empty_tables(spark):
    none = docs(spark, "x").where("false")
    assert L.chunks(L.read_lines(none)).count() == 0 and L.clause_context(L.read_lines(none), 3).count() == 0
