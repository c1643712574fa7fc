"""The report that reads a document at once, against the operators on columns."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import extract, language, relevance, report, rewrite, whole
from gleaner.operators import lines as ln

POOL = [
    "", " \t", "SUMMARY:", "Professional Summary", "Skills::", "SKI\xa0LLS", "WORK EXPERIENCE", "\u00a0EDUCATION \u2003", "PENDIDIKAN", "Experience, 3", "one two three four five", "EXPERIENCE\tx", "Languages.",
    "Excellent communication and proven track record in delivering results", "An expert, expert and team player of detail-oriented work", "Pekerja keras dan cepat belajar di lingkungan baru", "fast learner",
    "- Responsible for various reports and handling customer data", "- Reduced processing time by 35 % for 1200 users", "Led several people who did some of the old work", "Built some of the many reports for $ 5", "improved it 2 times with 123 others today",
    "Designed and built the reports of this company", "Prepared monthly sales dashboards for regional managers", "- Prepares monthly sales dashboard for the regional manager", "prepared MONTHLY sales dashboards, for regional managers!",
    "Python, SQL server, JavaScript, react.js, node.js., .net c++ k8s C# r R", "golang/rust; ms excel html & css3 HTML5 (Swift) machine learning, ML", "\u212aafka python\u212a \u0130python komunikasi kerja tim", "restful rest apis REST api, rest", "r&d R. JS js_ ts2 TS",
    "Jan 2008 - Present", "Data Analyst, Acme Corp: Feb 2009 – Mar 2012; 2011 to 2013", "Staf Gudang di Tokoku | 03/2010 – 11/2011", "Lead - Umbrella Group 2014 until now", "Agu 2015 sampai Des 2016, x2008 - 2010", "September \t2012-2013 s.d. 2015", "12/2008-1/2009-2010", "2008 - 20101 2009 - 2011", "May 2010", "- 2010 -",
    "Bachelor of Science in Computer Science, GPA: 3.65", "S1 Teknik Informatika, IPK 3,55/4,0", "Ph.D. of Physics and B.S.c M.Eng", "Master's in Statistics", "gpa3 mba BAx D3", "café naïve \U0001f600 résumé of the many \U0001f600 things we did",
    "The engineer worked with the team on data for many of the products of this company", "Saya adalah lulusan terbaik yang menguasai analisis data dan pemrosesan bahasa alami dengan cermat", "the dan of atau in yang to di", "mengerjakan laporan pelaporan bermainan",
    "Ends of words: flies, dies, does, wishes, thing, bed, red, trees, eaten, are {evidence} {", "a\u0301b X\u0308 w\u2009o\u3000r d s", "1 2 3 4 5 + # ++ c+ #c",
]
ENDS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\u2028"]
JDS = [(1, 1, "Experience with Python and SQL data pipelines"), (1, 2, "monthly sales dashboards for managers"), (2, 1, "the of and"), (2, 2, "Menguasai analisis data"), (3, 1, None)]


def texts():
    r = random.Random(11)
    made = ["".join(r.choice(POOL) + r.choice(ENDS) for _ in range(n)) for n in [*range(1, 30), 60, 90]]
    return [*made, *(x + "\n" + y for x in POOL[31:41] for y in POOL[31:41]), *POOL, " \n", "\n\n", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(JDS, "jd_id int, req_no int, requirement string")


@pytest.fixture(scope="module")
def full(docs, asked):
    return {r.doc_id: r for r in report.full_report(docs, asked, run_id="r").collect()}


def by_doc(df, *cols):
    out = {}
    for r in df.select("doc_id", *cols).collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_extraction_is_that_of_the_columns(docs, full):
    own = ln.document_lines(docs)
    for kind, found in extract.rules_extraction(docs, own, ln.segments(own)).items():
        cols = [c for c in found.columns if c != "doc_id"]
        want = by_doc(found, *cols)
        assert {k: got for k, r in full.items() if (got := sorted((tuple(x[c] for c in cols) for x in r.extraction[kind]), key=repr))} == want
        assert all(r.extraction[kind] == sorted(r.extraction[kind], key=lambda x: [(v is not None, v) for v in x]) for r in full.values())


def test_findings_are_those_of_the_columns(docs, full):
    own = ln.document_lines(docs)
    found = rewrite.number_findings(report.all_findings(docs, own, ln.segments(own)), None)
    want = by_doc(found, "finding_no", "kind", "message", "confidence", "evidence", "evidence_b", "cue", "score", "missing", "found")
    tell = lambda f: (f.finding_no, f.kind, f.message, f.confidence, f.evidence[0].text, f.evidence[1].text if len(f.evidence) > 1 else None, *f.details)
    assert {k: sorted(map(tell, r.findings), key=repr) for k, r in full.items() if r.findings} == want
    assert {f.kind for r in full.values() for f in r.findings} == set(rewrite.KINDS)
    placed = {(r.doc_id, r.line_no): (r.stripped, r.s_start, r.s_end, r.segment) for r in own.collect()}
    for k, r in full.items():
        for e in (e for f in r.findings for e in f.evidence):
            assert texts()[k][e.start : e.end] == e.text
            assert e.line_number is None or (placed[k, e.line_number][3] == e.source_segment and e.text in placed[k, e.line_number][0])


def test_languages_sections_and_matches_are_those_of_the_columns(docs, asked, full):
    own = ln.document_lines(docs)
    langs = by_doc(report.document_languages(own), "lang", "n_en", "n_id", "n_mixed", "n_other")
    assert {k: (r.meta.report_language, *(r.meta.lang_distribution[x] for x in ("en", "id", "mixed", "other"))) for k, r in full.items()} == {k: langs.get(k, [("en", 0, 0, 0, 0)])[0] for k in full}
    names = by_doc(ln.segments(own), "name")
    assert {k: {s for s, there in r.completeness.items() if there} for k, r in full.items()} == {k: {x for (x,) in names.get(k, [])} - {"other"} for k in full}
    want = by_doc(relevance.relevance(own, asked), "jd_id", "req_no", "requirement", "matched_text", "similarity", "matched")
    assert {k: sorted(map(tuple, r.relevance), key=repr) for k, r in full.items() if r.relevance is not None} == want


def test_no_line_is_shuffled_or_written(spark, docs, asked, monkeypatch):
    monkeypatch.setattr(report, "keep", lambda *_: pytest.fail("written"))
    plan = report.full_report(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_more_requirements_than_a_task_is_given(docs, asked, full, monkeypatch):
    monkeypatch.setattr(relevance, "BROADCAST_ROWS", 2)
    assert {r.doc_id: r.relevance for r in report.full_report(docs, asked).select("doc_id", "relevance").collect()} == {k: r.relevance for k, r in full.items()}


def test_rows_without_an_id_or_with_one_id(spark):
    text = "Python\nResponsible for various reports and data\n"
    rows = report.full_report(spark.createDataFrame([(None, text), (1, text), (1, "Java")], "doc_id long, text string")).select("doc_id", F.size("findings").alias("n"), "extraction.skills.canonical", "relevance").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, [(None, 2, ["Python"], None), (1, 2, ["Python"], None), (1, 1, ["Java"], None)]))


def test_a_models_skills_join_the_rules(spark):
    docs = spark.createDataFrame([(1, "SKILLS\nPython and Rust\n"), (2, "none"), (3, "so")], "doc_id long, text string")
    more = spark.createDataFrame([(1, "Python", "Pyth", 7, 11), (1, "Go", "Rust", 18, 22), (3, "Go", "so", 0, 2)], "doc_id long, canonical string, text string, start_off int, end_off int")
    got = {r.doc_id: [(s.canonical, s.start_off, s.segment, s.extractor) for s in r.extraction.skills] for r in report.full_report(docs, nlp_skills=more).collect()}
    assert got == {1: [("Python", 7, "skills", "rules"), ("Go", 18, "skills", "rules+nlp"), ("Rust", 18, "skills", "rules")], 2: [], 3: [("Go", 0, "other", "rules+nlp")]}


def test_words_and_remembered_words(spark, monkeypatch):
    monkeypatch.setattr(whole, "REMEMBERED", 5)
    words = sorted({w for t in POOL for w in whole.WORD.findall(t.lower())})
    d = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.content_words(F.col("w")).alias("c"), language.lang_scores(F.col("w")).alias("s"))
    for r in d.collect():
        assert sorted(whole.content_words([r.w])) == r.c
    assert len(whole.STEMS) <= 5
