"""Lines, extraction, language, statements and findings on small documents."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import lexicon as lx
from gleaner.functions import text as tx
from gleaner.operators import extract, findings, language, lines, render, report, statements

CV = """Anna Miller
anna@mail.example.com | +62 812-3456-7890

SUMMARY
Excellent person with deep understanding of markets

SKILLS
Python, js, postgres, k8s; Used R for reports

EXPERIENCE
Data Analyst, Acme Corp
Jan 2020 - Present
- Responsible for various weekly reports and dashboards
- Reduced processing time by 35% for 1200 users
- Led the small data team every day
Barista di Kopi Kita: Feb 2021 - Sekarang

EDUCATION
Bachelor of Science in Statistics, GPA: 3.65
S1 Teknik Informatika, IPK 3,55
"""
ID = "Budi Santoso\n\nRINGKASAN\nSaya adalah analis yang bekerja dengan data\nPENGALAMAN KERJA\nStaf, Toko\n2018 - 2021\n- Membantu dalam pembuatan laporan bulanan kantor\n"
ODD = "A\r\nB\n\nC\x0bD\x0cE\x1cF\x1dG\x1eH\x85I J K 😀 é\rlast"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, CV), (2, ID), (3, ODD), (4, ""), (5, None), (6, "   \n \t\n"), (7, "line without a heading at all\n")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def own(docs):
    return lines.document_lines(docs).cache()


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.collect()


def test_lines_are_pythons(docs, own):
    for doc, text in ((1, CV), (2, ID), (3, ODD), (6, "   \n \t\n")):
        rows = sorted(one(own, doc_id=doc), key=lambda r: r.line_no)
        assert [r.text for r in rows] == text.splitlines(keepends=True)
        assert all(text[r.start_off : r.end_off] == r.text and text[r.s_start : r.s_end] == r.stripped == r.text.strip() for r in rows)
    assert own.where("doc_id IN (4, 5)").count() == 0


def test_headings_and_sections(own):
    got = {r.line_no: r.heading for r in one(own, doc_id=1) if r.heading}
    assert got == {4: "summary", 7: "skills", 10: "experience", 18: "education"}
    assert {r.line_no: r.segment for r in one(own, doc_id=2)} == {1: "other", 2: "other", 3: "summary", 4: "summary", 5: "experience", 6: "experience", 7: "experience", 8: "experience"}


@pytest.mark.parametrize(
    ("line", "section"),
    [("Work Experience:", "experience"), ("EXPERIENCES", "experience"), ("skills.", None), ("Skills 2", None), ("my\tskills", None), ("key skills and many other things", None), ("  Profil Singkat ", "summary")],
)
def test_heading_rules(spark, line, section):
    df = spark.createDataFrame([(1, 1, line)], "doc_id long, line_no int, text string")
    assert lines.heading_section(df).first().heading == section


def test_segments_cover_the_document(docs, own):
    segs = lines.segments(own)
    rows = sorted(one(segs, doc_id=1), key=lambda r: r.seg_no)
    assert [(r.name, r.heading) for r in rows] == [("other", None), ("summary", "SUMMARY"), ("skills", "SKILLS"), ("experience", "EXPERIENCE"), ("education", "EDUCATION")]
    assert rows[0].start_off == 0 and rows[-1].end_off == len(CV) and all(a.end_off == b.start_off for a, b in zip(rows, rows[1:]))
    assert [r.name for r in one(segs, doc_id=7)] == ["other"]


def test_skills(docs, own):
    mentions = extract.skill_mentions(docs)
    for m in one(mentions, doc_id=1):
        assert CV[m.start_off : m.end_off] == m.text
    kept = extract.skill_dedup(mentions)
    assert {m.canonical for m in one(kept, doc_id=1)} == {"Python", "JavaScript", "PostgreSQL", "Kubernetes", "R"}
    assert [m.text for m in one(kept, doc_id=1) if m.canonical == "R"] == ["R"]
    segs = lines.segments(own)
    assert {r.segment for r in one(lines.span_segment(kept, segs), doc_id=1)} == {"skills"}


def test_boundaries_and_overlaps(spark):
    df = spark.createDataFrame([(1, "reports C++ .NET Node.js react.js, sql server SQLite microsoft excel c# ts TS Ts")], "doc_id long, text string")
    got = sorted((m.canonical, m.text) for m in extract.skill_dedup(extract.skill_mentions(df)).collect())
    assert got == sorted([
        ("C++", "C++"), ("Node.js", "Node.js"), ("React", "react.js"), ("SQL", "sql"), ("SQL Server", "sql server"), ("SQLite", "SQLite"), ("Excel", "microsoft excel"),
        ("Microsoft Office", "microsoft excel"), ("C#", "c#"), ("TypeScript", "ts"), ("TypeScript", "TS"),
    ])


def test_ranges_and_entries(docs):
    assert sorted(r.text for r in one(extract.date_ranges(docs), doc_id=1)) == ["Feb 2021 - Sekarang", "Jan 2020 - Present"]
    rows = sorted(one(extract.experiences(docs), doc_id=1), key=lambda r: r.start_off)
    assert [(r.title, r.company, r.start_date, r.end_date) for r in rows] == [("Data Analyst", "Acme Corp", "2020", "present"), ("Barista", "Kopi Kita:", "2021", "present")] or [
        (r.title, r.company) for r in rows
    ] == [("Data Analyst", "Acme Corp"), ("Barista", "Kopi Kita")]
    assert all(CV[r.start_off : r.end_off] == r.text for r in rows)
    assert one(extract.experiences(docs), doc_id=2)[0].end_date == "2021"


def test_education(own):
    rows = sorted(one(extract.education(own), doc_id=1), key=lambda r: r.start_off)
    assert [(r.degree, r.field_of_study, r.gpa, r.institution) for r in rows] == [("Bachelor of Science in Statistics", None, "3.65", None), ("S1", None, "3.55", None)]


def test_entities(spark):
    text = "Acme Corp hired Ana Putri in May"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    tags = ["B-ORG", "I-ORG", "O", "I-PER", "B-PER", "I-ORG", "B-DATE"]
    spans = extract.word_spans(docs)
    tagged = spans.join(spark.createDataFrame(list(enumerate(tags, 1)), "word_no int, tag string"), "word_no")
    got = {(r.label, r.canonical) for r in extract.bio_spans(tagged, docs).collect()}
    assert got == {("org", "ACME CORP"), ("name", "PUTRI" if text.split()[4] == "Putri" else "ANA"), ("date", "MAY")}


def test_merging(spark):
    schema = "doc_id long, canonical string, text string, start_off int, end_off int"
    rules = spark.createDataFrame([(1, "Python", "python", 0, 6)], schema)
    model = spark.createDataFrame([(1, "Python", "Python 3", 3, 9), (1, "Python", "py", 20, 22), (1, "Go", "go", 0, 2), (2, "Python", "python", 0, 6)], schema)
    got = {(r.doc_id, r.canonical, r.start_off, r.extractor) for r in extract.merge_skills(rules, model).collect()}
    assert got == {(1, "Python", 0, "rules"), (1, "Python", 20, "rules+nlp"), (1, "Go", 0, "rules+nlp"), (2, "Python", 0, "rules+nlp")}


LABELLED = [
    ("Responsible for the design of the reports and the budget", "en"), ("This is the team that was led by our manager", "en"), ("Worked with the clients on their data", "en"),
    ("Mengembangkan aplikasi untuk perusahaan yang sedang tumbuh", "id"), ("Saya bekerja dengan tim dalam proyek ini", "id"), ("Bertanggung jawab atas laporan dan anggaran", "id"), ("12345 !!", "other"), ("", "other"),
]


def test_languages(spark):
    df = spark.createDataFrame(LABELLED, "stripped string, want string")
    got = language.line_languages(df).collect()
    short = [r for r in got if r.lang == r.want]
    assert len(short) >= 0.8 * len(LABELLED)
    with_detector = df.withColumn("scores", language.lang_scores(F.col("stripped"))).withColumn("d", F.lit("id")).withColumn("p", F.lit(0.99))
    rows = language.classify(with_detector, ("d", "p")).collect()
    assert {r.lang for r in rows if r.want == "en" and r.scores.n >= 8} == {"mixed"} and all(r.confidence <= 0.9 for r in rows if r.lang == "mixed")


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Reduced costs by 20% in one year", "achievement"), ("Built 350 pages", "achievement"), ("Responsible for reports", "duty"), ("Helped with testing", "duty"),
        ("Led the support group", "responsibility"), ("Wrote notes", "other"), ("top 5 of the class", "achievement"),
    ],
)
def test_statements(spark, text, label):
    row = spark.range(1).select(statements.statement_class(F.lit(text)).alias("s")).first().s
    assert row.label == label and 0 <= row.confidence <= 1
    if text.startswith("top"):
        assert spark.range(1).select(statements.statement_class(F.lit(text), strict_currency=True)["label"].alias("s")).first().s == "other"


def test_stems(spark):
    words = ["dashboards", "studies", "boxes", "using", "walked", "bed", "bus", "rate", "the", "used"]
    want = ["dashboard", "study", "box", "using", "walk", "bed", "bus", "rat", "the", "used"]
    df = spark.createDataFrame(list(zip(words, want)), "w string, want string")
    for r in df.select("w", "want", tx.light_stem(F.col("w")).alias("s")).collect():
        assert r.s == python_stem(r.w)


def python_stem(token):
    for suffix, put in (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ed", "")):
        if token.endswith(suffix) and len(token) - len(suffix) >= 3:
            token = token.removesuffix(suffix) + put
            break
    return token[:-1] if token.endswith("e") and len(token) >= 4 else token


def test_findings_are_grounded(docs, own):
    segs = lines.segments(own)
    texts = {1: CV, 2: ID, 3: ODD, 7: "line without a heading at all\n"}
    found = [findings.missing_sections(docs, segs), findings.vague_bullets(own), findings.unsupported_claims(own)]
    for df in found:
        rows = df.collect()
        assert rows and all(texts[r.doc_id][r.start_off : r.end_off] == r.evidence and r.evidence for r in rows)
    missing = {r.doc_id: r.missing for r in found[0].collect()}
    assert missing == {2: ["education", "skills"], 3: lx.SECTIONS, 7: lx.SECTIONS}
    assert {r.doc_id for r in findings.rejected_documents(docs, segs).collect()} == {4, 5, 6}
    assert {(r.doc_id, r.cue) for r in found[1].collect()} == {(1, "responsible for"), (2, "membantu")}
    assert [(r.doc_id, r.evidence) for r in found[2].collect()] == [(1, "Excellent person with deep understanding")]


def test_redundancy(spark):
    text = "\n".join(["prepared monthly sales dashboards for managers", "wrote code", "Prepares monthly sales dashboard for the manager", "wrote code", "a b c d e f g h i j k l m n o p q", "a b c d e f g h i j k l m n o p q r s t"])
    own = lines.document_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = {(r.line_a, r.line_b): r.score for r in findings.redundant_pairs(own).collect()}
    assert got[1, 3] == 1.0 and (2, 4) not in got
    words = lambda i: {python_stem(w) for w in text.split("\n")[i].split() if w not in lx.STOP_WORDS}
    exact = len(words(4) & words(5)) / len(words(4) | words(5))
    assert ((5, 6) in got) == (exact >= 0.85)


def test_messages_and_report(docs, own):
    out = report.all_findings(docs, own, lines.segments(own)).collect()
    assert {r.kind for r in out} >= {"missing_section", "vague_bullet", "unsupported_claim"} and all(r.message and r.message != r.kind for r in out)
    assert any(r.doc_id == 2 and r.lang == "id" and r.message.startswith("Baris") for r in out)
    rows = {r.doc_id: r for r in report.report(docs).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7} and rows[1].n_vague == 1 and rows[1].n_ranges == 2 and rows[5].n_lines == 0 and rows[2].lang == "id"


def test_unknown_kinds_keep_their_message(spark):
    df = spark.createDataFrame([("long_line", "as it was", "xx", "1", None)], "kind string, message string, lang string, line_no string, evidence string")
    for c in render.SLOTS:
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    assert render.render_messages(df).first().message == "as it was"
    assert render.render_messages(df.withColumn("kind", F.lit("vague_bullet"))).first().message == "as it was"


def test_highlight(spark):
    docs = spark.createDataFrame([(1, "a <b> & 'c' d"), (2, "plain"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 2, 4), (1, 4, 5), (1, 3, 4), (1, 8, 11)], "doc_id long, start_off int, end_off int")
    got = {r.doc_id: r.html for r in render.highlight_html(docs, spans).collect()}
    assert got == {1: "a <mark>&lt;b&gt;</mark> &amp; <mark>&#x27;c&#x27;</mark> d", 2: "plain", 3: ""}


def test_word_counts(spark):
    docs = spark.createDataFrame([(1, "js JavaScript javascript the r"), (2, "js ab abc")], "doc_id long, text string")
    assert {r.word: r.n for r in render.word_freq(docs).collect()} == {"javascript": 4, "r": 1, "abc": 1}
