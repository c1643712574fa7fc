"""Hooks for outside models, runs over them, and the column functions that place matches."""

import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import lexicon as lx
from gleaner.functions import text as tx
from gleaner.operators import extract, findings, language, lines, metrics, relevance, report, rewrite, vectors
from gleaner.sources.tables import Config

TEXT = "Siti Rahma\nsiti@mail.example.com\nSUMMARY\nExpert in Python with excellent communication skills\nSKILLS\nPython, React.js and react, r, R, machine learning\nEXPERIENCE\nAnalyst, Acme: Jan 2019 - Present\n- Responsible for various reports of the office\n- Responsible for the various reports of offices\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "x " * 5000 + "python")], "doc_id long, text string")


def test_places_of_many_matches(spark):
    texts = ["", None, "no", "aXbXX", "X", *("aé" * n + "X" * (n % 3) for n in range(60)), "abX" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", tx.matches(F.col("t"), F.lit("X+")).alias("m"), tx.starts(F.col("t"), "(?<!X)(?=(X))").alias("s"), tx.occurrences(F.coalesce("t", F.lit("")), F.lit("X")).alias("o")).collect()
    for row in got:
        t = texts[row.i] or ""
        assert [(m.match, m.start_off, m.end_off) for m in row.m] == [(m[0], m.start(), m.end()) for m in re.finditer("X+", t)]
        assert [(m.match, m.start_off) for m in row.s] == [("X", m.start()) for m in re.finditer("X+", t)]
        assert list(row.o) == [m.start() for m in re.finditer("X", t)]


def test_aliases_that_start_others(spark, docs):
    got = {(m.canonical, m.text, m.start_off) for m in extract.skill_mentions(docs.where("doc_id = 1")).collect()}
    for m in got:
        assert TEXT[m[2] : m[2] + len(m[1])] == m[1]
    assert {(c, t) for c, t, _ in got} >= {("React", "React.js"), ("React", "React"), ("React", "react"), ("R", "r"), ("R", "R"), ("Machine Learning", "machine learning"), ("Python", "Python")}
    want = set()
    for _, canonical, alias in lx.skill_rules():
        forms, flags = ([alias, alias.upper()], 0) if len(alias) <= 2 else ([alias], re.I | re.A)
        want |= {(canonical, m[0], m.start()) for f in forms for m in re.finditer(rf"(?<![A-Za-z0-9+#.]){re.escape(f)}(?![A-Za-z0-9+#])", TEXT, flags)}
    assert got == want


def test_redaction_of_a_head(spark):
    df = spark.createDataFrame([("\n  \nSiti Rahma\nx@y.example or +62 812-3456-7890",), ("1\n2\n3\n4\n5\nSiti Rahma",), ("",)], "t string")
    got = [r.r for r in df.select(tx.redact(F.col("t")).alias("r")).collect()]
    assert got[0].text == "\n  \n[NAME]\n[EMAIL] or [PHONE]" and (got[0].n_emails, got[0].n_phones, got[0].name) == (1, 1, True)
    assert got[1].text == "1\n2\n3\n4\n5\nSiti Rahma" and not got[1].name and got[2].text == ""


def test_redundancy_in_classes_and_by_vectors(spark):
    rows = [(1, i, "duty", s) for i, s in enumerate(["alpha beta gamma delta"] * 3 + ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta eta", "one two three four", "the the the"])]
    d = spark.createDataFrame(rows, "doc_id long, line_no int, segment string, stripped string").withColumn("v", F.array(F.lit(1.0), F.col("line_no").cast("double")))
    got = {(r.line_a, r.line_b): r.score for r in findings.redundant_pairs(d, threshold=0.8).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 1.0, (1, 2): 1.0, (0, 3): 0.8, (1, 3): 0.8, (2, 3): 0.8}
    near = {(r.line_a, r.line_b) for r in findings.redundant_pairs(d, threshold=0.99, vectors="v").collect()}
    assert (2, 3) not in near and (3, 4) in near and (4, 5) in near


def test_relevance_of_many_requirements_is_the_same(spark, docs, monkeypatch):
    own = lines.document_lines(docs)
    req = spark.createDataFrame([(1, 1, "reports of the office"), (1, 2, "Python communication skills")], "jd_id int, req_no int, requirement string")
    few = sorted(relevance.coverage(own, req).collect())
    monkeypatch.setattr(relevance, "BROADCAST_ROWS", 1)
    assert sorted(relevance.coverage(own, req).collect()) == few and few


def test_failing_models(spark, docs):
    def fail(_):
        raise RuntimeError("no model")

    spans = extract.word_spans(docs)
    assert extract.word_tags(spans, fail).where("tag != 'O'").count() == 0
    assert vectors.embed(docs, "text", fail).where("vector IS NOT NULL").count() == 0
    own = lines.document_lines(docs)
    assert sorted(r.lang for r in language.line_languages(own, fail).collect()) == sorted(r.lang for r in language.line_languages(own).collect())
    one = vectors.embed(docs, "text", lambda texts: [[3.0, 4.0]] * len(texts)).collect()
    assert {r.doc_id: r.vector for r in one} == {1: [0.6, 0.8], 2: None, 3: [0.6, 0.8], 4: [0.6, 0.8]}


def test_verifier_modes(spark):
    rows = spark.createDataFrame([("a", "m", "e", [1.0, 0.0], [1.0, 0.1]), ("a", "m", "e", [1.0, 0.0], [0.0, 1.0]), ("python reports", "python reports", "e", None, [1.0]), ("", "m", "e", [1.0], [1.0])], "sentence string, message string, evidence string, sentence_vector array<double>, material_vector array<double>")
    assert [(r.accepted, r.reason) for r in rewrite.verify(rows, "embedding").collect()] == [(True, "ok"), (False, "too far from the finding"), (True, "ok"), (False, "empty")]
    assert rows.select(rewrite.material(F.lit("me@x.example said"), F.lit(None).cast("string")).alias("m")).first().m == "[EMAIL] said "
    with pytest.raises(ValueError):
        rewrite.verify(rows, "magic")


def test_gates_of_rewriting(spark, docs):
    own = lines.document_lines(docs)
    numbered = rewrite.number_findings(report.all_findings(docs, own, lines.segments(own)))
    n = numbered.select("doc_id").distinct().count()
    on = Config(llm_enabled=True, llm_key="k")
    for config, respond, error in ((Config(), len, "rewriting is switched off"), (Config(llm_enabled=True), len, "no key is configured")):
        sentences, errors = rewrite.ask(numbered, respond, config)
        assert sentences.count() == 0 and [r.error for r in errors.collect()] == [error] * n
    sentences, errors = rewrite.ask(numbered, lambda p: "1. a sentence", on)
    assert sentences.count() == n and errors.count() == 0
    limits = docs.select("doc_id", F.lit(False).alias("allowed"), F.lit(3.0).alias("retry_after_s"))
    sentences, errors = rewrite.ask(numbered, lambda p: "1. a sentence", on, limits)
    assert sentences.count() == 0 and {r.error for r in errors.collect()} == {"limited: again in 3 s"}
    records = rewrite.faithfulness_records(numbered.drop("finding_no"), sentences, [1], per_doc=2)
    assert rewrite.faithfulness_run(records).first().asDict() == {"n_findings": 2, "n_accepted": 0, "n_rejected": 0, "n_fallback": 2, "acceptance_rate": 0.0}


def test_full_report(spark, docs):
    full = {r.doc_id: r for r in report.full_report(docs, run_id="run", config=Config(llm_key="secret")).collect()}
    assert set(full) == {1, 2, 3, 4} and full[1].meta.run_id == "run" and full[1].meta.config["llm_key"] == "***"
    kinds = [f.kind for f in full[1].findings]
    assert kinds == sorted(kinds, key=rewrite.KINDS.index) and {"missing_section", "vague_bullet", "redundant_pair"} <= set(kinds)
    for f in full[1].findings:
        for e in f.evidence:
            assert TEXT[e.start : e.end] == e.text and e.source_segment
    assert full[1].completeness["skills"] and not full[1].completeness["education"] and full[1].relevance is None
    assert {s.segment for s in full[1].extraction.skills} <= {"summary", "skills", "experience"} and full[2].findings == [] and full[1].extraction.extractor_name == "rules"
    summary = spark.createDataFrame([(1, 1, 4, "first", 0.9), (1, 2, 2, "second", 0.8)], "doc_id long, rank int, line_no int, sentence string, score double")
    assert report.full_report(docs, summary=summary).where("doc_id = 1").first().summary_sentences == ["first", "second"]


def test_corpus_rates(spark, docs):
    s = lambda rows: spark.createDataFrame(rows, "doc_id long, canonical string")
    got = metrics.corpus_sets(docs, s([(1, "A"), (1, "B"), (4, "A")]), s([(1, "A"), (3, "C")])).first()
    assert (got.n_docs, got.n_without, got.tp, got.fp, got.fn, got.precision, got.recall) == (4, 2, 1, 1, 1, 0.5, 0.5)
