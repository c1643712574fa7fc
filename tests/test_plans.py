"""Queries over whole texts, by brute force; the SQL reads less of them."""

import pytest

from gleaner.plans import corpus, queries

LATER = "first line\nMar 2011 - Apr 2012 with Kubernetes\nmail far.away@deep.example.org today\nprepared quarterly stock summaries for auditors\nprepared quarterly stock summary for the auditor"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, LATER if i % 2 else None) for i in range(1, 24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_corpus_ends_with_the_whole_text(spark, sf):
    texts = {r.doc_id: r.text for r in corpus.cv_corpus(spark, sf).collect()}
    assert len(texts) == 23 and all(t.replace("\r", "").rstrip("\n").endswith(LATER) for k, t in texts.items() if k % 2)
    got = {}
    for r in rows(spark, sf, "line_sections"):
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: len(t.splitlines()) for k, t in texts.items()}


def test_later_lines_are_analysed(spark, sf):
    odd = set(range(1, 24, 2))
    texts = {r.doc_id: r.text for r in corpus.cv_corpus(spark, sf).collect()}
    dates = [r for r in rows(spark, sf, "date_ranges") if r.text == "Mar 2011 - Apr 2012"]
    skills = [r for r in rows(spark, sf, "skill_mentions") if r.text == "Kubernetes"]
    assert {r.doc_id for r in dates} >= odd and {r.doc_id for r in skills} == odd
    assert all(texts[r.doc_id][r.start_off : r.end_off] == r.text for r in dates + skills)
    assert {r.doc_id for r in rows(spark, sf, "redundant_pairs") if "quarterly" in r.evidence_a} == odd
    assert all("deep.example.org" not in r.redacted for r in rows(spark, sf, "redact_text"))
    assert {r.word: r.n for r in rows(spark, sf, "word_freq")}["quarterly"] == 2 * len(odd)


def test_whole_texts_are_decoded(spark, tmp_path):
    long = "a" * 50 + " é 😀 и\n" * 900
    texts = {1: long, 2: "short", 3: long, 4: None, 5: "", 6: None, 9: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {k: t if k % 3 else ((t or "").encode() + b"\xe9\xe8").decode("latin-1") for k, t in texts.items()}
    assert {r.doc_id: r.text for r in rows(spark, str(tmp_path), "text_decode")} == want


def test_findings_of_all_kinds_are_rewritten(spark, sf):
    kinds = ["missing_section", "vague_bullet", "redundant_pair", "unsupported_claim"]
    own = {}
    for r in queries._findings(spark, sf).collect():
        own.setdefault(r.doc_id, []).append((kinds.index(r.kind), r.start_off or 0, int(r.line_a or 0), int(r.line_b or 0), r.message))
    want = {(d, i, m[-1]) for d, found in own.items() for i, m in enumerate(sorted(found)[:10], 1)}
    numbered = queries._numbered(spark, sf).collect()
    assert {(r.doc_id, r.finding_no, r.message) for r in numbered} == want and {r.kind for r in numbered} == set(kinds)
    prompts = {r.doc_id: r for r in rows(spark, sf, "llm_prompt")}
    assert {d: r.n_findings for d, r in prompts.items()} == {d: min(10, len(found)) for d, found in own.items()}
    for name in ("parse_numbered", "verify_keyword", "rewrite_findings"):
        assert {(r.doc_id, r.finding_no) for r in rows(spark, sf, name)} == {x[:2] for x in want}
    assert rows(spark, sf, "faithfulness")[0].n == len(want)
