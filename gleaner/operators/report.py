"""The whole analysis of a corpus: one row per document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.tables import Config, keep
from . import findings as fi
from . import lines as ln
from . import whole
from .extract import merge_skills, skill_hits
from .language import line_languages
from .relevance import few_requirements, relevance, relevance_summary
from .render import finding_rows, render_messages
from .statements import statement_class

VERSION = "0.2.0"


def all_findings(docs: DataFrame, lines: DataFrame, segs: DataFrame) -> DataFrame:
    """Findings of all kinds with rendered messages, in the shared shape plus lang."""
    parts = [
        finding_rows("missing_section", fi.missing_sections(docs, segs)),
        finding_rows("vague_bullet", fi.vague_bullets(lines)),
        finding_rows("redundant_pair", fi.redundant_pairs(lines).withColumn("start_off", F.lit(None).cast("int")).withColumn("end_off", F.lit(None).cast("int"))),
        finding_rows("unsupported_claim", fi.unsupported_claims(lines)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    langs = document_languages(lines).select("doc_id", "lang")
    return render_messages(out.join(langs, "doc_id", "left").withColumn("lang", F.coalesce("lang", F.lit("en"))))


def document_languages(lines: DataFrame) -> DataFrame:
    """doc_id, lang, n_en, n_id, n_mixed, n_other, in one aggregation."""
    d = line_languages(lines.where(F.col("stripped") != ""))
    n = d.groupBy("doc_id").agg(*[F.count_if(F.col("lang") == x).alias(f"n_{x}") for x in ("en", "id", "mixed", "other")])
    return n.withColumn("lang", F.when(F.col("n_id") > F.col("n_en"), "id").otherwise("en"))


def _line_figures(lines: DataFrame) -> DataFrame:
    """doc_id and all that the lines of a document tell by themselves, in one aggregation."""
    stripped, low = F.col("stripped"), F.lower("stripped")
    n_words = tx.word_count(stripped)
    vague = F.when(n_words >= 5, statement_class(stripped)["label"] == "duty").otherwise(F.lit(False))
    told = F.col("segment").isin("experience", "education") & F.col("heading").isNull()
    claims = F.col("segment").isin("summary", "skills", "document", "other") & (n_words >= 4) & tx.any_of(low, lx.CLAIMS)
    span = fi.claim_span(stripped)
    claimed = tx.let(span, lambda s: F.lower(F.substring(stripped, s["first"] + 1, s["last"] - s["first"])))
    d = lines.withColumn("_vague", vague).withColumn("_told", F.when(told, low)).withColumn("_claim", F.when(claims, F.filter(tx.words(claimed), lambda w: F.length(w) > 3)))
    labelled = line_languages(d.withColumn("_edu", F.col("text").rlike(lx.DEGREE) | F.col("text").rlike(lx.GPA)))
    said = lambda x: F.count_if((F.col("lang") == x) & (stripped != ""))
    out = labelled.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sort_array(F.collect_set("segment")).alias("found"), F.when(said("id") > said("en"), "id").otherwise("en").alias("lang"),
        F.count_if("_edu").alias("n_education"), F.count_if("_vague").alias("n_vague"), F.array_join(F.collect_list("_told"), " ").alias("_support"), F.collect_list("_claim").alias("_claims"),
    )
    free = F.filter("_claims", lambda c: ~F.exists(c, lambda w: F.contains(F.col("_support"), w)))
    return out.withColumn("n_unsupported", F.size(free)).drop("_support", "_claims")


def report(docs: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, sections, lang, skills, n_ranges, n_education, n_missing, n_vague, n_redundant, n_unsupported, n_matched.

    A digest of full_report: counts and names. sections and skills are joined
    names in order. n_matched is 0 without requirements. What a text or a line
    tells by itself is counted in one pass; everything is keyed by doc_id, so
    the parts join without a further order.
    """
    lines = keep(ln.document_lines(docs), "lines")
    canonicals = F.array_sort(F.array_distinct(skill_hits(F.col("text"))["canonical"]))
    head = tx.strip(F.substring(F.coalesce("text", F.lit("")), 1, 80)) != ""
    out = docs.select("doc_id", F.array_join(canonicals, ",").alias("skills"), F.size(tx.matches(F.col("text"), F.lit(lx.DATE_RANGE))).alias("n_ranges"), head.alias("_head"))
    out = out.join(_line_figures(lines), "doc_id", "left")
    gaps = F.size(F.array_except(F.array(*[F.lit(s) for s in lx.SECTIONS]), F.coalesce("found", F.array().cast("array<string>"))))
    out = out.withColumn("n_missing", ((gaps > 0) & F.col("_head")).cast("long"))
    out = out.join(fi.redundant_pairs(lines).groupBy("doc_id").agg(F.count("*").alias("n_redundant")), "doc_id", "left")
    if requirements is not None:
        out = out.join(relevance_summary(relevance(lines, requirements, texts=False)).groupBy("doc_id").agg(F.sum("n_matched").alias("n_matched")), "doc_id", "left")
    else:
        out = out.withColumn("n_matched", F.lit(0).cast("long"))
    numbers = ["n_lines", "n_ranges", "n_education", "n_missing", "n_vague", "n_redundant", "n_unsupported", "n_matched"]
    return out.select(
        "doc_id", F.coalesce(F.array_join("found", ","), F.lit("")).alias("sections"), F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("skills", F.lit("")).alias("skills"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
    )


def full_report(
    docs: DataFrame, requirements: DataFrame | None = None, config: Config | None = None, summary: DataFrame | None = None, nlp_skills: DataFrame | None = None, run_id: str | None = None
) -> DataFrame:
    """doc_id, summary_sentences, findings, extraction, completeness, relevance, meta: the whole report of each document, nested.

    ``summary`` (of summary_topk) and ``nlp_skills`` (of entity_skills) come
    from models, where there are any. findings are in the order of kinds, then
    of the text, each with its message and the spans that show it. relevance is
    null without requirements. meta holds the language, the lines' languages,
    the configuration without its key, the version and the run's id.
    """
    config = config or Config()
    few = requirements is not None and few_requirements(requirements)
    out = whole.parts(docs, requirements if few else None, config.relevance_threshold)
    if nlp_skills is not None:
        out = _with_model_skills(keep(out, "parts"), nlp_skills)
    if requirements is not None and not few:  # too many to go to every task
        areas = relevance(keep(ln.document_lines(docs), "lines"), requirements, config.relevance_threshold)
        area = F.struct("jd_id", "req_no", "requirement", "matched_text", "similarity", "matched")
        out = out.drop("relevance").join(areas.groupBy("doc_id").agg(F.sort_array(F.collect_list(area)).alias("relevance")), "doc_id", "left")
    extraction = F.struct("skills", "experiences", "education", F.lit("rules" if nlp_skills is None else "rules+nlp").alias("extractor_name"))
    have = F.col("segs.name")
    completeness = F.create_map(*[x for s in lx.SECTIONS for x in (F.lit(s), F.array_contains(have, s))])
    if summary is not None:
        told = F.transform(F.sort_array(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"])
        out = out.join(summary.groupBy("doc_id").agg(told.alias("summary_sentences")), "doc_id", "left")
    else:
        out = out.withColumn("summary_sentences", F.lit(None).cast("array<string>"))
    settings = F.create_map(*[x for k, v in config.redacted().items() for x in (F.lit(k), F.lit(str(v)))])
    mix = F.create_map(*[x for c in ("en", "id", "mixed", "other") for x in (F.lit(c), F.col(f"n_{c}"))])
    meta = F.struct(F.col("lang").alias("report_language"), mix.alias("lang_distribution"), settings.alias("config"), F.lit(VERSION).alias("version"), F.lit(run_id or uuid.uuid4().hex).alias("run_id"))
    return out.select(
        "doc_id", F.coalesce("summary_sentences", F.array().cast("array<string>")).alias("summary_sentences"), "findings", extraction.alias("extraction"), completeness.alias("completeness"), "relevance", meta.alias("meta"),
    )


def _with_model_skills(parts: DataFrame, nlp_skills: DataFrame) -> DataFrame:
    """``parts`` with a model's skills among the rules'."""
    segs = parts.select("doc_id", F.explode("segs").alias("s")).select("doc_id", "s.*")
    rules = parts.select("doc_id", F.explode("skills").alias("s")).select("doc_id", "s.canonical", "s.text", "s.start_off", "s.end_off")
    both = ln.span_segment(merge_skills(rules, nlp_skills), segs)
    listed = F.sort_array(F.collect_list(F.struct("start_off", "end_off", "canonical", "text", "extractor", "segment")))
    kind = "array<struct<start_off:int,end_off:int,canonical:string,text:string,extractor:string,segment:string>>"
    out = parts.drop("skills").join(both.groupBy("doc_id").agg(listed.alias("skills")), "doc_id", "left")
    return out.withColumn("skills", F.coalesce("skills", F.array().cast(kind)))


def report_json(reports: DataFrame) -> DataFrame:
    """doc_id, report: every column as one JSON text."""
    return reports.select("doc_id", F.to_json(F.struct(*reports.columns)).alias("report"))


