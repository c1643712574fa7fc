"""Findings with evidence: missing sections, vague lines, unsupported claims, redundant lines.

Every finding's evidence is text[start_off:end_off] of its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.tables import keep
from .lines import heading_section
from .statements import statement_class
from .vectors import pairwise


def missing_sections(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """doc_id, missing and found (arrays), evidence, start_off, end_off of documents that lack a section.

    The evidence is the stripped head of 80 characters. Where it is blank there
    is nothing to point at: those documents are in rejected_documents.
    """
    d = _section_gaps(docs, segs)
    return d.where((F.size("missing") > 0) & (F.col("evidence") != "")).select("doc_id", "missing", "found", "evidence", "start_off", "end_off")


def rejected_documents(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """doc_id of documents that lack a section and have a blank head."""
    d = _section_gaps(docs, segs)
    return d.where((F.size("missing") > 0) & (F.col("evidence") == "")).select("doc_id")


def _section_gaps(docs: DataFrame, segs: DataFrame) -> DataFrame:
    found = segs.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("found"))
    none = F.array().cast("array<string>")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found, "doc_id", "left").withColumn("found", F.coalesce("found", none))
    d = d.withColumn("missing", F.array_except(F.array(*[F.lit(s) for s in lx.SECTIONS]), "found"))
    head = F.substring("text", 1, 80)
    lead = (F.length(head) - F.length(tx.lstrip(head))).cast("int")
    return d.withColumn("evidence", tx.strip(head)).withColumn("start_off", lead).withColumn("end_off", (F.col("start_off") + F.length("evidence")).cast("int"))


def vague_bullets(lines: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, line_no, cue, confidence, segment, evidence, start_off, end_off of lines that tell a duty."""
    d = lines.where(tx.word_count(F.col("stripped")) >= min_words).withColumn("st", statement_class(F.col("stripped")))
    d = d.where(F.col("st.label") == "duty")
    return d.select(
        "doc_id", "line_no", F.coalesce(F.get("st.cues", F.lit(0)), F.lit("duty cue")).alias("cue"), "st.confidence", "segment",
        F.col("stripped").alias("evidence"), F.col("s_start").alias("start_off"), F.col("s_end").alias("end_off"),
    )


def claim_span(text: F.Column) -> F.Column:
    """(first, last): the span from the first claim phrase to the end of the one that starts last; null without one."""
    low = F.lower(text)
    spans = F.flatten(F.transform(tx.present(low, lx.CLAIMS), lambda c: F.transform(tx.occurrences(low, c), lambda s: F.struct(s.alias("s"), (s + F.length(c)).alias("e")))))
    return F.when(F.size(spans) > 0, F.struct(F.array_min(spans)["s"].alias("first"), F.array_max(spans)["e"].alias("last")))


def unsupported_claims(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, segment, confidence, evidence, start_off, end_off: claims of which no longer word is in an experience or education line.

    Lines that carry no claim are gone before the document's support text is
    joined on.
    """
    told = lines.where(F.col("segment").isin("experience", "education"))
    if "heading" not in lines.columns:
        told = heading_section(told)
    support = told.where(F.col("heading").isNull()).groupBy("doc_id").agg(F.array_join(F.collect_list(F.lower("stripped")), " ").alias("support"))
    d = lines.where(F.col("segment").isin("summary", "skills", "document", "other") & (tx.word_count(F.col("stripped")) >= 4) & tx.any_of(F.lower("stripped"), lx.CLAIMS))
    d = d.withColumn("span", claim_span(F.col("stripped"))).where(F.col("span").isNotNull())
    d = d.withColumn("claim", F.substring(F.col("stripped"), F.col("span.first") + 1, F.col("span.last") - F.col("span.first")))
    d = d.join(support, "doc_id", "left").withColumn("long", F.filter(tx.words(F.lower("claim")), lambda w: F.length(w) > 3))
    d = d.where(~F.exists("long", lambda w: F.contains(F.coalesce("support", F.lit("")), w)))
    start = (F.col("s_start") + F.col("span.first")).cast("int")
    return d.select("doc_id", "line_no", "segment", F.lit(0.6).alias("confidence"), F.col("claim").alias("evidence"), start.alias("start_off"), (start + F.length("claim")).cast("int").alias("end_off"))


def redundant_pairs(lines: DataFrame, threshold: float = 0.85, min_words: int = 4, same_segment: bool = False, vectors: str | None = None) -> DataFrame:
    """doc_id, line_a, line_b, score, evidence_a, evidence_b of lines whose content words mostly agree.

    Lines of one set of words are one class. A class's words are put in order,
    those of fewest classes in the document first, and two classes above the
    threshold share one of the first n - ceil(threshold * n) + 1 of them: on
    such words the classes' numbers meet, and only pairs that do bring their
    words together. With ``vectors``, a column of the lines, the score is the
    cosine of all pairs of a document's lines instead; lines without one pair
    with none.
    """
    w = F.array_sort(tx.content_words(F.col("stripped")))
    d = lines.withColumn("w", w).where(F.size("w") >= min_words)
    if vectors:
        scored = pairwise(d.where(F.col(vectors).isNotNull()), "doc_id", "line_no", vectors).where(F.col("score") >= threshold)
        return _with_evidence(scored.select("doc_id", F.col("a").alias("line_a"), F.col("b").alias("line_b"), "score"), d, same_segment)
    d = keep(d.select("doc_id", "line_no", "segment", "stripped", "w"), "line-words")
    by = ["doc_id", "segment"] if same_segment else ["doc_id"]
    c = d.groupBy(*by, "w").agg(F.sort_array(F.collect_list("line_no")).alias("own")).withColumn("c", F.col("own")[0])
    seen = Window.partitionBy(*by, "word")
    n = F.size("o")
    ordered = c.select(*by, "c", F.explode("w").alias("word")).withColumn("f", F.count("*").over(seen)).where("f > 1")
    ordered = ordered.groupBy(*by, "c").agg(F.sort_array(F.collect_list(F.struct("f", "word"))).alias("o"))
    # words of one class alone stand first and meet nothing: they take their part of the head
    sized = ordered.join(c.select(*by, "c", F.size("w").alias("n")), [*by, "c"])
    head = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - n)).cast("int")
    keyed = sized.where(head > 0).select(*by, "c", "n", F.explode(F.slice("o", F.lit(1), head)["word"]).alias("word"))
    a = keyed.select(*by, "word", F.col("c").alias("ca"), F.col("n").alias("na"))
    b = keyed.select(*by, "word", F.col("c").alias("cb"), F.col("n").alias("nb"))
    met = a.join(b, [*by, "word"]).where((F.col("ca") < F.col("cb")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9))
    met = met.select(*by, "ca", "cb").distinct()
    met = met.join(c.select(*by, F.col("c").alias("ca"), F.col("w").alias("wa"), F.col("own").alias("la")), [*by, "ca"])
    met = met.join(c.select(*by, F.col("c").alias("cb"), F.col("w").alias("wb"), F.col("own").alias("lb")), [*by, "cb"])
    met = met.withColumn("score", tx.jaccard(F.col("wa"), F.col("wb"))).where(F.col("score") >= threshold)
    across = met.select("doc_id", F.explode("la").alias("x"), "lb", "score").select("doc_id", "x", F.explode("lb").alias("y"), "score")
    within = c.where(F.size("own") > 1).select("doc_id", F.explode("own").alias("x"), "own", F.lit(1.0).alias("score"))
    within = within.select("doc_id", "x", F.explode(F.filter("own", lambda y: y > F.col("x"))).alias("y"), "score")
    pairs = across.unionByName(within).select("doc_id", F.least("x", "y").alias("line_a"), F.greatest("x", "y").alias("line_b"), "score")
    return _with_evidence(pairs, d, False)


def _with_evidence(pairs: DataFrame, d: DataFrame, same_segment: bool) -> DataFrame:
    text = d.select("doc_id", "line_no", "stripped", "segment")
    of = lambda x: text.select("doc_id", F.col("line_no").alias(f"line_{x}"), F.col("stripped").alias(f"evidence_{x}"), F.col("segment").alias(f"seg_{x}"))
    out = pairs.select("doc_id", "line_a", "line_b", F.round(F.least("score", F.lit(1.0)), 3).alias("score"))
    out = out.join(of("a"), ["doc_id", "line_a"]).join(of("b"), ["doc_id", "line_b"])
    if same_segment:
        out = out.where(F.col("seg_a") == F.col("seg_b"))
    return out.select("doc_id", "line_a", "line_b", "score", "evidence_a", "evidence_b")


def line_jaccard(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, score: how much a line's words agree with those of the line before."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    w = tx.content_words(F.col("stripped"))
    d = lines.select("doc_id", "line_no", w.alias("w")).withColumn("before", F.lag("w").over(order)).where(F.col("before").isNotNull())
    return d.select("doc_id", "line_no", F.round(tx.jaccard(F.col("before"), F.col("w")), 4).alias("score"))
