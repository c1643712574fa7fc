"""One query per operator, over the driver's tables or the corpus made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import extract, findings, language, lines, metrics, privacy, relevance, render, report, rewrite, statements, vectors
from ..sources import tables, uploads
from ..streaming import limiter
from .corpus import cv_corpus, requirements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.document_lines(cv_corpus(spark, sf))


def _segs(spark: SparkSession, sf: str) -> DataFrame:
    return lines.segments(_lines(spark, sf))


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return extract.skill_dedup(extract.skill_mentions(cv_corpus(spark, sf)))


def _joined(array: str, by: str = "; ") -> F.Column:
    return F.array_join(array, by)


# sources and sinks


@query
def scan_text(spark, sf):
    return uploads.scan_text(_docs(spark, sf), max_mb=0.01)


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Files made of documents: ten endings and heads by doc_id."""
    d = _docs(spark, sf)
    ending = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".md", ".pdf", ".pdf", ".docx", ".exe", "", ".TXT", ".docx", ".txt")]), (F.col("doc_id") % 10 + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(x) for x in ("", "", "%PDF-1.7 ", "", "PK", "", "", "%PDF-", "", "PK")]), (F.col("doc_id") % 10 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.concat(head, F.coalesce("text", F.lit(""))))
    content = F.encode(text, "UTF-8")
    return d.select(F.concat(F.lit("in/f"), F.col("doc_id").cast("string"), ending).alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))


@query
def validate_upload(spark, sf):
    out = uploads.validate_uploads(_uploads(spark, sf), max_mb=0.01, zips=False)
    return out.select("path", "ok", "kind", _joined("errors").alias("errors"), "size")


@query
def scan_binary(spark, sf):
    files = _uploads(spark, sf)
    valid = files.join(uploads.validate_uploads(files).where("ok").select("path", "kind"), "path")
    return uploads.parse_uploads(valid)


@query
def text_decode(spark, sf):
    """Whole texts; every third has bytes behind it that are not UTF-8."""
    whole, bad = F.encode(F.col("text"), "UTF-8"), F.unhex(F.lit("E9E8"))
    d = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce(whole, F.unhex(F.lit(""))), bad)).otherwise(whole).alias("content"))
    return d.select("doc_id", uploads.decode(F.col("content")).alias("text"))


@query
def scan_resume_csv(spark, sf):
    path = tables.scratch(spark, "resume-csv")
    d = cv_corpus(spark, sf).select(F.col("doc_id").cast("string").alias("ID"), F.concat(F.lit("C"), F.col("doc_id") % 5).alias("Category"), F.col("text").alias("Resume_str"))
    d.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_resume_csv(spark, path).select("cv_id", "category", F.length(F.regexp_replace("text", "[\r\n]+", " ")).alias("n_chars"))


@query
def scan_gold(spark, sf):
    path = tables.scratch(spark, "gold")
    skills = _mentions(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("canonical", F.col("start_off").alias("start"), F.col("end_off").alias("end"))).alias("skills"))
    skills.select(F.col("doc_id").cast("string").alias("cv_id"), "skills").write.json(path)
    gold = tables.read_gold(spark, path + "/*.json", cv_corpus(spark, sf).select(F.col("doc_id").cast("string").alias("cv_id"), "text"), one_array=False)
    return gold.select("cv_id", "has_text", F.size("skills").alias("n_skills"))


@query
def gold_scaffold(spark, sf):
    sample = metrics.sample_docs(cv_corpus(spark, sf), 30).select(F.col("doc_id").cast("string").alias("cv_id"), F.lit("cv").alias("category"), "text")
    out = tables.gold_scaffold(sample)
    return out.select("cv_id", "category", "text_file", F.length("text").alias("n_chars"), F.size("skills").alias("n_skills"), F.size("education").alias("n_education"), "notes")


@query
def report_json(spark, sf):
    return report.report_json(report.report(cv_corpus(spark, sf))).select("doc_id", F.get_json_object("report", "$.sections").alias("sections"), F.get_json_object("report", "$.n_lines").cast("long").alias("n_lines"))


# lines


@query
def line_offsets(spark, sf):
    return lines.line_offsets(_docs(spark, sf))


@query
def line_stripped(spark, sf):
    return lines.line_stripped(lines.line_offsets(cv_corpus(spark, sf))).select("doc_id", "line_no", "stripped", "s_start", "s_end")


@query
def heading_lines(spark, sf):
    return lines.heading_section(lines.line_offsets(cv_corpus(spark, sf))).where("heading IS NOT NULL").select("doc_id", "line_no", "heading")


@query
def line_sections(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", "segment")


@query
def segments(spark, sf):
    return _segs(spark, sf)


@query
def bullet_lines(spark, sf):
    return _lines(spark, sf).where(lines.is_bullet_line(F.col("text"))).select("doc_id", "line_no")


@query
def span_segment(spark, sf):
    return lines.span_segment(_mentions(spark, sf), _segs(spark, sf)).select("doc_id", "canonical", "start_off", "end_off", "segment")


# extraction


@query
def skill_mentions(spark, sf):
    return extract.skill_mentions(cv_corpus(spark, sf))


@query
def skill_dedup(spark, sf):
    return _mentions(spark, sf)


@query
def skill_set(spark, sf):
    return extract.skill_set(_mentions(spark, sf))


@query
def date_ranges(spark, sf):
    return extract.date_ranges(cv_corpus(spark, sf))


@query
def experiences(spark, sf):
    return extract.experiences(cv_corpus(spark, sf))


@query
def education(spark, sf):
    return extract.education(lines.line_offsets(cv_corpus(spark, sf)))


@query
def word_spans(spark, sf):
    return extract.word_spans(cv_corpus(spark, sf))


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Words with tags by place, where a model's would be."""
    tags = F.array(*[F.lit(t) for t in ("B-ORG", "I-ORG", "O", "I-PER", "B-PER", "I-PER", "B-LOC", "B-DATE")])
    return extract.word_spans(cv_corpus(spark, sf)).withColumn("tag", F.element_at(tags, ((F.col("doc_id") * 3 + F.col("word_no") * 5 + F.floor(F.col("word_no") / 7)) % 8 + 1).cast("int")))


@query
def bio_spans(spark, sf):
    return extract.bio_spans(_tagged(spark, sf), cv_corpus(spark, sf))


def _model_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every word as an entity: even words are organisations, odd ones names."""
    label = F.when(F.col("word_no") % 2 == 0, "org").otherwise("name")
    return extract.word_spans(cv_corpus(spark, sf)).select("doc_id", label.alias("label"), "text", "start_off", "end_off")


@query
def entity_skill_join(spark, sf):
    return extract.entity_skills(_model_entities(spark, sf))


@query
def merge_skills(spark, sf):
    return extract.merge_skills(_mentions(spark, sf), extract.entity_skills(_model_entities(spark, sf))).select("doc_id", "canonical", "start_off", "end_off", "extractor")


# language and statements


@query
def lang_scores(spark, sf):
    s = language.lang_scores(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.round(s["en"], 4).alias("en"), F.round(s["id"], 4).alias("id"), s["n"].alias("n"))


@query
def lang_wordlist(spark, sf):
    label = language.wordlist_label(language.lang_scores(F.col("stripped")))
    return _lines(spark, sf).select("doc_id", "line_no", label["lang"].alias("lang"), label["confidence"].alias("confidence"))


@query
def lang_classify(spark, sf):
    return language.line_languages(_lines(spark, sf)).select("doc_id", "line_no", "lang", "confidence", "method")


@query
def lang_mix(spark, sf):
    return language.lang_mix(_lines(spark, sf))


@query
def report_lang(spark, sf):
    return language.report_lang(_lines(spark, sf))


@query
def quant_score(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", statements.quant_score(F.col("stripped")).alias("score"))


@query
def vague_cues(spark, sf):
    d = _lines(spark, sf).select("doc_id", "line_no", statements.vague_cues(F.col("stripped")).alias("cues"))
    return d.where(F.size("cues") > 0).select("doc_id", "line_no", _joined("cues").alias("cues"))


@query
def statement_class(spark, sf):
    d = _lines(spark, sf).select("doc_id", "line_no", statements.statement_class(F.col("stripped")).alias("s"))
    return d.select("doc_id", "line_no", "s.label", "s.confidence", _joined("s.cues").alias("cues"))


@query
def light_stem(spark, sf):
    words = _docs(spark, sf).select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", tx.light_stem(F.col("word")).alias("stem"))


# vectors


@query
def cosine_sim(spark, sf):
    e = _table(spark, sf, "embeddings")
    shifted = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(shifted, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 4).alias("score"))


@query
def pairwise_cosine(spark, sf):
    e = _table(spark, sf, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 10))
    return vectors.pairwise(e, "g", "vec_id", "embedding").withColumn("score", F.round("score", 4))


@query
def summary_topk(spark, sf):
    """Lines with the vector of their line's number, against the six first vectors."""
    e = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    exemplars = e.where(F.col("vec_id") < len(lx.EXEMPLARS)).agg(F.collect_list("vector").alias("exemplars"))
    d = _lines(spark, sf).withColumn("vec_id", F.col("doc_id") * 7 % 101 + F.col("line_no") + 10).join(e, "vec_id").join(F.broadcast(exemplars), how="cross")
    return vectors.summary_topk(d).withColumn("score", F.round("score", 4))


# findings


@query
def missing_sections(spark, sf):
    out = findings.missing_sections(cv_corpus(spark, sf), _segs(spark, sf))
    return out.select("doc_id", _joined("missing", ",").alias("missing"), _joined("found", ",").alias("found"), "evidence", "start_off", "end_off")


@query
def vague_bullets(spark, sf):
    return findings.vague_bullets(_lines(spark, sf))


@query
def unsupported_claims(spark, sf):
    return findings.unsupported_claims(_lines(spark, sf))


@query
def line_jaccard(spark, sf):
    return findings.line_jaccard(_lines(spark, sf))


@query
def redundant_pairs(spark, sf):
    return findings.redundant_pairs(_lines(spark, sf))


@query
def redundant_pairs_documents(spark, sf):
    own = lines.line_stripped(lines.line_offsets(_docs(spark, sf))).withColumn("segment", F.lit("other"))
    return findings.redundant_pairs(own).select("doc_id", "line_a", "line_b", "score")


# relevance


def _requirements(spark: SparkSession) -> DataFrame:
    return relevance.jd_requirements(requirements(spark))


@query
def jd_requirements(spark, sf):
    return _requirements(spark)


@query
def jd_requirements_benchmark(spark, sf):
    b = _table(spark, sf, "benchmark").select(F.col("item_id").alias("jd_id"), F.col("text").alias("jd_text"))
    return relevance.jd_requirements(b)


@query
def coverage(spark, sf):
    out = relevance.coverage(_lines(spark, sf), _requirements(spark))
    return out.withColumn("similarity", F.round("similarity", 4))


@query
def relevance_match(spark, sf):
    return relevance.relevance(_lines(spark, sf), _requirements(spark))


@query
def relevance_summary(spark, sf):
    return relevance.relevance_summary(relevance.relevance(_lines(spark, sf), _requirements(spark), texts=False))


# rendering


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = cv_corpus(spark, sf)
    own = tables.keep(lines.document_lines(docs), "lines")
    return report.all_findings(docs, own, lines.segments(own))


@query
def render_messages(spark, sf):
    return _findings(spark, sf).select("doc_id", "kind", "lang", "message")


@query
def word_freq(spark, sf):
    return render.word_freq(cv_corpus(spark, sf))


@query
def word_freq_top(spark, sf):
    return render.cloud_words(render.word_freq(_docs(spark, sf), merge_aliases=False))


@query
def evidence_union(spark, sf):
    return render.evidence_union(extract.skill_mentions(cv_corpus(spark, sf)))


@query
def highlight_html(spark, sf):
    docs = cv_corpus(spark, sf)
    return render.highlight_html(docs, extract.skill_mentions(docs))


@query
def report_rows(spark, sf):
    return report.report(cv_corpus(spark, sf), _requirements(spark))


# redaction and limits


@query
def redact_text(spark, sf):
    return privacy.redact_documents(cv_corpus(spark, sf))


@query
def redact_documents(spark, sf):
    return privacy.redact_documents(_docs(spark, sf)).select("doc_id", F.md5("redacted").alias("redacted_md5"), "n_emails", "n_urls", "n_phones", "name_redacted", "n_replacements")


@query
def rate_limit(spark, sf):
    e = _table(spark, sf, "events")
    return privacy.rate_limit(e, max_calls=2, per_seconds=86_400).select("user_id", "event_id", "allowed", F.round("retry_after_s", 3).alias("retry_after_s"))


@query
def rate_limit_stream(spark, sf):
    """The same decisions from a stream that reads the table once."""
    source = _table(spark, sf, "events")
    stream = limiter.rate_limit_stream(spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*"), max_calls=2, per_seconds=86_400)
    out = tables.scratch(spark, "limit")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("user_id", "event_id", "allowed", F.round("retry_after_s", 3).alias("retry_after_s"))


# rewriting


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keep(rewrite.number_findings(_findings(spark, sf)), "numbered")


@query
def llm_prompt(spark, sf):
    return rewrite.llm_prompt(_numbered(spark, sf))


def _answers(numbered: DataFrame) -> DataFrame:
    """Recorded answers: the message again, an unrelated sentence, or an echo of the evidence, by doc_id."""
    body = F.when(F.col("doc_id") % 3 == 0, F.col("message")).when(F.col("doc_id") % 3 == 1, F.lit("Hire this excellent candidate now")).otherwise(F.col("evidence"))
    mark = F.when(F.col("doc_id") % 2 == 0, ". ").otherwise(") ")
    body = F.regexp_replace(body, r"[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]+", " ")  # one line for each finding
    d = numbered.select("doc_id", F.struct("finding_no", F.concat(F.col("finding_no").cast("string"), mark, body).alias("s")).alias("x"))
    return d.groupBy("doc_id").agg(F.concat(F.lit("Sure:\n"), F.array_join(F.sort_array(F.collect_list("x"))["s"], "\n")).alias("answer"))


@query
def parse_numbered(spark, sf):
    return rewrite.parse_numbered(_answers(_numbered(spark, sf)))


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    numbered = _numbered(spark, sf)
    return rewrite.rewrite(numbered, rewrite.parse_numbered(_answers(numbered)))


@query
def verify_keyword(spark, sf):
    return _verified(spark, sf).select("doc_id", "finding_no", "score", "reason", "accepted")


@query
def rewrite_findings(spark, sf):
    return _verified(spark, sf).select("doc_id", "finding_no", "fallback", "text")


@query
def faithfulness(spark, sf):
    return rewrite.faithfulness(_verified(spark, sf))


@query
def parse_sse(spark, sf):
    chunk = lambda c: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), c, F.lit('"}}]}'))
    body = F.concat_ws("\n", chunk(F.concat(F.lit("n"), F.col("doc_id").cast("string"))), F.lit("data: {broken"), F.lit(": ping"), chunk(F.lit(" ok")), F.lit("data: [DONE]"))
    return _docs(spark, sf).select("doc_id", rewrite.parse_sse(body).alias("text"))


# metrics


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans: those of the rules, one in three moved by two characters, one in seven left out, and one of another label a document."""
    m = _mentions(spark, sf)
    move = F.when((F.col("start_off") + F.col("doc_id")) % 3 == 0, 2).otherwise(0)
    kept = m.where((F.col("start_off") + F.col("doc_id")) % 7 != 0).select("doc_id", F.col("canonical").alias("label"), (F.col("start_off") + move).cast("int").alias("start_off"), (F.col("end_off") + move).cast("int").alias("end_off"))
    return kept.unionByName(cv_corpus(spark, sf).select("doc_id", F.lit("Poetry").alias("label"), F.lit(0).alias("start_off"), F.lit(3).alias("end_off")))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return _mentions(spark, sf).select("doc_id", F.col("canonical").alias("label"), "start_off", "end_off")


@query
def prf_spans(spark, sf):
    return metrics.prf_spans(_predicted(spark, sf), _gold(spark, sf), strict=True)


@query
def prf_spans_lenient(spark, sf):
    return metrics.prf_spans(_predicted(spark, sf), _gold(spark, sf))


@query
def prf_sets(spark, sf):
    """Documents with a long text against those labelled as good."""
    predicted = _docs(spark, sf).where(F.length("text") > 1500).select("doc_id")
    gold = _table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    return metrics.prf_sets(predicted, gold, ["doc_id"])


@query
def accuracy(spark, sf):
    """The documents' language against the word lists'."""
    scores = language.lang_scores(F.coalesce("text", F.lit("")))
    d = _table(spark, sf, "documents").select(F.when(F.col("lang") == "en", "en").otherwise("other").alias("gold"), F.when(language.wordlist_label(scores)["lang"] == "en", "en").otherwise("other").alias("got"))
    return metrics.accuracy(d, "got", "gold")


@query
def mrr(spark, sf):
    hits = relevance.coverage(_lines(spark, sf), _requirements(spark))
    order = Window.partitionBy("doc_id", "jd_id", "req_no").orderBy(F.col("similarity").desc(), "line_no")
    ranked = hits.withColumn("rank", F.row_number().over(order)).withColumn("q", F.concat_ws("-", "doc_id", "jd_id", "req_no"))
    return metrics.mrr(ranked.withColumn("relevant", F.col("line_no") > 10), "q", "rank", "relevant")


def _feature_rates(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    return metrics.gold_run({"skills": _predicted(spark, sf)}, {"skills": _gold(spark, sf)}, strict)


@query
def delta_table(spark, sf):
    return metrics.delta_table(_feature_rates(spark, sf, True), _feature_rates(spark, sf, False))


@query
def gold_run(spark, sf):
    """Strict rates of skills and education."""
    edu = extract.education(lines.line_offsets(cv_corpus(spark, sf))).select("doc_id", F.lit("education").alias("label"), "start_off", "end_off")
    gold_edu = edu.where(F.col("doc_id") % 5 != 0)
    return metrics.gold_run({"skills": _predicted(spark, sf), "education": edu}, {"skills": _gold(spark, sf), "education": gold_edu}, strict=True)


@query
def sample_docs(spark, sf):
    return metrics.sample_docs(_docs(spark, sf), 50).select("doc_id", F.length("text").alias("n_chars"))


@query
def pseudo_gold(spark, sf):
    return extract.pseudo_gold(cv_corpus(spark, sf))


@query
def pseudo_gold_rates(spark, sf):
    docs = cv_corpus(spark, sf)
    return metrics.corpus_sets(docs, extract.skill_set(_mentions(spark, sf)), extract.pseudo_gold(docs))


@query
def two_modes(spark, sf):
    """Rules alone, and with a model's entities, against one gold."""
    system = extract.merge_skills(_mentions(spark, sf), extract.entity_skills(_model_entities(spark, sf)))
    system = system.select("doc_id", F.col("canonical").alias("label"), "start_off", "end_off").where("start_off % 5 != 0")
    return metrics.two_modes({"skills": _predicted(spark, sf)}, {"skills": system}, {"skills": _gold(spark, sf)}, strict=True)


@query
def gold_documents(spark, sf):
    return metrics.document_counts(cv_corpus(spark, sf), _predicted(spark, sf), _gold(spark, sf))


# bundles, models, runs


@query
def rules_bundle(spark, sf):
    docs = cv_corpus(spark, sf)
    own = lines.document_lines(docs)
    found = extract.rules_extraction(docs, own, lines.segments(own))
    rows = [d.select("doc_id", F.lit(k).alias("kind"), "start_off", "end_off", "segment", "extractor") for k, d in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def segment_access(spark, sf):
    own = _lines(spark, sf)
    first = lines.first_segment(lines.segments(own), "experience").select("doc_id", "seg_no", "heading", "start_off", "end_off")
    return first.join(lines.segment_lines(own, "experience").groupBy("doc_id").agg(F.count("*").alias("n_lines")), "doc_id")


@query
def report_findings(spark, sf):
    """What the whole report says of findings, as rows."""
    full = report.full_report(cv_corpus(spark, sf), run_id="r").select("doc_id", F.explode("findings").alias("f"))
    return full.select("doc_id", "f.finding_no", "f.kind", "f.message", F.array_join("f.evidence.text", " | ").alias("evidence"), F.col("f.evidence")[0]["start"].alias("start_off"))


@query
def report_full(spark, sf):
    """Sizes and figures of the whole report's other parts."""
    r = report.full_report(cv_corpus(spark, sf), _requirements(spark), run_id="r")
    said = lambda c: F.col(f"meta.lang_distribution.{c}")
    return r.select(
        "doc_id", F.size("findings").alias("n_findings"), F.size("extraction.skills").alias("n_skills"), F.size("extraction.experiences").alias("n_experiences"), F.size("extraction.education").alias("n_education"),
        F.array_join(F.array_sort(F.map_keys(F.map_filter("completeness", lambda _, v: v))), ",").alias("complete"), F.size(F.filter("relevance", lambda x: x["matched"])).alias("n_matched"),
        F.col("meta.report_language").alias("lang"), said("en").alias("n_en"), said("id").alias("n_id"), F.col("meta.config.llm_key").alias("key"),
    )


def _detector(text: str) -> tuple[str, float]:
    if "?" in text:
        raise ValueError(text)
    return ("en", 0.9) if "the" in text else ("id", 0.05) if "an" in text else ("fr", 0.7)


@query
def lang_detected(spark, sf):
    return language.line_languages(_lines(spark, sf), _detector).select("doc_id", "line_no", "lang", "confidence", "method")


def _tagger(words: list[str]) -> tuple[list[int], list[str]]:
    """Three letters a piece; the second piece of a capitalised word, or its only one, says so."""
    counts = [-(-len(w) // 3) for w in words]
    return counts, [("B-ORG" if w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and k == min(1, n - 1) else "O") for w, n in zip(words, counts, strict=True) for k in range(n)]


@query
def word_tags(spark, sf):
    return extract.word_tags(extract.word_spans(cv_corpus(spark, sf)), _tagger, max_pieces=120).select("doc_id", "word_no", "start_off", "end_off", "tag")


@query
def line_vectors(spark, sf):
    d = vectors.embed(_lines(spark, sf).select("doc_id", "line_no", "stripped"), "stripped", lambda texts: [[len(t), t.count("e"), 1] for t in texts])
    return d.select("doc_id", "line_no", F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[1], 6).alias("y"))


def _line_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a vector each. No vec_id beyond the longest document's lines is asked for, so few vectors go to the lines, whose texts stay where they are."""
    own = tables.keep(_lines(spark, sf), "lines")
    last = own.agg(F.max("line_no")).first()[0] or 0
    e = _table(spark, sf, "embeddings").where(F.col("vec_id") <= 110 + last).select("vec_id", F.col("embedding").alias("vector"))
    return own.withColumn("vec_id", F.col("doc_id") * 7 % 101 + F.col("line_no") + 10).join(F.broadcast(e) if last < 100_000 else e, "vec_id")


@query
def redundant_vectors(spark, sf):
    return findings.redundant_pairs(_line_vectors(spark, sf), threshold=0.3, vectors="vector").select("doc_id", "line_a", "line_b", "score")


@query
def relevance_vectors(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    req = _requirements(spark).withColumn("vec_id", (F.col("jd_id") * 3 + F.col("req_no")).cast("long")).join(e, "vec_id")
    return relevance.relevance(_line_vectors(spark, sf), req, threshold=0.2, vectors="vector", texts=False).select("doc_id", "jd_id", "req_no", "similarity", "matched")


@query
def verify_embedding(spark, sf):
    e = _table(spark, sf, "embeddings").where("vec_id < 7").select("vec_id", "embedding")
    numbered = _numbered(spark, sf)
    rows = rewrite.parse_numbered(_answers(numbered)).join(numbered, ["doc_id", "finding_no"])
    rows = rows.withColumn("vec_id", (F.col("doc_id") + F.col("finding_no")) % 7).join(F.broadcast(e.withColumnRenamed("embedding", "sentence_vector")), "vec_id")
    rows = rows.withColumn("vec_id", F.col("doc_id") % 5).join(F.broadcast(e.withColumnRenamed("embedding", "material_vector")), "vec_id")
    return rewrite.verify(rows, "embedding", threshold=0.1).select("doc_id", "finding_no", "score", "reason", "accepted")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    sample = metrics.sample_docs(cv_corpus(spark, sf), 20)
    found = tables.keep(_findings(spark, sf), "findings")
    sentences = rewrite.parse_numbered(_answers(rewrite.number_findings(found))).where("finding_no != 3")
    return rewrite.faithfulness_records(found, sentences, sample)


@query
def faithfulness_records(spark, sf):
    return _records(spark, sf)


@query
def faithfulness_run(spark, sf):
    return rewrite.faithfulness_run(_records(spark, sf))


@query
def rewrite_gate(spark, sf):
    """Every document that got no sentences, and why."""
    allowed = _docs(spark, sf).select("doc_id", (F.col("doc_id") % 3 != 0).alias("allowed"), F.lit(12.0).alias("retry_after_s"))
    config = tables.Config(llm_enabled=True, llm_key="k")
    return rewrite.ask(_numbered(spark, sf), lambda prompt: "" if len(prompt) % 2 else "1. so it is", config, allowed)[1]
