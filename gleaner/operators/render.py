"""Messages for findings, highlighted text, word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

# kind -> language -> message; slots are columns of the finding
MESSAGES = {
    "vague_bullet": {
        "en": 'Line {line_no} tells a duty, not a result ({cue}): "{evidence}". Say what changed, by how much and for whom.',
        "id": 'Baris {line_no} menyebut tugas, bukan hasil ({cue}): "{evidence}". Tulis apa yang berubah, seberapa besar, dan bagi siapa.',
    },
    "redundant_pair": {
        "en": 'Lines {line_a} and {line_b} say the same ({score}): "{evidence}" / "{evidence_b}". Keep the stronger one.',
        "id": 'Baris {line_a} dan {line_b} berisi hal yang sama ({score}): "{evidence}" / "{evidence_b}". Simpan yang lebih kuat.',
    },
    "unsupported_claim": {
        "en": 'Nothing else in the document shows "{evidence}" (line {line_no}). Add an example or a figure.',
        "id": 'Tidak ada bagian lain yang menunjukkan "{evidence}" (baris {line_no}). Tambahkan contoh atau angka.',
    },
    "missing_section": {
        "en": "Sections not found: {missing}. Found: {found}.",
        "id": "Bagian yang tidak ditemukan: {missing}. Yang ada: {found}.",
    },
}
SLOTS = ["line_no", "cue", "evidence", "line_a", "line_b", "score", "evidence_b", "missing", "found"]
FINDING_COLUMNS = ["doc_id", "kind", "message", "confidence", "start_off", "end_off", *SLOTS]


def finding_rows(kind: str, found: DataFrame) -> DataFrame:
    """Findings of one kind in the shared shape; slots that the kind lacks are null."""
    have = set(found.columns)
    slot = lambda c: (F.array_join(c, ", ") if c in ("missing", "found") else F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    confidence = F.col("confidence") if "confidence" in have else F.col("score") if kind == "redundant_pair" else F.lit(None).cast("double")
    evidence = F.col("evidence_a").alias("evidence") if "evidence_a" in have else slot("evidence").alias("evidence")
    spans = [F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in ("start_off", "end_off")]
    score = F.format_string("%.2f", F.col("score")).alias("score") if "score" in have else F.lit(None).cast("string").alias("score")
    shaped = {"evidence": evidence, "score": score}
    return found.select("doc_id", F.lit(kind).alias("kind"), F.lit(kind).alias("message"), confidence.alias("confidence"), *spans, *[shaped.get(c, slot(c).alias(c)) for c in SLOTS])


def render(template: str) -> Column:
    """The template with its slots; null if a slot is null."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), F.col(name)]
    return F.concat(*out, F.lit(rest))


def render_messages(findings: DataFrame) -> DataFrame:
    """``findings`` (with lang) with message set. Unknown languages get English; unknown kinds and missing slots keep the message."""
    message = F.lit(None).cast("string")
    for kind, by_lang in MESSAGES.items():
        text = F.when(F.col("lang") == "id", render(by_lang["id"])).otherwise(render(by_lang["en"]))
        message = F.when(F.col("kind") == kind, text).otherwise(message)
    return findings.withColumn("message", F.coalesce(message, F.col("message")))


def evidence_union(spans: DataFrame) -> DataFrame:
    """doc_id, start_off, end_off: unions of spans that overlap or touch."""
    s = spans.select("doc_id", "start_off", "end_off").distinct()
    order = Window.partitionBy("doc_id").orderBy("start_off", "end_off")
    reach = F.max("end_off").over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.coalesce((F.col("start_off") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    return s.groupBy("doc_id", "island").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off")).drop("island")


def highlight_html(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, html: the escaped text with every union of spans in <mark>."""
    own = evidence_union(spans).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_off", "end_off"))).alias("u"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(own, "doc_id", "left")
    d = d.withColumn("u", F.coalesce("u", F.array().cast("array<struct<start_off:int,end_off:int>>")))
    part = lambda a, b: tx.escape_html(F.substring(F.col("text"), a + 1, b - a))
    marked = F.transform("u", lambda x, i: F.concat(part(F.when(i == 0, F.lit(0)).otherwise(F.get("u", i - 1)["end_off"]), x["start_off"]), F.lit("<mark>"), part(x["start_off"], x["end_off"]), F.lit("</mark>")))
    last = F.coalesce(F.get("u", F.size("u") - 1)["end_off"], F.lit(0))
    return d.select("doc_id", F.concat(F.array_join(marked, ""), part(last, F.length("text"))).alias("html"))


def word_freq(docs: DataFrame, merge_aliases: bool = True) -> DataFrame:
    """word, n over all texts: no stop words, one-word aliases as their canonical, unknown words from three characters on."""
    token = docs.select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    # counts of surface words first: the joins below see each word once
    counted = token.groupBy("token").agg(F.count("*").alias("n")).where(~F.col("token").isin(lx.COUNT_STOP_WORDS))
    names = docs.sparkSession.createDataFrame([(a, c.lower()) for a, c in lx.alias_lookup().items()], "token string, skill string")
    d = counted.join(F.broadcast(names), "token", "left")
    word = F.coalesce("skill", "token") if merge_aliases else F.col("token")
    d = d.withColumn("word", word).where((F.length("word") > 2) | F.col("skill").isNotNull())
    return d.groupBy("word").agg(F.sum("n").alias("n"))


def cloud_words(frequencies: DataFrame, most: int = 80) -> DataFrame:
    """The ``most`` frequent words, ties by word."""
    return frequencies.orderBy(F.col("n").desc(), "word").limit(most)
