"""Lines with offsets, headings, sections and segments of documents (doc_id, text).

All windows share one partitioning and order, (doc_id, line_no): Spark shuffles
the lines of a corpus once and sorts them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx



def in_order():
    return Window.partitionBy("doc_id").orderBy("line_no")



def line_offsets(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), text (with its line end), start_off, end_off; no lines for null and empty texts."""
    lines = docs.select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("i", "text"))
    end = F.sum(F.length("text")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.select("doc_id", (F.col("i") + 1).alias("line_no"), "text")
    return lines.select("doc_id", "line_no", "text", (end - F.length("text")).cast("int").alias("start_off"), end.cast("int").alias("end_off"))


def line_stripped(lines: DataFrame) -> DataFrame:
    """Adds stripped, s_start, s_end: the line without white space at its ends."""
    lines = lines.withColumn("stripped", tx.strip(F.col("text")))
    lead = F.length("text") - F.length(tx.lstrip(F.col("text")))
    start = (F.col("start_off") + lead).cast("int")
    return lines.withColumn("s_start", start).withColumn("s_end", (start + F.length("stripped")).cast("int"))


def heading_section(lines: DataFrame) -> DataFrame:
    """Adds heading: the section that a heading line names, else null.

    A heading has 1 to 4 words and at most 40 characters, no digit, no tab and
    no closing punctuation but colons. The dictionary is a broadcast table of
    fixed size.
    """
    bare = F.regexp_replace(tx.strip(F.col("text")), ":+$", "")
    n = tx.word_count(bare)
    fits = (bare != "") & (F.length(bare) <= 40) & ~F.contains(F.col("text"), F.lit("\t")) & ~bare.rlike("[.!?,]$") & ~bare.rlike(r"\p{Nd}") & n.between(1, 4)
    normal = tx.strip(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_\s/&]", ""))
    names = lines.sparkSession.createDataFrame(list(lx.heading_names().items()), "_name string, heading string")
    return lines.withColumn("_normal", F.when(fits, normal)).join(F.broadcast(names), F.col("_normal") == F.col("_name"), "left").drop("_normal", "_name")


def line_sections(lines: DataFrame) -> DataFrame:
    """Adds heading and segment: the section of the last heading so far, 'other' before the first."""
    lines = heading_section(lines)
    last = F.last("heading", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("segment", F.coalesce(last, F.lit("other")))


def document_lines(docs: DataFrame) -> DataFrame:
    """Lines with everything above."""
    return line_sections(line_stripped(line_offsets(docs)))


def segments(lines: DataFrame) -> DataFrame:
    """doc_id, seg_no (from 1), name, heading, start_off, end_off: runs of lines of one section.

    Neighbouring segments of one name are one, with the first heading.
    """
    new = F.coalesce((F.lag("segment").over(in_order()) != F.col("segment")).cast("int"), F.lit(1))
    runs = lines.withColumn("_new", new)
    runs = runs.withColumn("seg_no", F.sum("_new").over(in_order()).cast("int"))
    first = F.min_by(F.when(F.col("heading").isNotNull(), F.regexp_replace(F.col("stripped"), ":+$", "")), "line_no")
    return runs.groupBy("doc_id", "seg_no").agg(
        F.first("segment").alias("name"), first.alias("heading"), F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off")
    )


def span_segment(spans: DataFrame, segs: DataFrame) -> DataFrame:
    """Adds segment: that which holds the span's start, else 'document'. An equi-join on doc_id with a range behind it."""
    s = segs.select(F.col("doc_id").alias("_doc"), F.col("name").alias("segment"), F.col("start_off").alias("_s"), F.col("end_off").alias("_e"))
    joined = spans.join(s, (F.col("doc_id") == F.col("_doc")) & (F.col("start_off") >= F.col("_s")) & (F.col("start_off") < F.col("_e")), "left")
    return joined.drop("_doc", "_s", "_e").withColumn("segment", F.coalesce("segment", F.lit("document")))


def is_bullet_line(text) -> F.Column:
    """Whether a line starts with a bullet or a number, and goes on."""
    return tx.lstrip(text).rlike(r"^(?:[-•▪◦*·›>+]|\d+[.)])\s+\S")


def first_segment(segs: DataFrame, name: str) -> DataFrame:
    """The first segment of that name of each document that has one."""
    of_name = segs.where(F.col("name") == name)
    first = of_name.groupBy("doc_id").agg(F.min("seg_no").alias("seg_no"))
    return of_name.join(first, ["doc_id", "seg_no"]).select(segs.columns)


def segment_lines(lines: DataFrame, name: str) -> DataFrame:
    """The lines of all segments of that name."""
    return lines.where(F.col("segment") == name)
