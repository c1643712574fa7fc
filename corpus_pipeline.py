"""The training-data pipeline: language ID, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared folder and reads it back as the next stage's documents.

All stages but the last return the columns of documents, whatever other columns
their input has; an empty table gives an empty result. Rows of a repeated id
are filtered and counted each by its own text in the first two stages, and as
one document in the next two; a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import held_out, stash, table
from gleaner.llm.langid import identify, train_dictionaries
from gleaner.llm.line_runs import dedup_lines
from gleaner.llm.mixing import mix, word_count
from gleaner.llm.oddsketch import near_duplicates
from gleaner.llm.piece_bpe import encode_documents
from gleaner.llm.queries import piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with lang set to it; those without a letter or with a narrow margin go, null and empty texts among them."""
    dictionaries = train_dictionaries(docs.where(~held_out(F.col("doc_id"))), "lang", "text", "doc_id")
    out = identify(docs.select(*COLUMNS), dictionaries).where(~F.col("lang_rejected"))
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those left without any text go. Null texts hold no line."""
    out = dedup_lines(docs.select(*COLUMNS)).where((F.col("lines_dropped") == 0) | (F.length(F.col("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): that of the smallest id, with all its rows."""
    kept = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Null sources are one source; rows of one id are taken alike."""
    sized = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    taken = mix(sized, F.col("size"), text_col="text").where("mix_copies > 0").select(F.col("doc_id").alias("taken_id"), "mix_copies").groupBy("taken_id").agg(F.max("mix_copies").alias("copies"))
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the piece ids of every document of the mix, copies included; the operator decodes all of them, too."""
    return encode_documents(docs.select("doc_id", "text"), piece_model()).select("doc_id", "n_tokens", "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: Language identification by compression and piece encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
