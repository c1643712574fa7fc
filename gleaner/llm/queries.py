"""The queries of this subpackage: each reads whole tables and returns one operator's full result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .imi import link, search
from .langid import identify, train_dictionaries
from .line_runs import dedup_lines
from .mixing import mix, word_count
from .oddsketch import near_duplicates
from .piece_bpe import encode_documents
from .prefix_free import remove_repeats
from .shards import shuffle_into_shards
from .sql import SQL
from .toxicity import score_toxicity, train


def piece_model() -> str:
    """The model file's place; another can be named in GLEANER_PIECE_MODEL."""
    import public_tokenizers

    return os.environ.get("GLEANER_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def op1_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.98)


def op3_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(), digest=True)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    out = mix(docs, F.col("size"), text_col="text")  # texts are read once, and left behind
    return out.select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken")
    )


def op5_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op6_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, digest=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = train_dictionaries(docs.where(~held_out(F.col("doc_id"))), "lang", "text", "doc_id")
    out = identify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected")


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law")
    )
    out = shuffle_into_shards(docs, 8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    model = train(docs, labels)
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, digest=True)
    return out.select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
