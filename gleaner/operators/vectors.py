"""Similarities of vectors that a table supplies, and the summary they pick."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def pairwise(vectors: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    """group, a, b, score for a < b within each group. All pairs are the result, so groups must be small, such as a document's lines."""
    n = vectors.select(group, key, F.col(vec).alias("v"), F.sqrt(dot(F.col(vec), F.col(vec))).alias("norm"))
    a = n.select(group, F.col(key).alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    b = n.select(group, F.col(key).alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    score = F.coalesce(F.try_divide(dot(F.col("va"), F.col("vb")), F.col("na") * F.col("nb")), F.lit(0.0))
    return a.join(b, group).where(F.col("a") < F.col("b")).select(group, "a", "b", score.alias("score"))


def summary_topk(scored: DataFrame, k: int = 3, min_words: int = 6) -> DataFrame:
    """doc_id, rank, line_no, sentence, score: the k lines nearest to any exemplar; ties to the earlier line.

    ``scored`` has doc_id, line_no, stripped, vector and exemplars (array of
    vectors). Without vectors there is no summary.
    """
    d = scored.where((tx.word_count(F.col("stripped")) >= min_words) & F.col("vector").isNotNull())
    d = d.withColumn("score", F.array_max(F.transform("exemplars", lambda e: cosine(F.col("vector"), e))))
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "line_no")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "rank", "line_no", F.col("stripped").alias("sentence"), "score")


def embed(rows: DataFrame, text_col: str, encoder: Callable[[list[str]], list[list[float]]], out_col: str = "vector") -> DataFrame:
    """Adds vectors of length 1 that ``encoder`` gives for a batch of texts; null where the text is, or where the call fails."""
    keep = [c for c in rows.columns if c != out_col]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", `{out_col}` array<double>"

    def unit(v: list[float]) -> list[float]:
        n = sum(float(x) * float(x) for x in v) ** 0.5
        return [float(x) / n for x in v] if n else [float(x) for x in v]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            here = [i for i, x in enumerate(b[text_col]) if x is not None]
            got: list = [None] * len(b)
            try:
                for i, v in zip(here, encoder([b[text_col].iloc[i] for i in here]) if here else [], strict=True):
                    got[i] = unit(v)
            except Exception:  # without an encoder the lexical scores stand in
                got = [None] * len(b)
            yield b.assign(**{out_col: pd.Series(got, index=b.index, dtype=object)})

    return rows.select(*keep).mapInPandas(run, shape)
