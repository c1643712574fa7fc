"""Precision, recall and their kin over tables of predictions and gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1, each 0 where undefined, to tp, fp, fn."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 4))


def prf_sets(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of two sets of rows."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, keys, "full")
    return rates(both.agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn")))


def prf_spans(predicted: DataFrame, gold: DataFrame, strict: bool = False, pooled: bool = False) -> DataFrame:
    """One row of counts and rates over spans (doc_id, label, start_off, end_off).

    Each prediction, in the order of its offsets, takes the first gold span
    not yet taken that has its label and overlaps it (``strict``: equals it).
    Documents are apart, unless ``pooled``.
    """
    keys = ["label"] if pooled else ["doc_id", "label"]
    if strict:
        same = [*keys, "start_off", "end_off"]
        n = lambda d, c: d.groupBy(*same).agg(F.count("*").alias(c))
        both = n(predicted, "p").join(n(gold, "g"), same, "full").na.fill(0, ["p", "g"])
        hit = F.least("p", "g")
        return rates(both.agg(F.coalesce(F.sum(hit), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("p") - hit), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("g") - hit), F.lit(0)).alias("fn")))
    spans = lambda d, c: d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_off", "end_off"))).alias(c))
    both = spans(predicted, "p").join(spans(gold, "g"), keys, "full")
    none = F.array().cast("array<struct<start_off:int,end_off:int>>")
    both = both.withColumn("p", F.coalesce("p", none)).withColumn("g", F.coalesce("g", none))

    def take(acc: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: ~F.array_contains(acc, i) & (F.get("g", i)["start_off"] < x["end_off"]) & (x["start_off"] < F.get("g", i)["end_off"]))
        return F.when(F.size(free) > 0, F.array_append(acc, F.get(free, F.lit(0)))).otherwise(acc)

    taken = F.when(F.size("g") == 0, F.lit(0)).otherwise(F.size(F.aggregate("p", F.array().cast("array<int>"), take)))
    both = both.withColumn("hit", taken)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rates(both.agg(total(F.col("hit")).alias("tp"), total(F.size("p") - F.col("hit")).alias("fp"), total(F.size("g") - F.col("hit")).alias("fn")))


def accuracy(pairs: DataFrame, predicted: str, gold: str) -> DataFrame:
    """n and accuracy (0 without rows)."""
    return pairs.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col(predicted).eqNullSafe(F.col(gold)).cast("int")), F.lit(0.0)), 4).alias("accuracy"))


def mrr(ranked: DataFrame, query: str, rank: str, relevant: str) -> DataFrame:
    """n queries and the mean of 1 / first relevant rank, 0 without one."""
    first = ranked.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("r"))
    return first.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), F.lit(0.0)), 4).alias("mrr"))


def delta_table(baseline: DataFrame, system: DataFrame) -> DataFrame:
    """feature, and f1 and recall of both and their differences; features that the system lacks are left out."""
    b = baseline.select("feature", F.col("f1").alias("bf"), F.col("recall").alias("br"))
    s = system.select("feature", F.col("f1").alias("sf"), F.col("recall").alias("sr"))
    r = lambda c, name: F.round(c, 4).alias(name)
    return b.join(s, "feature").select(
        "feature", r(F.col("bf"), "baseline_f1"), r(F.col("sf"), "system_f1"), r(F.col("sf") - F.col("bf"), "delta_f1"),
        r(F.col("br"), "baseline_recall"), r(F.col("sr"), "system_recall"), r(F.col("sr") - F.col("br"), "delta_recall"),
    )


def sample_docs(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The n documents of lowest md5 of seed and id: the same ones in every run and engine."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    return docs.orderBy(key, "doc_id").limit(n)


def gold_run(predicted: dict[str, DataFrame], gold: dict[str, DataFrame], strict: bool = False, pooled: bool = False) -> DataFrame:
    """feature, tp, fp, fn, precision, recall, f1 for each feature that has gold."""
    out = None
    for feature in gold:
        row = prf_spans(predicted[feature], gold[feature], strict, pooled).select(F.lit(feature).alias("feature"), "*")
        out = row if out is None else out.unionByName(row)
    return out




def two_modes(baseline: dict[str, DataFrame], system: dict[str, DataFrame], gold: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """feature, baseline and system precision, recall and f1, and their differences, of two extractions against one gold."""
    rate = lambda d, mode: gold_run(d, gold, strict).select("feature", *[F.col(c).alias(f"{mode}_{c}") for c in ("precision", "recall", "f1")])
    both = rate(baseline, "baseline").join(rate(system, "system"), "feature")
    return both.select("*", *[F.round(F.col(f"system_{c}") - F.col(f"baseline_{c}"), 4).alias(f"delta_{c}") for c in ("precision", "recall", "f1")])


def document_counts(docs: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, n_pred, n_gold of every document."""
    n = lambda d, c: d.groupBy("doc_id").agg(F.count("*").alias(c))
    both = docs.select("doc_id").join(n(predicted, "n_pred"), "doc_id", "left").join(n(gold, "n_gold"), "doc_id", "left")
    return both.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_pred", "n_gold")])


def corpus_sets(docs: DataFrame, predicted: DataFrame, gold: DataFrame, key: str = "canonical") -> DataFrame:
    """n_docs, n_without (documents without a prediction), tp, fp, fn, precision, recall, f1 of the sets of keys of all documents together."""
    without = document_counts(docs, predicted, gold).agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_pred") == 0).alias("n_without"))
    return without.join(F.broadcast(prf_sets(predicted, gold, [key])), how="cross")  # one row each
