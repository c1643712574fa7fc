"""Mixing sources to target weights by Pareto order sampling.

DataFrame functions only: no Python, pandas or Arrow code touches a row.

Every document of a source has the same expected number of copies, the
source's target divided by its size. Its whole part is allocated for certain;
the rest ``p`` is an inclusion probability. Documents are ranked by random odds
divided by inclusion odds, ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash
of seed and id, and the sample is the head of that ranking whose words come
nearest to what the certain copies leave open.

The head is found without sorting a source in one task. The ranking is read
digit by digit: the word sums of a digit's 4,096 bins (a partial aggregation,
so a source with a third of all rows costs no more than any other) locate the
one bin in which the target lies, and the next digit parts that bin, until it
holds few enough rows to put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

DIGIT = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has columns source and source_size, one row per source. Sources
    by code point, null last, weigh ``weights`` in turn. Together they share
    ``share`` times all sizes; none gets more than ``cap`` times its own size,
    and what it can't take is shared again by weight. The sources that reach
    their cap are a head of the order by cap / weight: each step of sharing
    again only raises what the rest get.
    """
    ranked = sizes.select(
        "source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("i")
    ).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("limit") / F.col("w"), "i")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("w_rest", F.sum("w").over(rest))
        .withColumn("left", F.lit(float(share)) * F.col("all_size") - F.col("capped"))
        .withColumn("full", F.col("left") * F.col("w") >= F.col("limit") * F.col("w_rest"))
    )
    # From the first source that stays under its cap on, all do.
    ranked = ranked.withColumn("open", F.max((~F.col("full")).cast("int")).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    first = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumn("left1", F.max(F.when(F.col("open"), F.col("left"))).over(first)).withColumn(
        "w1", F.max(F.when(F.col("open"), F.col("w_rest"))).over(first)
    )
    target = F.when(F.col("open"), F.col("w") * F.col("left1") / F.col("w1")).otherwise(F.col("limit"))
    return ranked.select("source", "source_size", target.alias("target"))


def _digits(v: Column) -> list[Column]:
    """A long of 48 bits as four digits, the highest first."""
    return [F.shiftright(v, k).bitwiseAND(F.lit(DIGIT - 1)).cast("int") for k in (36, 24, 12, 0)]


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str | None = None,
    sort_rows: int = 100_000,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    mix_copies is how often the mix takes the document: at most ``cap``
    rounded up, and never more than ``cap`` times its size in words where
    ``cap`` is whole. Null sources form one source of their own, last. The draw
    is a hash of the id; a null id draws by its text, if ``text_col`` names it,
    else all null ids draw alike. Rows that draw alike are put in order by id,
    size and place, and the sample ends behind a row, not behind a draw, so
    that repeated ids and null ids come no less near to the target. Documents
    without words get the certain copies and never the sampled one. Rows that
    agree in id, size and text are interchangeable. An empty table gives an
    empty result. Names of ``docs`` that start with mix_ are overwritten.
    The rows are fixed in the shared folder first.
    """
    own_draw = F.md5(F.coalesce(F.col(text_col), F.lit(""))) if text_col else F.lit("")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), own_draw))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    own = {"mix_size", "mix_source_size", "mix_target", "mix_copies"}
    keep = [c for c in docs.columns if c != text_col and not c.startswith("mix_")]
    d = docs.withColumn("mix_size", size).withColumn("mix_u", u).select(*keep, "mix_size", "mix_u")
    d = stash(d.withColumn("mix_place", F.monotonically_increasing_id()), "mix-rows")
    sizes = stash(d.groupBy(F.col(source_col).alias("source")).agg(F.sum("mix_size").alias("source_size")), "mix-sources")
    # a few columns a source: up to this many are a megabyte or two, beyond it joins shuffle
    small = F.broadcast if sizes.count() <= 20_000 else (lambda x: x)
    targets = source_targets(sizes, list(weights), share, cap).select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    ratio = F.coalesce(F.try_divide(F.col("mix_target"), F.col("mix_source_size")), F.lit(0.0))
    targets = targets.withColumn("mix_sure", F.floor(ratio)).withColumn("mix_p", ratio - F.col("mix_sure"))
    targets = targets.withColumn("mix_open", F.col("mix_target") - F.col("mix_sure") * F.col("mix_source_size"))
    targets = small(stash(targets, "mix-targets"))
    d = d.join(targets, F.col(source_col).eqNullSafe(F.col("mix_source")), "left")
    # random odds / inclusion odds
    q = F.try_divide(F.col("mix_u") / (1 - F.col("mix_u")), F.col("mix_p") / (1 - F.col("mix_p")))
    d = d.withColumn("mix_q", F.when((F.col("mix_p") > 0) & (F.col("mix_size") > 0), q))
    # the ranking, as one value that no two rows share
    rank = F.struct(F.col("mix_q").alias("q"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("mix_size").alias("size"), F.col("mix_place").alias("place"))
    d = d.withColumn("mix_rank", rank)
    ranked = d.where(F.col("mix_q").isNotNull()).select("mix_source", "mix_open", "mix_size", "mix_place", "mix_rank", id_col)
    # its digits: those of its image in (0, 1), of the size, of the place
    image = (F.col("mix_rank.q") / (1 + F.col("mix_rank.q")) * F.lit(float(2**48))).cast("long")
    digits = _digits(image) + _digits(F.least(F.col("mix_size"), F.lit(2**48 - 1))) + _digits(F.shiftright("mix_place", 24)) + _digits(F.col("mix_place").bitwiseAND(F.lit(2**24 - 1)))
    inside, cut = ranked.withColumn("mix_before", F.lit(0).cast("long")), None
    for digit in digits:
        bins = inside.withColumn("mix_bin", digit).groupBy("mix_source", "mix_bin").agg(
            F.sum("mix_size").alias("words"), F.count("*").alias("n"), F.first("mix_open").alias("mix_open"), F.first("mix_before").alias("mix_before")
        )
        along = Window.partitionBy("mix_source").orderBy("mix_bin")  # at most DIGIT rows a source
        bins = bins.withColumn("upto", F.col("mix_before") + F.sum("words").over(along)).withColumn("from", F.col("upto") - F.col("words"))
        # the one bin of each source in which the open words end
        cut = bins.where((F.col("from") < F.col("mix_open")) & (F.col("upto") >= F.col("mix_open")))
        cut = stash(cut.select(F.col("mix_source").alias("cut_source"), F.col("mix_bin").alias("cut_bin"), F.col("from").alias("cut_before"), "n"), "mix-cuts")
        inside = inside.join(small(cut), F.col("mix_source").eqNullSafe(F.col("cut_source")) & (digit == F.col("cut_bin")))
        inside = inside.withColumn("mix_before", F.col("cut_before")).select(*ranked.columns, "mix_before")
        if (cut.agg(F.max("n")).first()[0] or 0) <= sort_rows:
            break
    order = Window.partitionBy("mix_source").orderBy("mix_rank")
    run = F.col("mix_before") + F.sum("mix_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a document is in while at least half of it lies below the open words
    inside = inside.withColumn("run", run).withColumn("in", F.col("run") - F.col("mix_size") / 2.0 <= F.col("mix_open"))
    # the last row that is in; where the first of the bin is out, the sample ends before it
    ends = inside.groupBy(F.col("mix_source").alias("end_source")).agg(
        F.max(F.when(F.col("in"), F.col("mix_rank"))).alias("end_rank"), F.min("mix_rank").alias("open_rank")
    )
    ends = stash(ends, "mix-ends")
    d = d.join(small(ends), F.col(source_col).eqNullSafe(F.col("end_source")), "left")
    within = F.when(F.col("open_rank").isNull(), F.lit(True)).when(F.col("end_rank").isNull(), F.col("mix_rank") < F.col("open_rank")).otherwise(F.col("mix_rank") <= F.col("end_rank"))
    sampled = F.col("mix_q").isNotNull() & (F.col("mix_open") > 0) & within
    d = d.withColumn("mix_copies", F.coalesce(F.col("mix_sure"), F.lit(0)) + F.coalesce(sampled, F.lit(False)).cast("int"))
    keep += [c for c in docs.columns if c.startswith("mix_") and c in d.columns and c not in own]
    return d.select(*keep, "mix_size", "mix_source_size", "mix_target", F.col("mix_copies").cast("long").alias("mix_copies"))
