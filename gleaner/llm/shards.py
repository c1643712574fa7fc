"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, exactly
as a uniform random permutation of all rows would have it (a multivariate
hypergeometric draw per partition from what the shards still have free). Each
partition then permutes its rows and deals them out by those counts, rows are
exchanged, and every shard permutes what it got. Shards differ by at most one
row. The matrix has one row per input partition and one column per shard; the
driver draws it for groups of partitions, tasks for the partitions of a group.

A shard is not one task: its second permutation goes through sub-buckets whose
counts give each its first slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric: how many of ``n`` rows drawn from good + bad are good.

    Exact at any size: the law's weights, relative to that of its mode, follow
    from one another; beyond 12 standard deviations they are under 1e-30 of it.
    Numbers are Python's, so nothing overflows.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = n / (good + bad)
    reach = int(12 * (good * p * (1 - p) * bad / max(1, good + bad - 1)) ** 0.5) + 40
    up, down = min(high, mode + reach), max(low, mode - reach)
    k = np.arange(up - mode, dtype=np.float64)
    rise = np.cumprod((good - mode - k) / (mode + k + 1) * ((n - mode - k) / (bad - n + mode + k + 1)))
    k = np.arange(mode - down, dtype=np.float64)
    fall = np.cumprod((mode - k) / (good - mode + k + 1) * ((bad - n + mode - k) / (n - mode + k + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    total = np.cumsum(weights)
    return down + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, len(total) - 1))


def communication_matrix(rows: list[int], shards: list[int], seed) -> list[list[int]]:
    """Counts of rows from partition i to shard j; sums are ``rows`` and ``shards``.

    Row by row and shard by shard, each count is drawn from what both still have.
    """
    rng = np.random.default_rng(seed)
    free, out = [int(x) for x in shards], []
    for n in rows:
        left, rest, got = int(n), sum(free), []
        for j, size in enumerate(free):
            rest -= size
            got.append(draw(rng, size, rest, left))
            left -= got[j]
        out.append(got)
        free = [f - g for f, g in zip(free, got, strict=True)]
    return out


def _ends(counts: DataFrame, shards: list[int], seed: int, groups: int) -> DataFrame:
    """_p, _ends: for each input partition (_p, _n) the sums of its matrix row.

    The matrix is drawn in two steps, which give the same law as one: for
    ``groups`` groups of partitions on the driver, then for each group's
    partitions, from what the group sends to each shard, in a task of its own.
    So the driver holds a bounded matrix however many partitions there are.
    """
    spark = counts.sparkSession
    counts = counts.withColumn("_g", F.pmod("_p", F.lit(groups)).cast("int"))
    totals = sorted((r["_g"], r["n"]) for r in counts.groupBy("_g").agg(F.sum("_n").alias("n")).collect())  # at most ``groups`` rows
    matrix = communication_matrix([n for _, n in totals], shards, seed)
    sent = spark.createDataFrame([(g, row) for (g, _), row in zip(totals, matrix, strict=True)], "_g int, _sent array<long>")

    def within(key, pdf):
        rows = pdf.sort_values("_p")
        m = communication_matrix(rows["_n"].tolist(), list(rows["_sent"].iloc[0]), [seed, int(key[0])])
        return rows.assign(_ends=[[int(x) for x in np.cumsum(r)] for r in m])[["_p", "_ends"]]

    return counts.join(F.broadcast(sent), "_g").groupBy("_g").applyInPandas(within, "_p int, _ends array<long>")


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = 8, rows_per_bucket: int = 200_000, groups: int = 256) -> DataFrame:
    """``df`` with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Any columns, nulls and repeated rows pass through; each row gets a slot of
    its own. An empty table gives an empty result. Columns shard and slot of
    ``df`` are replaced. The same files in the same splits give the same
    result; the rows are fixed in the shared folder before anything is drawn,
    so a lost executor can't change them.
    """
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    fixed = stash(df.select(*cols).withColumn("_at", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("_at", 33).cast("int")
    counts = stash(fixed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")), "shard-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    exact = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    ends = stash(_ends(counts, exact, seed, groups), "shard-ends")
    # first permutation: rows of a partition in the order of a seeded hash of their place
    local = Window.partitionBy("_p").orderBy(F.xxhash64(F.lit(seed), "_at"), "_at")
    dealt = fixed.withColumn("_p", part).withColumn("_i", F.row_number().over(local))
    dealt = dealt.join(ends, "_p")  # a short row for each input partition; the rows lie by partition already
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_i"))))
    # second permutation, in sub-buckets of a shard
    n_sub = max(1, -(-max(exact, default=0) // rows_per_bucket))
    dealt = dealt.withColumn("_k", F.xxhash64(F.lit(seed + 1), "_at")).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 2), "_at"), F.lit(n_sub)).cast("int"))
    per = dealt.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    first = per.select(
        F.col("shard").alias("_s"), F.col("_b").alias("_sb"), (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_first")
    )
    inside = Window.partitionBy("shard", "_b").orderBy("_k", "_at")
    out = dealt.withColumn("_r", F.row_number().over(inside)).join(first, (F.col("shard") == F.col("_s")) & (F.col("_b") == F.col("_sb")))
    return out.select(*cols, "shard", (F.col("_first") + F.col("_r") - 1).cast("long").alias("slot"))
