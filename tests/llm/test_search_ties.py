"""Ties at the last place of a search."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import imi


def test_ties_go_to_the_smallest_ids(spark):
    bits = [[1.0, *map(float, b)] for b in itertools.product((-1, 1), repeat=9)]  # all tie against the query
    order = np.random.default_rng(0).permutation(len(bits)).tolist()
    rows = [(0, [2.0] + [0.0] * 9)] + [(i + 1, bits[o]) for i, o in enumerate(order)] + [(1000 + i, bits[order[300]]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in imi.search(df, F.col("id") == 0, k=5, recall=1.0).collect())
    assert got == [(i, i, 2.0) for i in range(1, 6)]
