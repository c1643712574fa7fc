"""Inverted multi-index: search by inner product, and near-duplicate links by cosine.

Both halves of the vectors have a codebook of their own; a pair of centroids is
a cell of the product grid. The multi-sequence traversal takes a query's cells
in the order of the sum of two per-half values with a heap: summed inner
products for search, summed squared lower bounds of the distance for links.
Every vector is indexed; only the codebooks are fitted on a sample.

Cells are dealt in blocks of a bounded number of vectors; a cell with more is
parted by a hash, so a hot cell is no task of its own. A block's vectors are
held while its queries stream past, and a query meets only the cells it visits.
Copies are collapsed before all of this.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .components import connected_components

SAMPLE = 8192


def dense(df: DataFrame, id_col: str, vec_col: str, extra: list[str] | None = None) -> DataFrame:
    """id, the extra columns and v: the vector's doubles as bytes; rows that take no part are left out."""
    extra = extra or []
    d = df.select(F.col(id_col).cast("long").alias("id"), *extra, F.col(vec_col).cast("array<double>").alias("e"))
    d = d.where(F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("e").schema) + ", v binary"

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.num_columns - 1)
            values, offsets = col.values, col.offsets.to_numpy()
            x = values.to_numpy(zero_copy_only=False)  # null components become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            lo, hi = offsets[:-1], offsets[1:]
            ok = (bad[hi] == bad[lo]) & (some[hi] > some[lo]) & (hi > lo)
            x = x + 0.0  # -0.0 and 0.0 are one value
            out = [x[i:j].tobytes() for i, j, k in zip(lo, hi, ok, strict=True) if k]
            kept = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "v"])

    return d.mapInArrow(flat, schema)


def kmeans(x: np.ndarray, k: int, seed: int = 0, steps: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs (i, j) in the order of a[i] + b[j], smallest first."""
    ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(a[ia[0]] + b[ib[0]], 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield s, ia[i], ib[j]
        if j + 1 < len(ib):
            heapq.heappush(heap, (a[ia[i]] + b[ib[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(ia):
            heapq.heappush(heap, (a[ia[i + 1]] + b[ib[0]], i + 1, 0))


def matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sample_matrix(reps: DataFrame, rows: int = SAMPLE) -> np.ndarray | None:
    """At most ``rows`` distinct vectors, of lowest hash, of the most common length."""
    got = reps.select("v").orderBy(F.xxhash64(F.lit(3), "v"), "v").limit(rows).collect()
    if not got:
        return None
    lengths = [len(r["v"]) for r in got]
    most = max(set(lengths), key=lambda n: (lengths.count(n), n))
    return matrix([bytes(r["v"]) for r in got if len(r["v"]) == most])


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys in rows that are sorted by them; a long run comes in several pieces."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = [*np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(at, at[1:], strict=False):
            yield tuple(c[i] for c in cols), b.slice(i, j - i)


def calibrate(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float) -> float:
    """Part of all vectors that the traversal must reach for this recall, measured within the sample; all of them for 1."""
    if recall >= 1:
        return 1.0
    half = books[0].shape[1]
    q = x[:: max(1, len(x) // 256)][:256]
    score = q @ x.T
    guess = (q[:, :half] @ books[0].T)[:, nearest(x[:, :half], books[0])] + (q[:, half:] @ books[1].T)[:, nearest(x[:, half:], books[1])]
    k = min(k, len(x))
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.sort(-guess, axis=1)
    rank = np.stack([np.searchsorted(order[i], -guess[i, top[i]], side="right") for i in range(len(q))]) / len(x)
    return float(np.quantile(rank, recall))


def n_centroids(vectors: int, sample: int, per_cell: int) -> int:
    """Centroids of each half, so that the product grid has about ``per_cell`` vectors a cell; at most one for 8 of the sample."""
    return max(1, min(math.isqrt(vectors // per_cell), sample // 8))


def search(
    df: DataFrame, query_ids, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", per_cell: int = 12, recall: float = 0.95, block_rows: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found for each query.

    ``query_ids`` is a condition on the column id. A query's own id is no
    candidate, copies of its vector under other ids are. Ties go to smaller
    ids. The traversal goes on until it has reached the part of all distinct
    vectors that gave ``recall`` on the codebooks' sample, whatever the table's
    size. Null, zero and non-finite vectors and null ids take no part, nor do
    vectors of another length than most; with too few candidates there are
    fewer rows. Rows that repeat id and vector count once; an id with several
    vectors is found by each. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = dense(df, id_col, vec_col).distinct()
    # a query's own id takes as many places as it has vectors: one, where ids are
    most = rows.where(query_ids).groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    k_out, k = k, k + most - 1
    # copies: the k + 1 smallest ids of each vector are all that can be among k nearest
    first = Window.partitionBy("v").orderBy("id")
    reps = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    reps = reps.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.xxhash64("v"))
    reps = stash(reps, "imi-reps")
    sample = sample_matrix(reps)
    out_schema = "query_id long, rank int, vec_id long, score double"
    if sample is None:
        return spark.createDataFrame([], out_schema)
    width = sample.shape[1]
    half = max(1, width // 2)
    n = n_centroids(reps.count(), len(sample), per_cell)
    books = kmeans(sample[:, :half], n, 1), kmeans(sample[:, half:], n, 2) if width > half else np.zeros((1, 0))
    part = calibrate(sample, books, k + 1, recall)
    n2 = len(books[1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([len(x) == 8 * width for x in b.column("v").to_pylist()], pa.bool_())
            b = b.filter(keep)
            if not b.num_rows:
                continue
            x = matrix(b.column("v").to_pylist())
            cell = nearest(x[:, :half], books[0]) * n2 + (nearest(x[:, half:], books[1]) if n2 > 1 else 0)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), b.column("ids"), pa.array(cell.astype(np.int32))], names=["rep", "v", "ids", "cell"])

    index = stash(reps.select("rep", "v", "ids").mapInArrow(cells, "rep long, v binary, ids array<long>, cell int"), "imi")
    sizes = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most centroids squared
    total = sum(sizes.values())
    goal = int(np.ceil(part * total))
    # blocks of neighbouring cells; a cell beyond a block's size takes several of its own
    first_block, parts, block, fill = {}, {}, -1, block_rows
    for c in sorted(sizes):
        if sizes[c] > block_rows:
            first_block[c], parts[c] = block + 1, -(-sizes[c] // block_rows)
            block, fill = block + parts[c], block_rows
        else:
            if fill + sizes[c] > block_rows:
                block, fill = block + 1, 0
            first_block[c], parts[c], fill = block, 1, fill + sizes[c]
    of_rep = stash(rows.where(query_ids).join(index.select(F.col("v").alias("_v"), "rep"), F.col("v") == F.col("_v")).select("id", "rep", "v"), "imi-queries")
    queries = of_rep.select("rep", "v").distinct()
    layout = spark.sparkContext.broadcast((books, sizes, first_block, parts))  # at most centroids squared entries

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, start, n_parts = layout.value
        for b in batches:
            cell, rep = b.column("cell").to_numpy(), b.column("rep").to_numpy()
            at = np.array([start[c] + (r * 0x9E3779B97F4A7C15 >> 20) % n_parts[c] for c, r in zip(cell.tolist(), rep.tolist(), strict=True)], np.int64)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.zeros(n, np.int32)), b.column("rep"), b.column("v"), b.column("ids"), pa.array([c.to_bytes(4, "little") for c in cell.tolist()], pa.binary())],
                names=["block", "kind", "rep", "v", "ids", "cells"],
            )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c1, c2), n_rows, start, n_parts = layout.value
        for b in batches:
            x = matrix(b.column("v").to_pylist())
            s1, s2 = -(x[:, :half] @ c1.T), -(x[:, half:] @ c2.T)
            for i, (rep, v) in enumerate(zip(b.column("rep").to_pylist(), b.column("v").to_pylist(), strict=True)):
                reached, to = 0, {}
                for _, p, q in multi_sequence(s1[i], s2[i]):
                    c = p * n2 + q
                    if c in n_rows:
                        for s in range(n_parts[c]):
                            to.setdefault(start[c] + s, []).append(c)
                        reached += n_rows[c]
                        if reached >= goal:
                            break
                n = len(to)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(to), pa.int64()), pa.array(np.ones(n, np.int32)), pa.array([rep] * n, pa.int64()), pa.array([v] * n, pa.binary()), pa.array([None] * n, pa.list_(pa.int64())),
                     pa.array([np.array(x, "<i4").tobytes() for x in to.values()], pa.binary())],
                    names=["block", "kind", "rep", "v", "ids", "cells"],
                )

    shape = "block long, kind int, rep long, v binary, ids array<long>, cells binary"
    held = index.mapInArrow(place, shape)
    # by work, not by size: traversal and scoring take long for few bytes, so small partitions are not merged
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = queries.repartition(tasks, "rep").mapInArrow(visit, shape)
    # the index moves once; a query goes to the blocks that it visits, and streams past what they hold
    dealt = held.unionByName(asked).repartition(tasks, "block").sortWithinPartitions("block", "kind")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buffer, ready = None, [], None
        for (block, kind), b in by_key(batches, ["block", "kind"]):
            if block != now:
                now, buffer, ready = block, [], None
            if kind == 0:
                buffer.append(b)
                continue
            if not buffer:
                continue
            if ready is None:
                x = matrix([v for p in buffer for v in p.column("v").to_pylist()])
                own = np.frombuffer(b"".join(c for p in buffer for c in p.column("cells").to_pylist()), "<i4")
                ids = [i for p in buffer for i in p.column("ids").to_pylist()]
                ready = x, own, ids, np.linalg.norm(x, axis=1).max()
            x, own, ids, longest = ready
            top_id, n_own = np.array([i[0] for i in ids]), int(own.max()) + 1
            reps, qs, lists = b.column("rep").to_pylist(), matrix(b.column("v").to_pylist()), b.column("cells").to_pylist()
            for at in range(0, len(reps), 256):
                near = qs[at : at + 256] @ x.T
                out_q, out_s, out_i = [], [], []
                for r, rep in enumerate(reps[at : at + 256]):
                    allowed = np.zeros(n_own, bool)
                    cells_here = np.frombuffer(lists[at + r], "<i4")
                    allowed[cells_here[cells_here < len(allowed)]] = True
                    s = np.where(allowed[own], near[r], -np.inf)
                    if len(s) > k + 1:  # all that may tie with the last place: the margin is over what sums in another order differ by
                        margin = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(qs[at + r]) * longest
                        pick = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - margin)
                    else:
                        pick = np.arange(len(s))
                    pick = pick[np.isfinite(s[pick])]
                    exact = np.add.accumulate(qs[at + r] * x[pick], axis=1)[:, -1] if len(pick) else np.zeros(0)
                    best = []
                    for j in np.lexsort((top_id[pick], -exact)):
                        if len(best) > k and -exact[j] != best[-1][0]:
                            break
                        best += [(-exact[j], i) for i in ids[pick[j]][: k + 1]]
                    for negative, i in sorted(best)[: k + 1]:
                        out_q.append(rep)
                        out_s.append(-negative)
                        out_i.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_s, pa.float64()), pa.array(out_i, pa.int64())], names=["rep", "score", "vec_id"])

    found = dealt.mapInArrow(score, "rep long, score double, vec_id long")
    best = Window.partitionBy("rep").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    pairs = of_rep.select(F.col("id").alias("query_id"), "rep").join(found, "rep").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    pairs = pairs.where(F.col("query_id") != F.col("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k_out).select("query_id", "rank", "vec_id", "score")


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def link(
    df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", per_cell: int = 32, block_rows: int = 8192,
    max_lengths: int = 16,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Rows of one group (null groups take no part) link from a cosine of
    ``threshold`` on. For unit vectors that is a distance of at most
    sqrt(2 - 2 * threshold); a vector's traversal visits cells until the lower
    bounds of the distance in both halves add up to more, so its target recall
    is all. n_links counts other rows, copies included, of which links are
    counted, never listed. Rows that take no part, null ids among them, have
    no links and are kept alone. Vectors link with those of their own length
    only; each length has an index of its own. An empty table gives an empty
    result.
    """
    cols = [F.col(id_col).alias("id"), F.col(group_col).alias("g")]
    valid = dense(df.select(*cols, F.col(vec_col).alias("x")).where(F.col("g").isNotNull()), "id", "x", ["g"])
    # the bytes of equal vectors are equal: copies are one entry with a count
    reps = stash(valid.groupBy("g", "v").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("key", F.xxhash64("g", "v")), "link-reps")
    lengths = {r["w"]: r["n"] for r in reps.groupBy(F.octet_length("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").limit(max_lengths + 1).collect()}
    if not lengths:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if len(lengths) > max_lengths:
        raise ValueError(f"vectors of more than {max_lengths} lengths")
    found = None
    for w, n in lengths.items():
        own = _links_of_length(reps.where(F.octet_length("v") == w), n, threshold, per_cell, block_rows)
        found = own if found is None else found.unionByName(own)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found, "rep", "other")
    info = reps.select("g", "v", "rep", "m").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    info = info.select("g", "v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = valid.join(info, ["g", "v"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    # rows that take no part
    rest = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).alias("g"), F.col(vec_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0)
    rest = rest.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("g").isNotNull() & (F.size("e") > 0) & finite, F.lit(False)))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links_of_length(reps: DataFrame, n_reps: int, threshold: float, per_cell: int, block_rows: int) -> DataFrame:
    """rep, n, other: links among distinct vectors (g, v, rep, m) of one length; n counts rows, other is one of those linked."""
    sample = unit(sample_matrix(reps))
    width = sample.shape[1]
    half = max(1, width // 2)
    k = n_centroids(n_reps, len(sample), per_cell)
    books = kmeans(sample[:, :half], k, 1), kmeans(sample[:, half:], k, 2) if width > half else np.zeros((1, 0))
    n2 = len(books[1])
    radius2 = max(0.0, 2 - 2 * threshold) + 1e-9
    group_type = reps.schema["g"].dataType.simpleString()

    def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Squared lower bound of the distance from x to each centroid's region, by the plane between it and the nearest."""
        d2 = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        near = d2.argmin(1)
        apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-30))[near]
        low = np.maximum(0, (d2 - d2[np.arange(len(x)), near][:, None]) / (2 * apart))
        low[np.arange(len(x)), near] = 0
        return np.maximum(0, low - 1e-9) ** 2

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([len(x) == 8 * width for x in b.column("v").to_pylist()], pa.bool_()))
            if not b.num_rows:
                continue
            x = unit(matrix(b.column("v").to_pylist()))
            b1, b2 = bounds(x[:, :half], books[0]), bounds(x[:, half:], books[1]) if n2 > 1 else np.zeros((len(x), 1))
            own = b1.argmin(1) * n2 + b2.argmin(1)
            visits = []
            for i in range(len(x)):
                # bounds beyond the radius can't be part of a sum within it
                p, q = np.flatnonzero(b1[i] <= radius2), np.flatnonzero(b2[i] <= radius2)
                seen = []
                for s, a, c in multi_sequence(b1[i][p], b2[i][q]):
                    if s > radius2:
                        break
                    seen.append(p[a] * n2 + q[c])
                visits.append(np.array(seen, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("g"), b.column("rep"), b.column("m"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(visits, pa.binary())], names=["g", "rep", "m", "v", "cell", "visits"]
            )

    index = stash(reps.select("g", "rep", "m", "v").mapInArrow(cells, f"g {group_type}, rep long, m long, v binary, cell int, visits binary"), "link-index")
    # a group's cells, in order, fill blocks; one beyond a block's size takes several
    per = index.groupBy("g", "cell").agg(F.count("*").alias("n"))
    along = Window.partitionBy("g").orderBy("cell")
    per = per.withColumn("block", F.floor((F.sum("n").over(along) - F.col("n")) / block_rows).cast("int")).withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    per = stash(per, "link-cells")
    per_group = per.groupBy("g").agg(F.max("block").alias("blocks"), F.max("parts").alias("most"), F.sum("n").alias("total"))
    entries = index.join(per.select("g", "cell", "block", "parts"), ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    asked = index.join(per_group, "g")
    # a group of one block needs no map of its cells
    simple = asked.where((F.col("blocks") == 0) & (F.col("most") == 1)).withColumn("block", F.lit(0)).withColumn("part", F.lit(0))
    spread = asked.where((F.col("blocks") > 0) | (F.col("most") > 1)).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(5)), F.ceil(F.col("total") / block_rows)))
    # others stream past their group's map, of which there is one for block_rows rows
    map_of = per.groupBy("g").agg(F.collect_list(F.struct("cell", "block", "parts")).alias("map"))  # at most the grid's cells
    map_of = map_of.join(per_group.where((F.col("blocks") > 0) | (F.col("most") > 1)), "g").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / block_rows) - 1)))
    none = {"rep": "long", "m": "long", "v": "binary", "cell": "int", "visits": "binary"}
    map_of = map_of.select("g", "salt", F.lit(0).alias("kind"), "map", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    spread = spread.select("g", "salt", F.lit(1).alias("kind"), F.lit(None).cast("array<struct<cell:int,block:int,parts:int>>").alias("map"), *none)
    spread = map_of.unionByName(spread).repartition("g", "salt").sortWithinPartitions("g", "salt", "kind")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "rep", "m", "v", "cell"]
        where: dict[int, tuple[int, int]] = {}
        for (_, _, kind), b in by_key(batches, ["g", "salt", "kind"]):
            if kind == 0:
                where = {x["cell"]: (x["block"], x["parts"]) for x in b.column("map")[b.num_rows - 1].as_py()}
                continue
            rows, blocks, parts, visits = [], [], [], []
            for i, seen in enumerate(b.column("visits").to_pylist()):
                to: dict[tuple[int, int], list[int]] = {}
                for c in np.frombuffer(seen, "<i4").tolist():
                    if c in where:
                        for p in range(where[c][1]):
                            to.setdefault((where[c][0], p), []).append(c)
                for (block, part), cs in to.items():
                    rows.append(i)
                    blocks.append(block)
                    parts.append(part)
                    visits.append(np.array(cs, "<i4").tobytes())
            taken = b.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(visits, pa.binary()), pa.array(blocks, pa.int32()), pa.array(parts, pa.int32())], names=[*names, "visits", "block", "part"])

    shape = f"g {group_type}, rep long, m long, v binary, cell int, visits binary, block int, part int"
    names = ["g", "rep", "m", "v", "cell", "visits", "block", "part"]
    asked = simple.select(*names).unionByName(spread.mapInArrow(route, shape)).withColumn("kind", F.lit(1))
    held = entries.select(*names).withColumn("kind", F.lit(0))
    dealt = held.unionByName(asked).withColumn("home", F.xxhash64("g", "block", "part"))
    dealt = dealt.repartition("home").sortWithinPartitions("home", "kind").select("home", "kind", "rep", "m", "v", "cell", "visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buffer, state = None, [], None

        def hooks() -> Iterator[pa.RecordBatch]:
            """The entries' links, one to the root of each."""
            if state is not None:
                x, own, order, starts, weight, ids, parent = state
                roots = _find(parent)
                some = np.flatnonzero(roots != np.arange(len(roots)))
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.zeros(n, np.int64)), pa.array(ids[roots[some]])], names=["rep", "n", "other"])

        for (home, kind), b in by_key(batches, ["home", "kind"]):
            if home != now:
                yield from hooks()
                now, buffer, state = home, [], None
            if kind == 0:
                buffer.append(b)
                continue
            if not buffer:
                continue
            if state is None:
                x = unit(matrix([v for p in buffer for v in p.column("v").to_pylist()]))
                own = np.concatenate([p.column("cell").to_numpy() for p in buffer])
                order = np.argsort(own, kind="stable")
                x, own = x[order], own[order]
                kinds, starts = np.unique(own, return_index=True)
                spans = {int(c): (int(s), int(e)) for c, s, e in zip(kinds, starts, [*starts[1:], len(own)], strict=True)}
                weight = np.concatenate([p.column("m").to_numpy() for p in buffer])[order]
                ids = np.concatenate([p.column("rep").to_numpy() for p in buffer])[order]
                state = [x, own, order, spans, weight, ids, np.arange(len(ids))]
            x, own, order, spans, weight, ids, parent = state
            reps, qs, lists = b.column("rep").to_numpy(), unit(matrix(b.column("v").to_pylist())), b.column("visits").to_pylist()
            for at in range(0, len(reps), 512):
                q, here = qs[at : at + 512], reps[at : at + 512]
                by_cell: dict[int, list[int]] = {}
                for r in range(len(q)):
                    for c in np.frombuffer(lists[at + r], "<i4").tolist():
                        if c in spans:
                            by_cell.setdefault(c, []).append(r)
                qi, ei = [], []
                for c, members in by_cell.items():
                    s, e = spans[c]
                    near = q[members] @ x[s:e].T >= threshold
                    i, j = np.nonzero(near)
                    qi.append(np.array(members)[i])
                    ei.append(j + s)
                if not qi:
                    continue
                qi, ei = np.concatenate(qi), np.concatenate(ei)
                other = ids[ei] != here[qi]
                qi, ei = qi[other], ei[other]
                if not len(qi):
                    continue
                links = np.bincount(qi, weights=weight[ei], minlength=len(q)).astype(np.int64)
                # all entries that one query links share a root from here on
                roots = _find(parent)
                low = np.full(len(q), len(ids))
                np.minimum.at(low, qi, roots[ei])
                pairs = np.unique(roots[ei] * len(ids) + low[qi])
                for p in pairs.tolist():
                    a, c = p // len(ids), p % len(ids)
                    while roots[a] != a:
                        a = roots[a]
                    while roots[c] != c:
                        c = roots[c]
                    if a != c:
                        roots[max(a, c)] = min(a, c)
                state[6] = parent = _find(roots)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(here[some]), pa.array(links[some]), pa.array(ids[parent[low[some]]])], names=["rep", "n", "other"])
        yield from hooks()

    return stash(dealt.mapInArrow(compare, "rep long, n long, other long"), "links")
