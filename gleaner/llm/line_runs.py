"""Line deduplication against levelled sorted runs of line hashes.

Documents come in batches in the order of their ids. A batch's distinct line
hashes are merge-joined with the runs of all earlier batches: known ones lose
their lines, new ones stay with the smallest id of the batch and become a run
of their own, sorted by hash. When a level holds ``fanout`` runs they are
merged into one run of the next level, so a batch meets only logarithmically
many runs. Runs are tables in the shared folder, bucketed and sorted by hash;
the driver holds their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, new_path, remove, slices, stash, trimmed

SPACE = b" \t\n\x0b\x0c\r"
LAST = 2**63 - 1  # stands for a null id, after every other
KEY_SCHEMA = "doc long, th long, h binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class LineRuns:
    """The runs: level -> tables of one column h, dealt into ``buckets`` by its hash and sorted in each.

    Tables of one number of buckets merge bucket by bucket: neither a lookup in
    the runs nor their compaction exchanges what they hold.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for runs in self.levels.values() for t in runs]

    def write(self, rows: DataFrame, name: str) -> str:
        """A sorted table of ``rows`` in the shared folder; its name."""
        path = new_path(self.spark, name)
        table = "gleaner_" + path.rpartition("-")[2]
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(table)
        self.paths[table] = path
        return table

    def forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, self.paths.pop(table))

    def mark_known(self, keys: DataFrame) -> DataFrame:
        """``keys`` (with h) with known: whether a run holds h. Each run is merged in by its order."""
        known = F.lit(False)
        for i, run in enumerate(self.tables()):
            keys = keys.join(run.withColumn(f"_in{i}", F.lit(True)).hint("merge"), "h", "left")
            known = known | F.col(f"_in{i}").isNotNull()
        return keys.withColumn("known", known).drop(*[c for c in keys.columns if c.startswith("_in")])

    def merged(self, tables: list[str]) -> DataFrame:
        """One run of several, which hold no hash twice: their sorted buckets are merged."""
        out = self.spark.table(tables[0])
        for t in tables[1:]:
            other = self.spark.table(t).withColumnRenamed("h", "_h")
            out = out.join(other.hint("merge"), out["h"] == F.col("_h"), "full").select(F.coalesce("h", "_h").alias("h"))
        return out

    def add(self, hashes: DataFrame) -> None:
        self.levels.setdefault(0, []).append(self.write(hashes.select("h"), "run0"))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:  # compaction
            old = self.levels.pop(level)
            self.levels.setdefault(level + 1, []).append(self.write(self.merged(old), f"run{level + 1}"))
            for t in old:
                self.forget(t)
            level += 1

    def drop(self) -> None:
        for runs in self.levels.values():
            for t in runs:
                self.forget(t)
        self.levels = {}


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, th, h: the distinct line keys of each row; th is the hash of its text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, 2)):
            rows, out = [], []
            for i, text in enumerate(batch.column(2)):
                found = {line_key(x, min_chars) for x in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")} - {None}
                rows += [i] * len(found)
                out += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], names=["doc", "th", "h"])

    return docs.select(_doc(id_col), _text_hash(text_col), F.col(text_col).alias("text")).mapInArrow(trimmed(hashes), KEY_SCHEMA)


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col)).alias("th")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2, digest: bool = False
) -> DataFrame:
    """``docs`` with repeated lines dropped, plus line_count and lines_dropped.

    Keys of at least ``min_chars`` code points that two or more documents hold
    lose their lines in all but the smallest id. A null or empty text is one
    empty line; rows with the same id count as one document; null ids count as
    one document after all others. Other columns pass through; columns named
    line_count, lines_dropped or kept_sha256 are replaced. With ``digest`` the
    text is replaced by kept_sha256, so that kept texts never leave the worker.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys = line_keys(docs, id_col, text_col, min_chars)
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or []
    batch = sum((F.col("doc") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    keys = stash(keys.withColumn("batch", F.lit(0) + batch), "line-keys", by=["batch"])
    runs, resolved, held = LineRuns(spark, fanout), None, []
    for i in range(len(cuts) + 1):
        # where two cuts fall on one id, a batch may be empty; it is no special case
        own = keys.where(F.col("batch") == i).groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        held.append(runs.write(runs.mark_known(own), "line-batch"))
        own = spark.table(held[-1])
        if i < len(cuts):
            runs.add(own.where(~F.col("known")))
        own = own.where(F.col("known") | (F.col("first") < F.col("last"))).select("h", "first", "known", F.lit(i).alias("batch"))
        resolved = own if resolved is None else resolved.unionByName(own)
    runs.drop()
    lost = keys.join(resolved, ["batch", "h"]).where(F.col("known") | (F.col("doc") > F.col("first")))
    # by id and text: null ids share an id, and their lost lines no row
    lost = lost.groupBy(F.col("doc").alias("_dl_doc"), F.col("th").alias("_dl_th")).agg(F.collect_set("h").alias("_dl_lost"))  # at most a text's own lines
    lost = stash(lost, "line-lost")
    for t in held:
        runs.forget(t)
    drop(keys)
    return _drop_lines(docs, lost, id_col, text_col, min_chars, digest)


def _drop_lines(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, min_chars: int, digest: bool) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("line_count", "lines_dropped", "kept_sha256") and not (digest and c == text_col)]
    joined = docs.withColumn("_dl_text", F.col(text_col)).withColumn("_dl_id", _doc(id_col)).withColumn("_dl_hash", _text_hash(text_col))
    joined = joined.join(lost, (F.col("_dl_id") == F.col("_dl_doc")) & (F.col("_dl_hash") == F.col("_dl_th")), "left").select(*keep, "_dl_text", "_dl_lost")
    last = "kept_sha256" if digest else None
    fields = [joined.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", line_count long, lines_dropped long" + (", kept_sha256 string" if digest else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in slices(whole, len(keep))):
            counts, drops, texts = [], [], []
            losts = b.column(len(keep) + 1)
            for text, lost_here in zip(b.column(len(keep)), losts, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.split(b"\n")
                gone = set(lost_here.as_py()) if lost_here.is_valid else ()
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                counts.append(len(lines))
                drops.append(len(lines) - len(kept))
                out = raw if len(kept) == len(lines) else b"\n".join(kept)
                texts.append(hashlib.sha256(out).hexdigest() if last else (out.decode() if text.is_valid else None))
            columns = {c: b.column(i) for i, c in enumerate(keep)}
            if not last:
                columns[text_col] = pa.array(texts, pa.string())
            columns |= {"line_count": pa.array(counts, pa.int64()), "lines_dropped": pa.array(drops, pa.int64())}
            if last:
                columns[last] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(trimmed(cut), schema)
