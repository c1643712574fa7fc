"""Redaction, and a sliding-window limit on calls."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def redact_documents(docs: DataFrame) -> DataFrame:
    """doc_id, redacted, n_emails, n_urls, n_phones, name_redacted, n_replacements."""
    d = docs.select("doc_id", tx.redact(F.coalesce("text", F.lit(""))).alias("r"))
    total = F.col("r.n_emails") + F.col("r.n_urls") + F.col("r.n_phones") + F.col("r.name").cast("int")
    return d.select("doc_id", F.col("r.text").alias("redacted"), "r.n_emails", "r.n_urls", "r.n_phones", F.col("r.name").alias("name_redacted"), total.alias("n_replacements"))


def redact_all(texts: Column) -> Column:
    """An array of texts, each redacted."""
    return F.transform(texts, lambda t: tx.redact(t)["text"])


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", max_calls: int = 5, per_seconds: int = 60) -> DataFrame:
    """key, order, ts, allowed, retry_after_s: at most ``max_calls`` allowed calls in any window of ``per_seconds``.

    Denied calls don't count; a call exactly per_seconds old still does. The
    decision depends on all before it, but a quiet time of more than
    per_seconds empties the window: a key's events are cut there into bursts,
    which are dealt apart. A burst streams through in order, and all that is
    held of it is its last ``max_calls`` allowed calls.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(key).alias("k"), F.col(order).cast("bigint").alias("o"), us.alias("t"))
    by = Window.partitionBy("k").orderBy("t", "o")
    period = per_seconds * 1_000_000
    quiet = F.coalesce(F.col("t") - F.lag("t").over(by) > period, F.lit(True))
    e = e.withColumn("burst", F.sum(quiet.cast("int")).over(by)).repartition("k", "burst").sortWithinPartitions("k", "burst", "t", "o")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, deque()
        for b in batches:
            allowed, wait = [], []
            for k, burst, t in zip(b.column("k").to_pylist(), b.column("burst").to_pylist(), b.column("t").to_pylist(), strict=True):
                if (k, burst) != now:
                    now, held = (k, burst), deque()
                while held and held[0] < t - period:
                    held.popleft()
                ok = len(held) < max_calls
                wait.append(0.0 if ok or not held else max(0.0, (period - (t - held[0])) / 1_000_000))
                allowed.append(ok)
                if ok:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("o"), b.column("t"), pa.array(allowed, pa.bool_()), pa.array(wait, pa.float64())], names=["k", "o", "t", "allowed", "retry"])

    done = e.mapInArrow(decide, f"k {e.schema['k'].dataType.simpleString()}, o long, t long, allowed boolean, retry double")
    return done.select(F.col("k").alias(key), F.col("o").alias(order), F.timestamp_micros("t").alias(ts), "allowed", F.col("retry").alias("retry_after_s"))
