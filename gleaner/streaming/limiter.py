"""The sliding-window limit and the per-document findings over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import language, statements
from ..operators.lines import F, tx


def rate_limit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", max_calls: int = 5, per_seconds: int = 60, idle_ms: int | None = None) -> DataFrame:
    """The batch limiter's decisions for a stream of events, as they arrive.

    A key's state is at most ``max_calls`` times. With ``idle_ms`` it goes when
    nothing came for so long; such a stream always has another batch to run, so
    a run over what is there must leave it out. Within a micro-batch events are
    taken in the order of their time.
    """
    key_type = events.schema[key].dataType.simpleString()

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([ts, order])
        out = []
        for t, o in zip(rows[ts], rows[order], strict=True):
            us = t.value // 1000
            calls = [c for c in calls if c >= us - per_seconds * 1_000_000]
            allowed = len(calls) < max_calls
            retry = 0.0 if allowed else max(0.0, (per_seconds * 1_000_000 - (us - calls[0])) / 1_000_000)
            if allowed:
                calls.append(us)
            out.append((k[0], o, t, allowed, retry))
        state.update((calls,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, order, ts, "allowed", "retry_after_s"])

    return events.select(key, order, ts).groupBy(key).applyInPandasWithState(
        decide, f"{key} {key_type}, {order} bigint, {ts} timestamp, allowed boolean, retry_after_s double", "calls array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    )


def line_stream(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, stripped, label, lang of a stream of documents: everything in-row, so it needs no state."""
    lines = docs.select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("i", "raw"))
    lines = lines.select("doc_id", (F.col("i") + 1).alias("line_no"), tx.strip(F.col("raw")).alias("stripped"))
    labelled = language.line_languages(lines.where(F.col("stripped") != ""))
    return labelled.select("doc_id", "line_no", "stripped", statements.statement_class(F.col("stripped"))["label"].alias("label"), "lang")
