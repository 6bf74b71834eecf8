"""Masking of streams: stateless projections, statistics per micro-batch, and a stateful rate limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskveil.operators.processor import Processor
from duskveil.operators.ratelimit import Log, RateLimiter


@dataclass
class Statistics:
    processed: int = 0
    masked: int = 0
    errors: int = 0


def mask_stream(df: DataFrame, processor: Processor) -> DataFrame:
    """``message`` and ``context`` of each record, masked; other columns go, and rules are not asked. Works on batches and streams alike."""
    kept = [c for c in ("message", "context") if c in df.columns]
    out = df.select(*kept)
    new = {}
    if "message" in kept:
        new["message"] = processor.message(F.col("message"))
    if "context" in kept:
        new["context"] = processor.context(F.col("context"), out.schema["context"].dataType)
    return out.withColumns(new)


def statistics(df: DataFrame, processor: Processor) -> DataFrame:
    """One row: processed, masked (records that changed), errors."""
    kept = [c for c in ("message", "context") if c in df.columns]
    text = lambda c: F.to_json(F.struct(c))
    pairs = []
    for c in kept:
        new = processor.message(F.col(c)) if c == "message" else processor.context(F.col(c), df.schema[c].dataType)
        pairs.append(~text(F.col(c).alias("x")).eqNullSafe(text(new.alias("x"))))
    changed = pairs[0]
    for p in pairs[1:]:
        changed = changed | p
    return df.select(changed.alias("c")).agg(F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum(F.col("c").cast("long")), F.lit(0)).alias("masked"), F.lit(0).cast("long").alias("errors"))


def run_to(df: DataFrame, processor: Processor, write: Callable[[DataFrame, int], None], checkpoint: str, totals: Statistics | None = None, available_now: bool = True, events: Callable[[DataFrame, int], None] | None = None):
    """Start a query that masks each micro-batch, hands it to ``write``, and adds to ``totals``. ``events`` gets, for each micro-batch, an
    event ``streaming.processed`` with the number of its records."""

    def batch(part: DataFrame, n: int) -> None:
        write(mask_stream(part, processor), n)
        if events is not None:
            events(part.agg(F.count(F.lit(1)).alias("records")).select(F.lit("streaming.processed").alias("path"), "records"), n)
        if totals is not None:
            r = statistics(part, processor).first()
            totals.processed += r["processed"]
            totals.masked += r["masked"]

    writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def limit_stream(df: DataFrame, limiter: RateLimiter, key: str, second: str) -> DataFrame:
    """(key, second, calls, allowed) for each key and second of each micro-batch; the log of allowed calls is state.

    Seconds that come late are judged as if they came at the latest one seen. A key without calls for a window loses its state.
    """
    limit, window = limiter.limit, limiter.window

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seconds, counts, last = state.get if state.exists else ([], [], 0)
        log = Log(limit, window, list(zip(seconds, counts)))
        calls: dict[int, int] = {}
        for b in batches:
            for s, n in b[second].value_counts().items():
                calls[int(s)] = calls.get(int(s), 0) + int(n)
        rows = []
        for s in sorted(calls):
            last = max(last, s)
            rows.append((k[0], s, calls[s], log.take(last, calls[s])))
        state.update(([s for s, _ in log.held], [n for _, n in log.held], last))
        state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame(rows, columns=[key, second, "calls", "allowed"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(key, second).groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kinds[key]}, `{second}` {kinds[second]}, calls long, allowed long", "seconds array<bigint>, counts array<bigint>, last bigint", "append", "ProcessingTimeTimeout"
    )
