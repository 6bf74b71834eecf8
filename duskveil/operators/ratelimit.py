"""Rate limiting by a sliding log: a call is allowed if fewer than ``limit`` allowed calls of its key lie in the last ``window`` seconds."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskveil.functions import validate
from duskveil.functions.errors import ConfigurationError

from .audit import operation_group

#: Calls allowed in a minute, by profile (fixed values).
PROFILES = {"strict": 50, "default": 100, "relaxed": 200, "testing": 1000}
PROFILE_WINDOW = 60


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column of a table has."""
    have = {c.lower() for c in taken}
    return [next(c for k in range(len(have) + 1) if (c := "_" * k + n) not in have) for n in names]


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, with or without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


class Log:
    """The allowed calls of one key: (second, how many), oldest first."""

    def __init__(self, limit: int, window: int, held: list[tuple[int, int]] | None = None):
        self.limit, self.window = limit, window
        self.held: deque[tuple[int, int]] = deque(held or [])
        self.n = sum(k for _, k in self.held)

    def take(self, second: int, calls: int) -> int:
        """How many of the calls in that second are allowed."""
        while self.held and self.held[0][0] <= second - self.window:
            self.n -= self.held.popleft()[1]
        ok = max(0, min(calls, self.limit - self.n))
        if ok:
            self.held.append((second, ok))
            self.n += ok
        return ok


@dataclass(frozen=True)
class RateLimiter:
    limit: int
    window: int

    def __post_init__(self):
        validate.check_limiter(self.limit, self.window)

    @classmethod
    def profile(cls, name: str = "default") -> RateLimiter:
        return cls(PROFILES.get(name, PROFILES["default"]), PROFILE_WINDOW)

    def allowed(self, events: DataFrame, key: str, second: str, order: str) -> DataFrame:
        """``events`` with ``allowed``. Calls of a key in the same second come in the order of ``order``.

        Calls are counted by key and second before anything else, so what a key's sequential pass reads is a row for each of
        its seconds with calls, whatever the number of calls. Calls without a key are limited together.
        """
        calls, nth, ok, k, s = fresh(events.columns, "calls", "nth", "ok", "key", "second")
        if "allowed" in events.columns:
            raise ConfigurationError("the events have a column named allowed already")
        per = events.groupBy(F.col(f"`{key}`").alias(k), F.col(f"`{second}`").alias(s)).agg(F.count(F.lit(1)).alias(calls))
        limit, window, kinds = self.limit, self.window, {f.name: f.dataType.simpleString() for f in events.schema.fields}

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            log = Log(limit, window)
            rows = pdf.sort_values(s, ignore_index=True)
            rows[ok] = [log.take(int(at), int(n)) for at, n in zip(rows[s], rows[calls])]
            return rows[[k, s, ok]]

        taken = per.groupBy(k).applyInPandas(run, f"`{k}` {kinds[key]}, `{s}` {kinds[second]}, `{ok}` long")
        ranked = events.withColumn(nth, F.row_number().over(Window.partitionBy(key, second).orderBy(order)))
        joined = ranked.join(taken, F.col(f"`{key}`").eqNullSafe(F.col(k)) & F.col(f"`{second}`").eqNullSafe(F.col(s)))
        return joined.select(*(F.col(f"`{c}`") for c in events.columns), (F.col(nth) <= F.col(ok)).alias("allowed"))

    def status(self, events: DataFrame, key: str, second: str, order: str, now: int | Column) -> DataFrame:
        """For each key at time ``now`` (seconds; a scalar subquery also): current_requests, remaining_requests, time_until_reset (seconds)."""
        live = self.allowed(events, key, second, order).where("allowed").where(F.col(second) > now - self.window)
        n = F.count(F.lit(1))
        return live.groupBy(key).agg(n.alias("current_requests"), F.greatest(F.lit(0), F.lit(self.limit) - n).alias("remaining_requests"), F.greatest(F.lit(0), F.min(second) + self.window - now).alias("time_until_reset"))


def limited_events(events: DataFrame, limiter: RateLimiter, second: str, order: str) -> DataFrame:
    """Audit events that may be written: limited by group of operations, with one warning event per group and minute
    that has denied ones (path ``rate_limit_exceeded``)."""
    (group,) = fresh(events.columns, "group")
    keyed = events.withColumn(group, operation_group(F.col("path")))
    judged = limiter.allowed(keyed, group, second, order)
    kept = judged.where("allowed").select(*(F.col(f"`{c}`") for c in events.columns))
    denied = judged.where("not allowed").select(F.col(group).alias("g"), F.col(f"`{second}`").alias("s"), F.col(f"`{order}`").alias("o"))
    warned = RateLimiter(1, 60).allowed(denied, "g", "s", "o").where("allowed")
    shape = {f.name: F.lit(None).cast(f.dataType) for f in events.schema.fields} | {"path": F.lit("rate_limit_exceeded"), second: F.col("s"), order: F.col("o")}
    return kept.unionByName(warned.select(*(shape[c].alias(c) for c in events.columns)))
