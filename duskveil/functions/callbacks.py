"""Ready-made callbacks: functions from a Column to a Column, and a wrapper for opaque Python ones.

Each has a form for parsed values too (``on_values``), which contexts held as JSON text take.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ConfigurationError
from .jsonmask import plain_text


def both(on_columns: Callable[[Column], Column], on_values: Callable) -> Callable[[Column], Column]:
    """A callback with a form for Columns and one for parsed values."""

    def run(c: Column) -> Column:
        return on_columns(c)

    run.on_values = on_values
    return run


def constant(text: str) -> Callable[[Column], Column]:
    return both(lambda c: F.lit(text), lambda v: text)


def hashed(algorithm: str = "sha256", keep: int = 8) -> Callable[[Column], Column]:
    """The hex digest; its first ``keep`` characters and ``...``, or all of it where ``keep`` is 0."""
    how = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}
    if algorithm not in how:
        raise ConfigurationError("no such hash", algorithm=algorithm)

    def run(c: Column) -> Column:
        digest = how[algorithm](c.cast("string").cast("binary"))
        return F.concat(F.substring(digest, 1, keep), F.lit("...")) if keep > 0 else digest

    def value(v) -> str:
        digest = hashlib.new(algorithm, plain_text(v).encode()).hexdigest()
        return f"{digest[:keep]}..." if keep > 0 else digest

    return both(run, value)


def partial(start: int = 2, end: int = 2, char: str = "*") -> Callable[[Column], Column]:
    """All but the first and last characters masked; a text no longer than both together is masked whole."""
    if start < 0 or end < 0 or len(char) != 1:
        raise ConfigurationError("partial masks need counts of 0 or more and one character", start=start, end=end)

    def run(c: Column) -> Column:
        s = c.cast("string")
        n = F.length(s)
        tail = F.substring(s, -end, end) if end else F.lit("")
        return F.when(n <= start + end, F.repeat(F.lit(char), n)).otherwise(F.concat(F.substring(s, 1, start), F.repeat(F.lit(char), n - start - end), tail))

    def value(v) -> str:
        if isinstance(v, dict | list):
            return "[OBJECT]"
        s = plain_text(v)
        return char * len(s) if len(s) <= start + end else s[:start] + char * (len(s) - start - end) + s[len(s) - end :]

    return both(run, value)


def for_paths(paths: list[str], callback: Callable[[Column], Column]) -> dict[str, Callable[[Column], Column]]:
    return dict.fromkeys(paths, callback)


def opaque(function: Callable[[str], str], retry=None) -> Callable[[Column], Column]:
    """An opaque Python function of one text, over Arrow batches. Where it raises, the value stays; with ``retry`` (a
    ``recovery.Retry``), it is tried again and then takes the fallback. ``failed`` of the result tells, as a Column, where it raises."""

    def one(x):
        if x is None:
            return x
        if retry is not None:
            return retry.run(lambda: function(x), x).value
        try:
            return function(x)
        except Exception:  # noqa: BLE001  a callback's error must not stop the record
            return x

    def raises(x) -> bool:
        try:
            if x is not None:
                function(x)
            return False
        except Exception:  # noqa: BLE001  reported as an audit event
            return True

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    @F.pandas_udf("boolean")
    def failed(s: pd.Series) -> pd.Series:
        return s.map(raises).astype(bool)

    out = both(lambda c: run(c.cast("string")), lambda v: one(v if isinstance(v, str | dict | list) or v is None else plain_text(v)))
    out.failed = lambda c: failed(c.cast("string"))
    return out
