"""Checks of patterns and of configuration values."""

from __future__ import annotations

import re

from .errors import ConfigurationError, PatternError, RateLimitError
from .patterns import Pattern

#: Shapes of patterns that may take exponential time (fixed values).
DANGEROUS = tuple(map(re.compile, (
    r"\([^)]*\+[^)]*\)\+",
    r"\([^)]*\*[^)]*\)\*",
    r"\([^)]*\+[^)]*\)\*",
    r"\([^)]*\*[^)]*\)\+",
    r"\([^|)]*\|[^|)]*\)\*",
    r"\([^|)]*\|[^|)]*\)\+",
    r"\(\([^)]*\+[^)]*\)[^)]*\)\+",
    r"\[[^\]]*\]\*\*",
    r"\[[^\]]*\]\+\+",
    r"\([^)]*\[[^\]]*\][^)]*\)\*",
    r"\([^)]*\[[^\]]*\][^)]*\)\+",
    r"\(\?\=[^)]*\)\([^)]*\)\+",
    r"\(\?\<[^)]*\)\([^)]*\)\+",
    r"\\w\+\*",
    r"\\w\*\+",
    r"\.\*\*",
    r"\.\+\+",
    r"\(\.\*\)\+",
    r"\(\.\+\)\*",
    r"\(\?.*\*.*\+",
    r"\(.*\*.*\).*\*",
    r"\(\.\*\s*\|\s*\.\*\)",
    r"\(\.\+\s*\|\s*\.\+\)",
    r"\([a-zA-Z0-9]+(\s*\|\s*[a-zA-Z0-9]+){2,}\)\*",
    r"\([a-zA-Z0-9]+(\s*\|\s*[a-zA-Z0-9]+){2,}\)\+",
)))

#: The shorter list that strategies check (fixed values).
DANGEROUS_IN_STRATEGIES = tuple(map(re.compile, (
    r"\([^)]*\+[^)]*\)[*+]",
    r"\([^)]*\*[^)]*\)[*+]",
    r"\([^)]*\+[^)]*\)\{[0-9,]+\}",
    r"\([^)]*\*[^)]*\)\{[0-9,]+\}",
    r"\(\.\*\s*\|\s*\.\*\)",
    r"\(\.\+\s*\|\s*\.\+\)",
    r"\([a-zA-Z0-9]+(\s*\|\s*[a-zA-Z0-9]+){2,}\)\*",
    r"\([a-zA-Z0-9]+(\s*\|\s*[a-zA-Z0-9]+){2,}\)\+",
)))


def valid_pattern(source: str, dangerous: tuple = DANGEROUS) -> bool:
    """Delimited, of a safe shape, and a regex that both engines compile."""
    if len(source) < 3 or any(d.search(source) for d in dangerous):
        return False
    try:
        p = Pattern(source)
        return p.python is not None and _java_compiles(p.java)
    except (PatternError, re.error):
        return False


def _java_compiles(regex: str) -> bool:
    """Whether Java compiles it; true where no session runs."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None:
        return True
    try:
        sc._jvm.java.util.regex.Pattern.compile(regex)
        return True
    except Exception:  # noqa: BLE001  py4j wraps Java's PatternSyntaxException
        return False


def check_patterns(patterns: dict[str, str]) -> None:
    for p, r in patterns.items():
        if not isinstance(p, str) or not p.strip():
            raise PatternError("a pattern is empty", pattern=p)
        if not isinstance(r, str):
            raise PatternError("a replacement is not a text", pattern=p)
        if not valid_pattern(p):
            raise PatternError("a pattern is malformed or unsafe", pattern=p)


#: Types that masks can be set for (fixed values).
TYPES = ("integer", "double", "string", "boolean", "NULL", "array", "object", "resource")


def check_type_masks(masks: dict[str, str]) -> None:
    for kind, m in masks.items():
        if kind not in TYPES:
            raise ConfigurationError("no such type", type=kind)
        if not isinstance(m, str) or not m.strip():
            raise ConfigurationError("a type's mask is empty", type=kind)


def check_paths(paths: dict) -> None:
    for p, config in paths.items():
        if not isinstance(p, str) or not p.strip():
            raise ConfigurationError("a field path is empty", path=p)
        if isinstance(config, str) and not config.strip():
            raise ConfigurationError("a field's replacement is empty", path=p)


def check_callables(named: dict) -> None:
    for p, f in named.items():
        if not isinstance(p, str) or not p.strip() or not callable(f):
            raise ConfigurationError("a callback or rule needs a name and a callable", name=p)


def check_max_depth(depth: int) -> None:
    if not 1 <= depth <= 1000:
        raise ConfigurationError("max_depth must lie in 1..1000", max_depth=depth)


def check_limiter(limit: int, window: int) -> None:
    if not 1 <= limit <= 1_000_000:
        raise RateLimitError("max_requests must lie in 1..1000000", max_requests=limit)
    if not 1 <= window <= 86_400:
        raise RateLimitError("window_seconds must lie in 1..86400", window_seconds=window)


def check_limiter_key(key: str) -> None:
    if not key.strip() or len(key) > 250 or re.search(r"[\x00-\x1F\x7F]", key):
        raise RateLimitError("a key must have 1 to 250 characters and no control characters", key=key[:50])
