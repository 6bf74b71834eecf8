"""Error messages without secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import mask
from .patterns import Pattern, apply_patterns, apply_text

#: What goes from an error message, in order (fixed values).
MESSAGE = (
    (r"/password=\S+/i", "password=***"),
    (r"/pwd=\S+/i", "pwd=***"),
    (r"/pass=\S+/i", "pass=***"),
    (r"/host=[\w\.-]+/i", "host=***"),
    (r"/server=[\w\.-]+/i", "server=***"),
    (r"/hostname=[\w\.-]+/i", "hostname=***"),
    (r"/user=\S+/i", "user=***"),
    (r"/username=\S+/i", "username=***"),
    (r"/uid=\S+/i", "uid=***"),
    (r"/api[_-]?key[=:]\s*\S+/i", "api_key=***"),
    (r"/token[=:]\s*\S+/i", "token=***"),
    (r"/bearer\s+\S+/i", "bearer ***"),
    (r"/sk_\w+/i", "sk_***"),
    (r"/pk_\w+/i", "pk_***"),
    (r"/\/[\w\/\.-]*\/(config|secret|private|key)[\w\/\.-]*/i", "/***/$1/***"),
    (r"/[a-zA-Z]:\\[\w\\.-]*\\(config|secret|private|key)[\w\\.-]*/i", "C:\\***\\$1\\***"),
    (r"/redis:\/\/[^@]*@[\w\.-]+:\d+/i", "redis://***:***@***:***"),
    (r"/mysql:\/\/[^@]*@[\w\.-]+:\d+/i", "mysql://***:***@***:***"),
    (r"/postgresql:\/\/[^@]*@[\w\.-]+:\d+/i", "postgresql://***:***@***:***"),
    (r"/secret[_-]?key[=:\s]+\S+/i", "secret_key=***"),
    (r"/jwt[_-]?secret[=:\s]+\S+/i", "jwt_secret=***"),
    (r"/\bsuper_secret_\w+/i", mask("SECRET")),
    (r"/\b[a-z_]*secret[a-z_]*[=:\s]+[\w\d_-]{10,}/i", "secret=***"),
    (r"/\b[a-z_]*key[a-z_]*[=:\s]+[\w\d_-]{10,}/i", "key=***"),
    (r"/\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b/", "***.***.***"),
)

#: What goes from the message of an audit event's error, in order (fixed values).
CONTEXT = (
    (r"/password[=:]\s*[^\s,;]+/i", "password=[REDACTED]"),
    (r"/secret[=:]\s*[^\s,;]+/i", "secret=[REDACTED]"),
    (r"/api[_-]?key[=:]\s*[^\s,;]+/i", "api_key=[REDACTED]"),
    (r"/token[=:]\s*[^\s,;]+/i", "token=[REDACTED]"),
    (r"/bearer\s+\S+/i", "bearer [REDACTED]"),
    (r"/:[^@]+@/", ":[REDACTED]@"),
    (r"/user[=:]\s*[^\s,;@]+/i", "user=[REDACTED]"),
    (r"/host[=:]\s*[^\s,;]+/i", "host=[REDACTED]"),
    (r"/\/(?:var|home|etc|usr|opt)\/[^\s:]+/", "/[PATH_REDACTED]"),
)

LIMIT, SUFFIX = 500, "... (truncated for security)"


def _all(table) -> list[Pattern]:
    return [Pattern(p, r) for p, r in table]


def sanitize_message(message: Column) -> Column:
    """The message scrubbed, and cut after 500 characters."""
    out = apply_patterns(message, _all(MESSAGE))
    return F.when(F.length(out) > LIMIT, F.concat(F.substring(out, 1, LIMIT), F.lit(SUFFIX))).otherwise(out)


def sanitize_context_error(message: Column) -> Column:
    return apply_patterns(message, _all(CONTEXT))


def sanitize_text(message: str) -> str:
    out = apply_text(message, _all(MESSAGE))
    return out[:LIMIT] + SUFFIX if len(out) > LIMIT else out
