"""Driver-side helpers: try patterns on a text, describe a configuration."""

from __future__ import annotations

from duskveil.functions.patterns import Pattern
from duskveil.functions.validate import valid_pattern

from .config import Config


def try_patterns(text: str, patterns: dict[str, str]) -> dict:
    """masked, matches (by pattern, in the original text) and errors."""
    masked, matches, errors = text, {}, []
    for source, replacement in patterns.items():
        if not valid_pattern(source):
            errors.append(f"Invalid or unsafe pattern: {source}")
            continue
        p = Pattern(source, replacement)
        if found := [m[0] for m in p.python.finditer(text)]:
            matches[source] = found
        masked = p.text(masked)
    return {"masked": masked, "matches": matches, "errors": errors}


def describe(config: Config) -> dict:
    """Counts of what a configuration holds."""
    return {"patterns": len(config.patterns), "fields": len(config.fields), "callbacks": len(config.callbacks), "type_masks": len(config.type_masks), "rules": len(config.rules), "max_depth": config.max_depth}
