"""Configuration of a processor: field masks, the fluent builder, plugins."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from duskveil.functions import validate
from duskveil.functions.constants import MASKED, MAX_DEPTH
from duskveil.functions.errors import ConfigurationError
from duskveil.functions.patterns import DEFAULTS, Pattern, compiled

REGEX, REMOVE, REPLACE = "mask_regex", "remove", "replace"


@dataclass(frozen=True)
class FieldMask:
    """What happens to a field. ``mask_regex`` without a pattern uses the processor's own patterns."""

    kind: str
    replacement: str | None = None
    pattern: str | None = None

    @classmethod
    def remove(cls) -> FieldMask:
        return cls(REMOVE)

    @classmethod
    def replace(cls, text: str) -> FieldMask:
        return cls(REPLACE, text)

    @classmethod
    def processor_patterns(cls) -> FieldMask:
        return cls(REGEX)

    @classmethod
    def regex(cls, pattern: str, replacement: str = MASKED) -> FieldMask:
        if not pattern.strip() or not replacement.strip():
            raise ConfigurationError("a field's pattern and replacement must not be empty")
        validate.check_patterns({pattern: replacement})
        return cls(REGEX, replacement, pattern)

    @classmethod
    def from_dict(cls, raw: Mapping) -> FieldMask:
        kind = raw.get("type", REPLACE)
        if kind not in (REGEX, REMOVE, REPLACE):
            raise ConfigurationError("no such field mask", type=kind)
        if kind == REPLACE and not str(raw.get("replacement") or "").strip():
            raise ConfigurationError("a replacement is needed", type=kind)
        if kind == REGEX and raw.get("pattern"):
            return cls.regex(raw["pattern"], raw.get("replacement") or MASKED)
        return cls(kind, raw.get("replacement"))

    def to_dict(self) -> dict:
        return {k: v for k, v in (("type", self.kind), ("replacement", self.replacement), ("pattern", self.pattern)) if v is not None}


@dataclass
class Config:
    """All that a processor is made of; checked when made."""

    patterns: dict[str, str] = field(default_factory=lambda: dict(DEFAULTS))
    fields: dict[str, FieldMask | str] = field(default_factory=dict)
    callbacks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    type_masks: dict[str, str] = field(default_factory=dict)
    rules: dict[str, Callable] = field(default_factory=dict)
    max_depth: int = MAX_DEPTH

    def __post_init__(self):
        validate.check_patterns(self.patterns)
        validate.check_paths(self.fields)
        validate.check_callables(self.callbacks)
        validate.check_callables(self.rules)
        validate.check_type_masks(self.type_masks)
        validate.check_max_depth(self.max_depth)

    @property
    def compiled(self) -> list[Pattern]:
        return compiled(self.patterns)


#: Settings: the bounds of each number and its default (fixed values).
BOUNDS = {"max_depth": (1, 1000, 100), "chunk_size": (100, 10_000, 1000), "garbage_collection_threshold": (1000, 100_000, 10_000), "max_pattern_length": (10, 1000, 500), "max_field_path_length": (5, 500, 100)}
#: Switches and their defaults, and words that switch on (fixed values).
SWITCHES = {"audit_enabled": False, "allow_empty_patterns": False, "strict_regex_validation": True}
ON = ("1", "true", "on", "yes")
AUDIT_CHANNEL = "gdpr-audit"


def settings(given: Mapping[str, object]) -> dict[str, int | bool | str]:
    """Settings with numbers brought within their bounds (what is no number counts as 0), switches read, and defaults filled in."""
    out: dict[str, int | bool | str] = {}
    for name, (low, high, default) in BOUNDS.items():
        found = re.match(r"\s*[-+]?\d+", str(given.get(name, default)))
        out[name] = max(low, min(high, int(found[0]) if found else 0))
    for name, default in SWITCHES.items():
        out[name] = str(given.get(name, default)).strip().lower() in ON
    out["audit_channel"] = str(given.get("audit_channel", AUDIT_CHANNEL)).strip() or AUDIT_CHANNEL
    return out


class Plugin:
    """Contributions to a processor: patterns, field masks, and steps before and after it over DataFrames."""

    name = "plugin"
    priority = 100

    def patterns(self) -> dict[str, str]:
        return {}

    def fields(self) -> dict[str, FieldMask | str]:
        return {}

    def before_message(self, message: Column) -> Column:
        return message

    def after_message(self, message: Column) -> Column:
        return message

    def before_context(self, df: DataFrame) -> DataFrame:
        return df

    def after_context(self, df: DataFrame) -> DataFrame:
        return df


class Builder:
    """Builds a processor step by step. A key that is added again keeps its place and takes the new value."""

    def __init__(self):
        self._patterns: dict[str, str] = {}
        self._fields: dict = {}
        self._callbacks: dict = {}
        self._types: dict[str, str] = {}
        self._rules: dict = {}
        self._depth = MAX_DEPTH
        self._plugins: list[Plugin] = []

    def pattern(self, source: str, replacement: str) -> Builder:
        self._patterns[source] = replacement
        return self

    def patterns(self, more: Mapping[str, str]) -> Builder:
        self._patterns.update(more)
        return self

    def default_patterns(self) -> Builder:
        return self.patterns(dict(DEFAULTS))

    def field(self, path: str, how: FieldMask | str) -> Builder:
        self._fields[path] = how
        return self

    def fields(self, more: Mapping) -> Builder:
        self._fields.update(more)
        return self

    def callback(self, path: str, how: Callable[[Column], Column]) -> Builder:
        self._callbacks[path] = how
        return self

    def type_mask(self, kind: str, mask: str) -> Builder:
        self._types[kind] = mask
        return self

    def rule(self, name: str, how: Callable) -> Builder:
        self._rules[name] = how
        return self

    def max_depth(self, depth: int) -> Builder:
        self._depth = depth
        return self

    def plugin(self, plugin: Plugin) -> Builder:
        if not isinstance(plugin, Plugin):
            raise ConfigurationError("not a plugin", plugin=type(plugin).__name__)
        self._plugins.append(plugin)
        return self

    def config(self) -> Config:
        patterns, fields = dict(self._patterns), dict(self._fields)
        for p in sorted(self._plugins, key=lambda p: p.priority):
            patterns.update(p.patterns())
            fields.update(p.fields())
        return Config(patterns, fields, dict(self._callbacks), dict(self._types), dict(self._rules), self._depth)

    def build(self):
        from .processor import Processor

        return Processor(self.config(), sorted(self._plugins, key=lambda p: p.priority))
