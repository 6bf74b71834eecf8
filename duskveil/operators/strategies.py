"""Strategies: prioritised ways to mask a value at a path. The first applicable one, by descending priority, wins.

A strategy answers, for a value's path (known when the plan is made) and its Column, whether it applies (a boolean
Column, or a plain bool) and what it makes of it. A manager compiles its strategies to one CASE expression per leaf of
the record.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions import validate
from duskveil.functions.constants import MASKED, TYPE_MASKS
from duskveil.functions.errors import ConfigurationError, PatternError
from duskveil.functions.patterns import Pattern, compiled

from . import rules as R
from .config import REGEX, REMOVE, FieldMask
from .processor import as_text, numeric, type_name

#: Lower bounds of the priority ranges that statistics name (fixed values).
PRIORITY_RANGES = ((90, "90-100 (Critical)"), (80, "80-89 (High)"), (60, "60-79 (Medium-High)"), (40, "40-59 (Medium)"), (20, "20-39 (Low-Medium)"), (0, "0-19 (Low)"))
TRUE_WORDS = ("1", "true", "on", "yes")
#: Stands in paths for a place or key that no path names.
SOME = "\0"


def path_matches(path: str, pattern: str) -> bool:
    """Equal, or a wildcard match; a star also crosses dots."""
    return path == pattern or "*" in pattern and re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), path, re.S) is not None


def reaches_below(pattern: str, under: str) -> bool:
    """Whether some path that begins with ``under`` may match."""
    start, star, _ = pattern.partition("*")
    return start.startswith(under) or bool(star) and under.startswith(start)


def retyped(value: Column, text: Column, kind: T.DataType) -> Column:
    """A masked text as the value's own type where it can be read as that; else the text decides the column's type."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.StructType | T.MapType | T.ArrayType):
        return F.coalesce(F.from_json(text, kind.json()), value)
    return F.coalesce(F.expr("null").cast(kind), text.try_cast(kind.simpleString()))


def value_preview(value: Column, kind: T.DataType, most: int = 100) -> Column:
    """The beginning of a value as text, for messages."""
    text = as_text(value, kind)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


@dataclass
class Strategy:
    """Base: ``applies`` and ``mask`` for a value of some type at some path."""

    priority: int = 50

    @property
    def name(self) -> str:
        return type(self).__name__

    def applies(self, path: str, value: Column, kind: T.DataType, schema: T.StructType) -> Column | bool:
        raise NotImplementedError

    def mask(self, path: str, value: Column, kind: T.DataType) -> Column:
        raise NotImplementedError

    def check(self) -> None:
        """Raise if the configuration is no good."""

    def paths(self) -> list[str]:
        """The paths and path patterns that it asks for."""
        return []

    def shunned(self) -> list[str]:
        """Those that it leaves alone."""
        return []

    def configuration(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "priority"}


@dataclass
class RegexStrategy(Strategy):
    """Patterns on values as text. Excluded paths never, included paths (if any) only, and some pattern must match."""

    patterns: dict[str, str] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    priority: int = 60

    def check(self) -> None:
        if not self.patterns:
            raise ConfigurationError("a regex strategy needs patterns")
        for p in self.patterns:
            if not validate.valid_pattern(p, validate.DANGEROUS_IN_STRATEGIES):
                raise PatternError("a pattern is malformed or unsafe", pattern=p)

    def paths(self):
        return self.include

    def shunned(self):
        return self.exclude

    def applies(self, path, value, kind, schema):
        if any(path_matches(path, p) for p in self.exclude) or self.include and not any(path_matches(path, p) for p in self.include):
            return False
        text = as_text(value, kind)
        return reduce(lambda a, b: a | b, [text.rlike(p.java) for p in compiled(self.patterns)])

    def mask(self, path, value, kind):
        out = as_text(value, kind)
        for p in compiled(self.patterns):
            out = p.column(out)
        return retyped(value, out, kind)


@dataclass
class FieldPathStrategy(Strategy):
    """Field masks by path: an exact path first, then wildcards in order. A removed value is null."""

    fields: dict[str, FieldMask | str] = field(default_factory=dict)
    priority: int = 80

    def check(self) -> None:
        validate.check_paths(self.fields)
        if not self.fields:
            raise ConfigurationError("a field path strategy needs fields")
        for p, how in self.fields.items():
            if isinstance(how, FieldMask) and how.kind == REGEX and how.pattern is None:
                raise ConfigurationError("a regex field mask needs a pattern here", path=p)

    def paths(self):
        return list(self.fields)

    def _how(self, path: str) -> FieldMask | str | None:
        return self.fields.get(path) or next((how for p, how in self.fields.items() if path_matches(path, p)), None)

    def applies(self, path, value, kind, schema):
        return self._how(path) is not None

    def mask(self, path, value, kind):
        how = self._how(path)
        if isinstance(how, str):
            return F.lit(how)
        if how.kind == REMOVE:
            return F.lit(None).cast(kind)
        if how.kind == REGEX:
            return retyped(value, Pattern(how.pattern, how.replacement or MASKED).column(as_text(value, kind)), kind)
        name, text = type_name(kind), how.replacement
        if name in ("integer", "double") and numeric(text):
            return F.lit(int(float(text)) if name == "integer" else float(text)).cast(kind)
        return F.lit(text.lower() in TRUE_WORDS) if name == "boolean" else F.lit(text)


@dataclass
class DataTypeStrategy(Strategy):
    """A mask for each type of value. A boolean stays a boolean."""

    masks: dict[str, str] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    priority: int = 40

    @classmethod
    def defaults(cls) -> DataTypeStrategy:
        return cls(masks={k: v for k, v in TYPE_MASKS.items() if k != "resource"})

    @classmethod
    def sensitive_only(cls) -> DataTypeStrategy:
        return cls(masks={k: TYPE_MASKS[k] for k in ("string", "array", "object")})

    def check(self) -> None:
        if not self.masks:
            raise ConfigurationError("a type strategy needs masks")
        validate.check_type_masks({k: v or "-" for k, v in self.masks.items()})

    def paths(self):
        return self.include

    def shunned(self):
        return self.exclude

    def applies(self, path, value, kind, schema):
        if any(path_matches(path, p) for p in self.exclude) or self.include and not any(path_matches(path, p) for p in self.include):
            return False
        typed = value.isNotNull() if type_name(kind) in self.masks else F.lit(False)
        return typed | (value.isNull() if "NULL" in self.masks else F.lit(False))

    def mask(self, path, value, kind):
        name = type_name(kind)
        out = self._typed(self.masks[name], name, kind) if name in self.masks else value
        null = self.masks.get("NULL")
        if null and (name in ("NULL", "string") or name not in self.masks):
            return F.when(value.isNull(), F.lit(null)).otherwise(out.cast("string"))
        return F.when(value.isNotNull(), out)

    def _typed(self, m: str, name: str, kind: T.DataType) -> Column:
        if name in ("integer", "double"):
            return F.lit(int(float(m)) if name == "integer" else float(m)).cast(kind) if numeric(m) else F.lit(m)
        if name == "boolean":
            return F.lit(m.lower() in TRUE_WORDS)
        if name == "array":
            return F.array(*map(F.lit, parsed_list(m)))
        return F.struct(F.lit(m).alias("masked")) if name == "object" else F.lit(m)


def parsed_list(mask: str) -> list[str]:
    """An array mask: a JSON list, nothing, or parts between commas."""
    if mask[:1] == "[" and mask[-1:] == "]":
        try:
            return [x if isinstance(x, str) else json.dumps(x) for x in json.loads(mask)]
        except ValueError:
            pass
    return [] if mask in ("", "[]") else mask.strip("[]").split(",")


@dataclass
class CallbackStrategy(Strategy):
    """A function of Columns at a path (a wildcard unless ``exact``)."""

    path: str = ""
    callback: object = None
    exact: bool = True
    priority: int = 50

    def check(self) -> None:
        validate.check_callables({self.path: self.callback})

    def paths(self):
        return [self.path]

    def applies(self, path, value, kind, schema):
        return path == self.path if self.exact else path_matches(path, self.path)

    def mask(self, path, value, kind):
        return self.callback(value)


@dataclass
class ConditionalStrategy(Strategy):
    """Another strategy, where all (or any) of some rules hold. A rule that fails does not hold."""

    inner: Strategy | None = None
    rules: dict[str, R.Rule] = field(default_factory=dict)
    require_all: bool = True
    priority: int = 70

    def check(self) -> None:
        if not self.rules:
            raise ConfigurationError("a conditional strategy needs rules")
        validate.check_callables(self.rules)
        self.inner.check()

    def paths(self):
        return self.inner.paths()

    def shunned(self):
        return self.inner.shunned()

    def applies(self, path, value, kind, schema):
        joined = (R.all_of if self.require_all else R.any_of)(list(self.rules.values()))(schema)
        inner = self.inner.applies(path, value, kind, schema)
        return inner and joined if isinstance(inner, bool) else joined & inner

    def mask(self, path, value, kind):
        return self.inner.mask(path, value, kind)

    @classmethod
    def for_levels(cls, inner: Strategy, *levels: str) -> ConditionalStrategy:
        return cls(inner=inner, rules={"level": R.level_in(*levels)})

    @classmethod
    def for_channels(cls, inner: Strategy, *channels: str) -> ConditionalStrategy:
        return cls(inner=inner, rules={"channel": R.channel_in(*channels)})

    @classmethod
    def for_context(cls, inner: Strategy, **wanted) -> ConditionalStrategy:
        return cls(inner=inner, rules={k: R.field_equals(k, v) for k, v in wanted.items()})


class StrategyManager:
    def __init__(self, strategies: list[Strategy] | None = None):
        self.strategies: list[Strategy] = []
        for s in strategies or []:
            self.add(s)

    def add(self, strategy: Strategy) -> StrategyManager:
        strategy.check()
        self.strategies.append(strategy)
        return self

    def remove(self, strategy: Strategy) -> bool:
        kept = [s for s in self.strategies if s is not strategy]
        self.strategies, gone = kept, len(kept) < len(self.strategies)
        return gone

    def remove_kind(self, kind: type) -> int:
        kept = [s for s in self.strategies if not isinstance(s, kind)]
        n, self.strategies = len(self.strategies) - len(kept), kept
        return n

    def clear(self) -> StrategyManager:
        self.strategies = []
        return self

    @property
    def ordered(self) -> list[Strategy]:
        return sorted(self.strategies, key=lambda s: -s.priority)

    def check_all(self) -> dict[str, str]:
        """The names of strategies that are no good, and why."""
        out = {}
        for s in self.strategies:
            try:
                s.check()
            except Exception as e:  # noqa: BLE001  reported to the caller
                out[s.name] = str(e)
        return out

    @classmethod
    def defaults(cls, patterns: dict[str, str] | None = None) -> StrategyManager:
        return cls([RegexStrategy(patterns=patterns or {p.source: p.replacement for p in compiled()}), DataTypeStrategy.defaults()])

    def mask_value(self, path: str, value: Column, kind: T.DataType, schema: T.StructType) -> Column:
        """The value under the first strategy that applies. Where branches differ in type, the result is a text."""
        branches = []
        for s in self.ordered:
            when = s.applies(path, value, kind, schema)
            if when is False:
                continue
            branches.append((F.lit(True) if when is True else F.coalesce(when, F.lit(False)), s.mask(path, value, kind)))
            if when is True:
                break
        out = F.when(F.lit(False), value)
        for when, new in branches:
            out = out.when(when, new)
        if type_name(kind) in ("string", "array", "object"):
            return out.otherwise(value)
        out = F.when(F.lit(False), value.cast("string"))
        for when, new in branches:
            out = out.when(when, new.cast("string"))
        text = out.otherwise(value.cast("string"))
        same = all(isinstance(s, FieldPathStrategy | RegexStrategy) for s in self.strategies)
        return text.try_cast(kind.simpleString()) if same and branches else text if branches else value

    def applicable(self, path: str, value: Column, kind: T.DataType, schema: T.StructType) -> Column:
        """The names of the strategies that apply, by priority (array<string>)."""
        names = []
        for s in self.ordered:
            when = s.applies(path, value, kind, schema)
            names.append(F.when(F.lit(when) if isinstance(when, bool) else F.coalesce(when, F.lit(False)), F.lit(s.name)))
        return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")

    def mask(self, df: DataFrame, message: str = "message", context: str = "context") -> DataFrame:
        """The message, and every value of a typed context, under the strategies; paths are dotted, below the context. Elements of
        arrays have their places as names, entries of maps their keys. An array or map that no strategy looks into is a value itself."""
        schema = df.schema
        new = {}
        if message in df.columns:
            new[message] = self.mask_value("message", F.col(message), schema[message].dataType, schema)
        if context in df.columns:
            kind = schema[context].dataType
            if not isinstance(kind, T.StructType | T.MapType | T.ArrayType):
                raise ConfigurationError("strategies need a typed context: parse JSON text with from_json first", type=kind.simpleString())
            new[context] = self._walk(F.col(context), kind, "", schema)
        return df.withColumns(new)

    def _walk(self, value: Column, kind: T.DataType, path: str, schema: T.StructType) -> Column:
        under = f"{path}." if path else ""
        if isinstance(kind, T.StructType):
            parts = [self._walk(value.getField(f.name), f.dataType, f"{under}{f.name}", schema).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*parts))
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
        if inner is None or path and not any(reaches_below(p, under) for s in self.strategies for p in s.paths()):
            return self.mask_value(path, value, kind, schema)
        parts = [x for s in self.strategies for p in [*s.paths(), *s.shunned()] for x in p.split(".")]
        if isinstance(kind, T.MapType) and any("*" in x and x != "*" for x in parts):
            raise ConfigurationError("a star within a name can't be matched with a map's keys", path=path)
        names = [x for x in dict.fromkeys(parts) if x != "*" and (x.isdecimal() or isinstance(kind, T.MapType))]

        def entry(key: Column, v: Column) -> Column:
            out = self._walk(v, inner, f"{under}{SOME}", schema)
            for name in names:
                out = F.when(key == name, self._walk(v, inner, f"{under}{name}", schema)).otherwise(out)
            return out

        return F.transform_values(value, entry) if isinstance(kind, T.MapType) else F.transform(value, lambda x, k: entry(k.cast("string"), x))

    def statistics(self) -> dict:
        ranges = Counter(next(name for low, name in PRIORITY_RANGES if s.priority >= low or low == 0) for s in self.strategies)
        return {
            "total_strategies": len(self.strategies),
            "strategy_types": dict(Counter(s.name for s in self.strategies)),
            "priority_distribution": dict(ranges),
            "strategies": [{"name": s.name, "priority": s.priority, "configuration": s.configuration()} for s in self.strategies],
        }
