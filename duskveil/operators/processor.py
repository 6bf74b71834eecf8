"""The processor: a configuration compiled to one projection over ``message`` and ``context``.

A typed context (structs, maps, arrays) is walked when the plan is made, and each leaf becomes a native expression. Two ways
of walking, as the configuration has it: without field masks and callbacks, strings are masked by patterns first and by
their type only if those change nothing, containers may be masked by their type, and depth is bounded; with field masks
or callbacks, these come first, and what they did not touch is swept: strings of a masked type take that mask,
containers are always walked.

A context that is JSON text takes the same configuration, in Arrow batches: field masks, callbacks that have a form for parsed
values (``functions.callbacks``; others raise when the plan is made), and the sweep.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.errors import ConfigurationError
from duskveil.functions.jsonmask import GONE, ValueMasker, embedded_json, mask_context_json, mask_message, plain_text
from duskveil.functions.patterns import Pattern, apply_patterns, scrubbed_utf8

from . import rules as R
from .config import REGEX, REMOVE, REPLACE, Config, FieldMask, Plugin


def type_name(kind: T.DataType) -> str:
    for base, name in ((T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.NumericType, "double"), (T.StringType, "string"), (T.NullType, "NULL")):
        if isinstance(kind, base):
            return name
    return "array" if isinstance(kind, T.StructType | T.MapType | T.ArrayType) else "object"


def as_text(value: Column, kind: T.DataType) -> Column:
    """A value as a regex sees it: containers as JSON, true as 1, false and null as an empty text."""
    if isinstance(kind, T.StructType | T.MapType | T.ArrayType):
        return F.to_json(value)
    if isinstance(kind, T.BooleanType):
        return F.when(value, F.lit("1")).otherwise(F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def numeric(mask: str) -> bool:
    try:
        float(mask)
        return True
    except ValueError:
        return False


def has_bracket(value: Column, kind: T.DataType) -> Column:
    """Whether any text within the value holds an opening bracket."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value.contains("{") | value.contains("["), F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: has_bracket(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(value), lambda x: has_bracket(x, kind.valueType)), F.lit(False))
    out = F.lit(False)
    for f in kind.fields if isinstance(kind, T.StructType) else ():
        out = out | has_bracket(value.getField(f.name), f.dataType)
    return out


def json_leaves(value: Column, kind: T.DataType, masker: ValueMasker) -> Column:
    """An array or map with the JSON pass over each text in it. Only values with a bracket in some text leave the JVM."""

    def leaves(v):
        if isinstance(v, str):
            return masker.embedded(v)
        if isinstance(v, dict):
            return {k: leaves(x) for k, x in v.items()}
        return [leaves(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else json.dumps(leaves(json.loads(x)), ensure_ascii=False))

    if not has_text(kind):
        return value
    return F.when(has_bracket(value, kind), F.from_json(run(F.to_json(value, {"ignoreNullFields": "false"})), kind.json())).otherwise(value)


def has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_text(kind.valueType)
    return isinstance(kind, T.StringType) or isinstance(kind, T.StructType) and any(has_text(f.dataType) for f in kind.fields)


def readable(df: DataFrame, message: str) -> DataFrame:
    """A binary message as text, with U+FFFD for malformed bytes: patterns must see what lies around them."""
    if message in df.columns and isinstance(df.schema[message].dataType, T.BinaryType):
        return df.withColumn(message, scrubbed_utf8(F.col(message)))
    return df


class Processor:
    """Masks records. ``message`` and ``context`` name the two columns; all others pass through."""

    def __init__(self, config: Config | None = None, plugins: list[Plugin] | None = None):
        self.config = config or Config()
        self.plugins = plugins or []
        self.patterns = self.config.compiled
        self.masker = ValueMasker(self.patterns, self.config.type_masks, self.config.max_depth)
        self._inside = 0  # how many arrays and maps the walk is in: functions over their elements must be native

    # --- texts

    def message(self, value: Column, json: bool = True) -> Column:
        return mask_message(value, self.masker) if json else apply_patterns(value, self.patterns)

    # --- typed contexts

    def context(self, value: Column, kind: T.DataType) -> Column:
        """A context column of that type, masked."""
        if isinstance(kind, T.StringType):
            return mask_context_json(value, self._json_masker())
        if self.config.fields or self.config.callbacks:
            return self._sweep_container(value, kind, "")
        return self._container(value, kind, 0)

    def _json_masker(self) -> ValueMasker:
        """The masker of contexts held as JSON text."""
        named = {}
        for path, callback in self.config.callbacks.items():
            named[path] = getattr(callback, "on_values", None)
            if named[path] is None:
                raise ConfigurationError("this callback has no form for parsed values, which contexts held as JSON text need", path=path)
        first = {path: named[path] if path in named else self._on_values(how) for path, how in self.config.fields.items()}
        return ValueMasker(self.patterns, self.config.type_masks, self.config.max_depth, first | named)

    def _on_values(self, how: FieldMask | str):
        """A field mask as a function of parsed values."""
        if isinstance(how, str):
            return lambda v: how
        if how.kind == REMOVE:
            return lambda v: GONE
        if how.kind == REGEX:
            masker, pattern = self.masker, None if how.pattern is None else Pattern(how.pattern, how.replacement)
            return lambda v: masker.message(plain_text(v)) if pattern is None else pattern.text(plain_text(v))
        return lambda v: how.replacement if how.kind == REPLACE else how.kind

    def _null(self, value: Column, out: Column, kind: T.DataType) -> Column:
        """A null under the mask for nulls, where there is one; else null."""
        m = self.config.type_masks.get("NULL", "preserve")
        if isinstance(kind, T.NullType):
            return value if m == "preserve" else F.lit(m)
        if m == "preserve" or type_name(kind) == "array":
            return F.when(value.isNotNull(), out)
        return F.when(value.isNull(), F.lit(m)).otherwise(out.cast("string"))

    def _typed(self, value: Column, kind: T.DataType) -> Column:
        """A scalar under the mask of its type."""
        name = type_name(kind)
        m = self.config.type_masks.get(name)
        if m is None or name in ("NULL", "array"):
            return value
        if name in ("integer", "double"):
            return F.lit(int(float(m)) if name == "integer" else float(m)).cast(kind) if numeric(m) else F.lit(m)
        if name == "boolean":
            return value if m == "preserve" else F.lit(m == "true") if m in ("true", "false") else F.lit(m)
        if name == "object":
            return F.struct(F.lit(m).alias("masked"), F.lit(kind.simpleString()).alias("original_class"))
        return F.lit(m)

    def _leaf(self, value: Column, kind: T.DataType) -> Column:
        if not isinstance(kind, T.StringType):
            return self._null(value, self._typed(value, kind), kind)
        masked = self.message(value, json=not self._inside)
        if "string" in self.config.type_masks:
            masked = F.when(masked != value, masked).otherwise(F.lit(self.config.type_masks["string"]))
        return self._null(value, masked, kind)

    def _value(self, value: Column, kind: T.DataType, depth: int) -> Column:
        if type_name(kind) != "array":
            return self._leaf(value, kind)
        m = self.config.type_masks.get("array")
        if m is not None and m != "recursive":
            return F.when(value.isNotNull(), F.array(F.lit(m)))
        return self._container(value, kind, depth + 1)

    def _container(self, value: Column, kind: T.DataType, depth: int) -> Column:
        """The values of a container masked; its keys stay. At the greatest depth it is left as it is."""
        if depth >= self.config.max_depth:
            return value
        return self._rebuilt(value, kind, lambda v, k, name: self._value(v, k, depth))

    def _rebuilt(self, value: Column, kind: T.DataType, each) -> Column:
        if isinstance(kind, T.ArrayType):
            return self._elements(value, kind, lambda v: F.transform(v, lambda x: each(x, kind.elementType, None)))
        if isinstance(kind, T.MapType):
            return self._elements(value, kind, lambda v: F.transform_values(v, lambda k, x: each(x, kind.valueType, None)))
        if not isinstance(kind, T.StructType) or not kind.fields:
            return value
        parts = [(f.name, each(value.getField(f.name), f.dataType, f.name)) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*(c.alias(n) for n, c in parts if c is not None)))

    def _elements(self, value: Column, kind: T.DataType, walk) -> Column:
        """An array or map walked by a native function; the JSON pass over its texts comes before, for all of them at once."""
        if not self._inside:
            value = json_leaves(value, kind, self.masker)
        self._inside += 1
        try:
            return walk(value)
        finally:
            self._inside -= 1

    def _sweep_container(self, value: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.MapType):
            return self._sweep_map(value, kind, path)
        if isinstance(kind, T.ArrayType):
            return self._sweep_list(value, kind, path)
        return self._rebuilt(value, kind, lambda v, k, name: self._sweep(v, k, f"{path}.{name}".lstrip(".")))

    def _below(self, path: str) -> dict[str, str]:
        """The names that configured paths go on with below ``path``, with the paths up to there."""
        under = f"{path}." if path else ""
        names = (p[len(under) :].split(".")[0] for p in [*self.config.fields, *self.config.callbacks] if p.startswith(under))
        return {n: f"{under}{n}" for n in names}

    def _goes(self, path: str) -> bool:
        how = self.config.fields.get(path)
        return path not in self.config.callbacks and isinstance(how, FieldMask) and how.kind == REMOVE

    def _chosen(self, key: Column, value: Column, kind: T.DataType, own: dict, path: str) -> Column:
        """An entry under the mask of its key, or of all others. All entries keep one type: a removed struct field is null here."""
        out = self._sweep(value, kind, f"{path}.*" if path else "*")
        for name, full in own.items():
            new = self._sweep(value, kind, full)
            if new is not None:
                out = F.when(key == name, new).otherwise(out)
        return out

    def _sweep(self, value: Column, kind: T.DataType, path: str) -> Column | None:
        """A field under its callback, its mask, or the sweep; None if it goes."""
        if path in self.config.callbacks:
            return self.config.callbacks[path](value)
        if path in self.config.fields:
            return self.field(value, kind, self.config.fields[path])
        if type_name(kind) == "array":
            return self._sweep_container(value, kind, path)
        if isinstance(kind, T.StringType) and "string" in self.config.type_masks:
            return self._null(value, F.lit(self.config.type_masks["string"]), kind)
        return self._leaf(value, kind)

    def _sweep_map(self, value: Column, kind: T.MapType, path: str) -> Column:
        """A map's entries by key: configured keys by name, all others swept."""
        own = self._below(path)
        gone = [n for n, p in own.items() if self._goes(p)]
        kept = F.map_filter(value, lambda k, v: ~k.isin(gone)) if gone else value
        return self._elements(kept, kind, lambda v: F.transform_values(v, lambda k, x: self._chosen(k, x, kind.valueType, own, path)))

    def _sweep_list(self, value: Column, kind: T.ArrayType, path: str) -> Column:
        """An array's elements by place."""
        own = {n: p for n, p in self._below(path).items() if n.isdecimal()}
        gone = [int(n) for n, p in own.items() if self._goes(p)]
        out = self._elements(value, kind, lambda v: F.transform(v, lambda x, k: self._chosen(k.cast("string"), x, kind.elementType, own, path)))
        return F.filter(out, lambda x, k: ~k.isin(gone)) if gone else out

    def field(self, value: Column, kind: T.DataType, how: FieldMask | str) -> Column | None:
        if isinstance(how, str):
            return F.lit(how)
        if how.kind == REMOVE:
            return F.lit(None).cast(kind) if self._inside else None
        if how.kind == REGEX and how.pattern is None:
            return self.message(as_text(value, kind), json=not self._inside)
        if how.kind == REGEX:
            return Pattern(how.pattern, how.replacement).column(as_text(value, kind))
        return F.lit(how.replacement if how.kind == REPLACE else how.kind)

    # --- records

    def condition(self, schema: T.StructType) -> Column:
        return R.all_of(list(self.config.rules.values()))(schema)

    def mask(self, df: DataFrame, message: str = "message", context: str = "context") -> DataFrame:
        """The records masked where all rules hold, others as they are. Plugins' steps run for all.

        Where masking changes the context's type and there are rules, records of both kinds must share a column: the context is then JSON text.
        """
        df = readable(df, message)
        for p in self.plugins:
            df = p.before_context(df)
            if message in df.columns:
                df = df.withColumn(message, p.before_message(F.col(message)))
        gate = self.condition(df.schema) if self.config.rules else None
        new = {}
        if message in df.columns:
            new[message] = self.message(F.col(message))
        if context in df.columns:
            new[context] = self.context(F.col(context), df.schema[context].dataType)
        if gate is not None:
            shape = df.select(*(c.alias(n) for n, c in new.items())).schema
            for n, c in new.items():
                same = shape[n].dataType.simpleString() == df.schema[n].dataType.simpleString()
                new[n] = F.when(gate, c if same else F.to_json(c)).otherwise(F.col(n) if same else F.to_json(F.col(n)))
        df = df.withColumns(new)
        for p in reversed(self.plugins):
            df = p.after_context(df)
            if message in df.columns:
                df = df.withColumn(message, p.after_message(F.col(message)))
        return df

    def audit(self, df: DataFrame, message: str = "message", context: str = "context") -> DataFrame:
        """Events of the records: path, original_type, was_masked, operation. Values are not among them.

        ``conditional_skip`` and ``conditional_error`` of rules; ``malformed_utf8_scrubbed`` of a binary message; ``json_masked`` where JSON in a
        message changes; ``message``; each changed field of a context by its dotted path (arrays and maps as a whole, JSON text as
        ``context``); ``<path>_callback_error`` of callbacks that can tell; ``max_depth_reached`` for containers that lie too deep.
        """
        rows: list[Column] = []
        gate = self.condition(df.schema)

        def event(when: Column, path: str, kind: str, masked: bool, operation: str) -> None:
            rows.append(F.when(when, F.struct(F.lit(path).alias("path"), F.lit(kind).alias("original_type"), F.lit(masked).alias("was_masked"), F.lit(operation).alias("operation"))))

        if self.config.rules:
            event(~gate, "conditional_skip", "array", False, "conditional")
        for rule in self.config.rules.values():
            if hasattr(rule, "failed"):
                event(rule.failed(df.schema), "conditional_error", "string", False, "conditional")
        if message in df.columns:
            text = F.col(message)
            if isinstance(df.schema[message].dataType, T.BinaryType):
                event(gate & ~F.is_valid_utf8(text.cast("string")), "malformed_utf8_scrubbed", "string", False, "regex")
                text = scrubbed_utf8(text)
            event(gate & (embedded_json(text, self.masker) != text), "json_masked", "string", True, "json")
            event(gate & (self.message(text) != text), "message", "string", True, "regex")
        if context in df.columns:
            own = df.schema[context].dataType
            after = self.context(F.col(context), own)
            there = gate & F.col(context).isNotNull()
            for path, callback in self.config.callbacks.items():
                found = R.find(df.schema, f"{context}.{path}")
                if found is not None and hasattr(callback, "failed"):
                    event(there & found[2] & callback.failed(found[1]), f"{path}_callback_error", type_name(found[0]), False, "callback")
            for path, kind, changed, operation in self._changes(F.col(context), after, own, df.select(after.alias("c")).schema["c"].dataType, ""):
                event(there & changed, path, type_name(kind), True, operation)
            if not (self.config.fields or self.config.callbacks):
                for value in self._too_deep(F.col(context), own, 0):
                    event(there & value.isNotNull(), "max_depth_reached", "integer", False, "data_type")
        if not rows:
            return df.limit(0).select(F.lit("").alias("path"), F.lit("").alias("original_type"), F.lit(False).alias("was_masked"), F.lit("").alias("operation"))
        return df.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("e")).select("e.*")

    def _changes(self, was: Column, now: Column | None, kind: T.DataType, after: T.DataType | None, path: str) -> list[tuple[str, T.DataType, Column, str]]:
        """(path, type, whether it changes, operation) of each field."""
        named = path in self.config.fields or path in self.config.callbacks
        if not named and isinstance(kind, T.StructType) and isinstance(after, T.StructType):
            out = []
            for f in kind.fields:
                left = f.name in after.names
                out += self._changes(was.getField(f.name), now.getField(f.name) if left else None, f.dataType, after[f.name].dataType if left else None, f"{path}.{f.name}".lstrip("."))
            return out
        operation = "callback" if path in self.config.callbacks else "field_path" if named else "json" if not path else "regex" if type_name(kind) == "string" else "data_type"
        text = lambda c, k: F.to_json(c) if isinstance(k, T.StructType | T.MapType | T.ArrayType) else c.cast("string")
        changed = was.isNotNull() if now is None else ~text(was, kind).eqNullSafe(text(now, after))
        return [(path or "context", kind, changed, operation)]

    def _too_deep(self, value: Column, kind: T.DataType, depth: int) -> list[Column]:
        """The containers that are left as they are, as they lie at the greatest depth; those inside arrays and maps as their array or map."""
        if type_name(kind) != "array":
            return []
        if depth >= self.config.max_depth:
            return [value]
        if self.config.type_masks.get("array", "recursive") != "recursive":
            return []
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in self._too_deep(value.getField(f.name), f.dataType, depth + 1)]
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        return [value] if self._too_deep(F.lit(None).cast(inner), inner, depth + 1) else []
