"""Predicates over records: a rule is a function from the DataFrame's schema to a boolean Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = Callable[[T.StructType], Column]


def level_in(*names: str, column: str = "level") -> Rule:
    """The level's name is one of these."""
    return lambda schema: F.col(column).isin(*names)


def channel_in(*names: str, column: str = "channel") -> Rule:
    return lambda schema: F.col(column).isin(*names)


def find(schema: T.StructType, path: str) -> tuple[T.DataType, Column, Column] | None:
    """(type, value, whether it is there) at a dotted path of structs and maps; None where the schema has no such path."""
    kind: T.DataType = schema
    value, there = None, F.lit(True)
    for name in path.split("."):
        if isinstance(kind, T.StructType):
            if name not in kind.names:
                return None
            kind = kind[name].dataType
            if value is not None:
                there = there & value.isNotNull()
            value = F.col(f"`{name}`") if value is None else value.getField(name)
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
            there = there & F.coalesce(F.map_contains_key(value, name), F.lit(False))
            value = F.try_element_at(value, F.lit(name))
        else:
            return None
    return kind, value, there


def variants(text: Column, path: str) -> list[Column]:
    """What JSON text may have at a dotted path, as VARIANT: a name that is a number is a key or a place in a list."""
    ways = ["$"]
    for name in path.split("."):
        key = f'["{name}"]' if "'" in name else f"['{name}']"
        ways = [w + step for w in ways for step in ([key, f"[{name}]"] if name.isdecimal() else [key])]
    parsed = F.try_parse_json(text)
    return [F.try_variant_get(parsed, w, "variant") for w in ways]


def _is_text(schema: T.StructType, context: str) -> bool:
    return context in schema.names and isinstance(schema[context].dataType, T.StringType)


def has_field(path: str, context: str = "context") -> Rule:
    """The context has the field, be its value null."""

    def rule(schema: T.StructType) -> Column:
        if _is_text(schema, context):
            return reduce(or_, [v.isNotNull() for v in variants(F.col(f"`{context}`"), path)])
        found = find(schema, f"{context}.{path}")
        return F.lit(False) if found is None else found[2]

    return rule


def field_equals(path: str, wanted, context: str = "context") -> Rule:
    """The field has this value, of this type; a value of another type never equals it. A field that is not there is null."""
    kinds = {bool: T.BooleanType, int: T.IntegralType, float: T.FractionalType, str: T.StringType, type(None): T.DataType}
    names = {bool: "BOOLEAN", int: "BIGINT|INT|SMALLINT|TINYINT", float: "DOUBLE|FLOAT|DECIMAL.*", str: "STRING"}

    def in_text(found: list[Column]) -> Column:
        if wanted is None:
            return reduce(and_, [v.isNull() | F.is_variant_null(v) for v in found])
        cast = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(wanted)]
        return reduce(or_, [F.coalesce(F.schema_of_variant(v).rlike(f"^({names[type(wanted)]})$") & (F.try_variant_get(v, "$", cast) == F.lit(wanted)), F.lit(False)) for v in found])

    def rule(schema: T.StructType) -> Column:
        if _is_text(schema, context):
            return in_text(variants(F.col(f"`{context}`"), path))
        found = find(schema, f"{context}.{path}")
        if wanted is None:
            return F.lit(True) if found is None else ~found[2] | found[1].isNull()
        if found is None or not isinstance(found[0], kinds[type(wanted)]):
            return F.lit(False)
        return found[2] & found[1].eqNullSafe(F.lit(wanted))

    return rule


def all_of(rules: list[Rule]) -> Rule:
    """Every rule holds (an unknown answer doesn't); without rules, true."""
    return lambda schema: reduce(lambda a, b: a & b, [F.coalesce(r(schema), F.lit(False)) for r in rules], F.lit(True))


def any_of(rules: list[Rule]) -> Rule:
    return lambda schema: reduce(lambda a, b: a | b, [F.coalesce(r(schema), F.lit(False)) for r in rules], F.lit(False))


def custom(predicate: Callable[..., bool], *columns: str, on_error: bool = True) -> Rule:
    """An opaque Python predicate over columns, in Arrow batches. Where it raises, the rule counts as ``on_error``:
    true for a processor's rules, false for conditional strategies. ``failed`` of the rule tells where it raises."""
    import pandas as pd

    def one(*values):
        try:
            return bool(predicate(*values))
        except Exception:  # noqa: BLE001  a rule's error has a defined outcome
            return on_error

    def raises(*values):
        try:
            predicate(*values)
            return False
        except Exception:  # noqa: BLE001  reported as an audit event
            return True

    def over(each):
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([each(*v) for v in zip(*series)], dtype=bool)

        udf = pandas_udf(run, "boolean", PandasUDFType.SCALAR)
        return lambda schema: udf(*(F.col(c) for c in columns))

    from pyspark.sql.functions import PandasUDFType, pandas_udf

    rule = over(one)
    rule.failed = over(raises)
    return rule
