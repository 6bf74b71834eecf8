"""HTTP log records: header filter, body rules, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions.constants import FILTERED

from .processor import Processor

#: Headers whose values never appear in a log (fixed values).
SENSITIVE = ("authorization", "x-api-key", "x-auth-token", "cookie", "set-cookie", "php-auth-user", "php-auth-pw")
BODY_METHODS = ("POST", "PUT", "PATCH", "DELETE")
BODY_TYPES = ("application/json", "application/x-www-form-urlencoded", "multipart/form-data")
BODY_LIMIT = 1000


def filter_headers(headers: Column) -> Column:
    """A map<string, array<string>> with the values of sensitive headers replaced."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE), F.array(F.lit(FILTERED))).otherwise(v))


def request_body(method: Column, content_type: Column, body: Column) -> Column:
    """The body of methods that have one, of content types that are logged; else null."""
    typed = F.lit(False)
    for t in BODY_TYPES:
        typed = typed | F.coalesce(content_type, F.lit("")).contains(t)
    return F.when(method.isin(*BODY_METHODS) & typed, body)


def form_fields(fields: Column) -> Column:
    """The fields of a form (a map), less the token against forged requests."""
    return F.map_filter(fields, lambda k, v: k != "_token")


def response_body(body: Column, content_type: Column | None = None) -> Column:
    """JSON as it is, where it can be read as JSON; of other bodies, the first 1000 bytes."""
    raw = body.cast("binary")
    short = F.when(F.length(raw) > BODY_LIMIT, F.concat(F.make_valid_utf8(F.substring(raw, 1, BODY_LIMIT).cast("string")), F.lit("..."))).otherwise(body)
    if content_type is None:
        return short
    read = F.when(F.try_parse_json(body).isNotNull(), body).otherwise(F.lit('{"error":"Invalid JSON response"}'))
    return F.when(F.coalesce(content_type, F.lit("")).contains(BODY_TYPES[0]), read).otherwise(short)


def level_of(status: Column) -> Column:
    return F.when(status >= 500, F.lit("error")).when(status >= 400, F.lit("warning")).otherwise(F.lit("info"))


def mask_http(df: DataFrame, processor: Processor) -> DataFrame:
    """Every text, map and struct of an HTTP record masked, headers filtered first."""
    new = {}
    for f in df.schema.fields:
        value = filter_headers(F.col(f.name)) if f.name.endswith("headers") else F.col(f.name)
        new[f.name] = processor._value(value, f.dataType, 0)
    return df.withColumns(new)
