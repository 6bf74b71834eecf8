"""Audit events: classification, structured contexts, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions.errors import ConfigurationError
from duskveil.functions.sanitize import sanitize_context_error

STATUSES = ("success", "failed", "recovered", "skipped")
OPERATIONS = ("regex", "field_path", "callback", "data_type", "json", "conditional")
#: What a path contains, and the group of operations it then belongs to; the first hit counts (fixed values).
GROUPS = (("json_", "json_operations"), ("conditional_", "conditional_operations"), ("regex_", "regex_operations"), ("preg_replace_", "regex_operations"), ("error", "error_operations"))
GENERAL = "general_operations"


def operation_group(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for part, group in GROUPS:
        out = out.when(path.contains(part), F.lit(group))
    return out.otherwise(F.lit(GENERAL))


def structured(events: DataFrame, operation: str, status: str = "success", attempt: int = 1, error: Column | None = None) -> DataFrame:
    """Events with a structured context: operation_type, status, attempt_number, correlation_id, and error (scrubbed)."""
    if status not in STATUSES or operation not in OPERATIONS:
        raise ConfigurationError("no such status or operation", status=status, operation=operation)
    parts = [F.lit(operation).alias("operation_type"), F.lit(status).alias("status"), F.lit(attempt).alias("attempt_number"), F.substring(F.sha2(F.uuid(), 256), 1, 16).alias("correlation_id")]
    parts.append((sanitize_context_error(error) if error is not None else F.lit(None).cast("string")).alias("error"))
    return events.withColumn("audit_context", F.struct(*parts))


def changed(events: DataFrame) -> DataFrame:
    """Only events (path, original, masked) whose value changed."""
    return events.where(~F.col("original").eqNullSafe(F.col("masked")))


def without_values(events: DataFrame, at: Column | None = None) -> DataFrame:
    """Events (path, original, masked) as (path, original_type, was_masked, timestamp): no value is kept."""
    kind = events.schema["original"].dataType.simpleString()
    return events.select("path", F.lit(kind).alias("original_type"), (~F.col("original").eqNullSafe(F.col("masked"))).alias("was_masked"), (at if at is not None else F.current_timestamp()).alias("timestamp"))


def counts_by_group(events: DataFrame) -> DataFrame:
    return events.groupBy(operation_group(F.col("path")).alias("operation_group")).agg(F.count(F.lit(1)).alias("n"))


def null_sink(events: DataFrame) -> None:
    events.write.format("noop").mode("overwrite").save()


def table_sink(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def callback_sink(events: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that hands each micro-batch of events to a callback; ``checkpoint``: where its progress is kept."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(callback).start()
