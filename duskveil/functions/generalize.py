"""Generalization of columns for anonymised tables, and the group sizes that k-anonymity asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quasi-identifiers that the default set generalizes, where a table has them (fixed values).
ADDRESS_FIELDS = ("zip_code", "postal_code")


def number_range(value: Column, size: int) -> Column:
    """The range of ``size`` numbers that holds the value, as ``low-high``."""
    low = (F.floor(value.cast("double") / size) * size).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + size - 1).cast("string"))


def age_range(value: Column, size: int = 10) -> Column:
    """As ``number_range``, of the whole years."""
    return number_range(F.when(value.cast("double") < 0, F.ceil(value.cast("double"))).otherwise(F.floor(value.cast("double"))), size)


def date_part(value: Column, precision: str = "month") -> Column:
    """The year, the quarter (2024-Q1) or the month (2024-03) of a date or its text."""
    shape = {"year": "yyyy", "quarter": "yyyy-'Q'q", "month": "yyyy-MM"}[precision]
    return F.date_format(F.try_to_timestamp(value.cast("string")), shape)


def prefix(value: Column, n: int = 3) -> Column:
    """The first ``n`` characters, then a star for each other one."""
    text = value.cast("string")
    return F.concat(F.substring(text, 1, n), F.repeat(F.lit("*"), F.greatest(F.length(text) - n, F.lit(0))))


class Anonymizer:
    """Generalizations by column, applied in the order they were added; nulls and missing columns stay."""

    def __init__(self):
        self.steps: list[tuple[str, Callable[[Column], Column]]] = []

    def register(self, field: str, how: Callable[[Column], Column]) -> Anonymizer:
        self.steps.append((field, how))
        return self

    def age(self, field: str, size: int = 10) -> Anonymizer:
        return self.register(field, lambda c: age_range(c, size))

    def date(self, field: str, precision: str = "month") -> Anonymizer:
        return self.register(field, lambda c: date_part(c, precision))

    def location(self, field: str, n: int = 3) -> Anonymizer:
        return self.register(field, lambda c: prefix(c, n))

    def numeric(self, field: str, size: int) -> Anonymizer:
        return self.register(field, lambda c: number_range(c, size))

    @classmethod
    def defaults(cls) -> Anonymizer:
        out = cls().age("age").date("birth_date", "year").date("created_at", "month")
        for f in ADDRESS_FIELDS:
            out.location(f)
        return out

    def anonymize(self, df: DataFrame) -> DataFrame:
        for field, how in self.steps:
            if field in df.columns:
                df = df.withColumn(field, how(F.col(field)))
        return df

    def audit(self, df: DataFrame) -> DataFrame:
        """An event (path, original_type, was_masked, operation) for each value that ``anonymize`` changes: ``k-anonymity.<field>``."""
        rows = []
        for field, how in self.steps:
            if field in df.columns:
                kind = df.schema[field].dataType.simpleString()
                changed = F.col(field).isNotNull() & ~how(F.col(field)).cast("string").eqNullSafe(F.col(field).cast("string"))
                rows.append(F.when(changed, F.struct(F.lit(f"k-anonymity.{field}").alias("path"), F.lit(kind).alias("original_type"), F.lit(True).alias("was_masked"), F.lit("data_type").alias("operation"))))
        if not rows:
            return df.limit(0).select(F.lit("").alias("path"), F.lit("").alias("original_type"), F.lit(False).alias("was_masked"), F.lit("").alias("operation"))
        return df.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("e")).select("e.*")


def group_sizes(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Each combination of quasi-identifiers with its size and whether that reaches k (an addition of this engine)."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("group_size")).withColumn("k_ok", F.col("group_size") >= k)
