"""Retention policies: which rows are within their period at a given time, and what happens to the others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions.constants import REDACTED
from duskveil.functions.errors import ConfigurationError

ACTIONS = ("delete", "anonymize", "archive")


@dataclass(frozen=True)
class RetentionPolicy:
    name: str
    days: int
    action: str = "delete"
    fields: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.action not in ACTIONS or self.days < 0:
            raise ConfigurationError("no such action, or days below 0", action=self.action, days=self.days)

    @classmethod
    def delete_after(cls, days: int = 30, name: str = "delete") -> RetentionPolicy:
        return cls(name, days)

    @classmethod
    def archive(cls, days: int = 2555, name: str = "archive") -> RetentionPolicy:
        return cls(name, days, "archive")

    @classmethod
    def anonymize(cls, fields: list[str], days: int, name: str = "anonymize") -> RetentionPolicy:
        return cls(name, days, "anonymize", tuple(fields))

    def cutoff(self, as_of: Column) -> Column:
        return as_of - F.make_dt_interval(days=F.lit(self.days))

    def within(self, when: Column, as_of: Column) -> Column:
        return when >= self.cutoff(as_of)

    def apply(self, df: DataFrame, when: str, as_of: Column) -> DataFrame:
        """Rows kept or changed by the policy (declared actions are carried out by this engine): ``delete`` and ``archive`` keep what is
        within, ``anonymize`` redacts the fields of what is not."""
        ok = F.coalesce(self.within(F.col(when), as_of), F.lit(True))
        if self.action != "anonymize":
            return df.where(ok)
        return df.withColumns({f: F.when(ok, F.col(f).cast("string")).otherwise(F.lit(REDACTED)) for f in self.fields if f in df.columns})

    def archived(self, df: DataFrame, when: str, as_of: Column) -> DataFrame:
        """What an ``archive`` policy moves out."""
        return df.where(~F.coalesce(self.within(F.col(when), as_of), F.lit(True)))
