"""What happens when masking fails: failure modes, fallbacks by type, retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.constants import GENERIC, REDACTED, TYPE_MASKS
from duskveil.functions.errors import DepthError, OperationError
from duskveil.functions.jsonmask import value_type

from .processor import type_name


class FailureMode(Enum):
    OPEN = "fail_open"
    CLOSED = "fail_closed"
    SAFE = "fail_safe"


@dataclass(frozen=True)
class FallbackMask:
    custom: dict[str, str] = field(default_factory=dict)
    default: str = GENERIC
    by_type: bool = True

    def column(self, value: Column, kind: T.DataType, mode: FailureMode = FailureMode.SAFE) -> Column:
        """The fallback of a value, as text (or the value itself in open mode)."""
        if mode is FailureMode.OPEN:
            return value
        if mode is FailureMode.CLOSED:
            return F.lit(self.custom.get("closed", REDACTED))
        name = type_name(kind)
        if name in self.custom or not self.by_type:
            own: Column = F.lit(self.custom.get(name, self.default))
        elif name == "string":
            n = F.octet_length(value)
            own = F.when(n <= 10, F.lit(TYPE_MASKS[name])).otherwise(F.concat(F.lit(TYPE_MASKS[name] + " ("), n.cast("string"), F.lit(" chars)")))
        elif name == "array":
            n = F.lit(len(kind.fields)) if isinstance(kind, T.StructType) else F.size(value)
            own = F.when(n == 0, F.lit(TYPE_MASKS[name])).otherwise(F.concat(F.lit(TYPE_MASKS[name] + " ("), n.cast("string"), F.lit(" items)")))
        else:
            own = F.lit(TYPE_MASKS[name] + (f" ({kind.typeName()})" if name == "object" else ""))
        null = self.custom.get("NULL", TYPE_MASKS["NULL"] if self.by_type else self.default)
        return F.when(value.isNull(), F.lit(null)).otherwise(own)

    def value(self, v: Any, mode: FailureMode = FailureMode.SAFE) -> Any:
        if mode is FailureMode.OPEN:
            return v
        if mode is FailureMode.CLOSED:
            return self.custom.get("closed", REDACTED)
        name = value_type(v)
        if name in self.custom or not self.by_type:
            return self.custom.get(name, self.default)
        n = len(v.encode()) if name == "string" else len(v) if name == "array" else 0
        if name == "string" and n > 10:
            return f"{TYPE_MASKS[name]} ({n} chars)"
        return f"{TYPE_MASKS[name]} ({n} items)" if name == "array" and n else TYPE_MASKS[name]


@dataclass(frozen=True)
class Outcome:
    value: Any
    kind: str  # success, recovered or fallback
    attempts: int
    error: str | None = None


@dataclass(frozen=True)
class Retry:
    """Up to ``attempts`` tries with growing pauses, then the fallback. For opaque callbacks inside Python functions;
    lost executors and tasks are Spark's own concern."""

    attempts: int = 3
    base_ms: int = 10
    max_ms: int = 100
    mode: FailureMode = FailureMode.SAFE
    fallback: FallbackMask = field(default_factory=FallbackMask)

    @classmethod
    def none(cls, mode: FailureMode = FailureMode.SAFE) -> Retry:
        return cls(1, mode=mode)

    @classmethod
    def fast(cls) -> Retry:
        return cls(2, 5, 20)

    @classmethod
    def thorough(cls) -> Retry:
        return cls(5, 20, 200, FailureMode.CLOSED)

    def delay_ms(self, attempt: int, jitter: float = 0.0) -> float:
        """The pause after an attempt: doubled each time, a quarter of it at most as jitter, capped."""
        return min(self.base_ms * 2 ** (attempt - 1) * (1 + 0.25 * jitter), self.max_ms)

    @staticmethod
    def recoverable(error: BaseException) -> bool:
        if isinstance(error, DepthError):
            return False
        return not (isinstance(error, OperationError) and ("Pattern compilation failed" in str(error) or "ReDoS" in str(error)))

    def run(self, operation: Callable[[], Any], original: Any) -> Outcome:
        error: BaseException | None = None
        for attempt in range(1, self.attempts + 1):
            try:
                return Outcome(operation(), "success" if attempt == 1 else "recovered", attempt)
            except Exception as e:  # noqa: BLE001  every failure of a callback has an outcome here
                error = e
            if not self.recoverable(error):
                break
            if attempt < self.attempts:
                time.sleep(self.delay_ms(attempt, random.random()) / 1000)
        return Outcome(self.fallback.value(original, self.mode), "fallback", self.attempts, str(error))
