"""Errors of configuration and of masking."""

from __future__ import annotations


class MaskingError(Exception):
    """Base of all errors; ``context`` holds named details."""

    def __init__(self, message: str, **context):
        super().__init__(message if not context else f"{message} ({', '.join(f'{k}: {v}' for k, v in context.items())})")
        self.context = context


class PatternError(MaskingError):
    """A pattern is malformed or unsafe."""


class ConfigurationError(MaskingError):
    """A configuration value is missing or out of range."""


class RateLimitError(ConfigurationError):
    """A limiter's parameter or key is out of range."""


class OperationError(MaskingError):
    """A masking operation failed."""


class DepthError(OperationError):
    """A value is nested too deeply."""


class RuleError(MaskingError):
    """A conditional rule failed."""


class AuditError(MaskingError):
    """An audit event could not be written."""


class StreamError(MaskingError):
    """A streamed input or output could not be opened, parsed or written."""


class ServiceError(MaskingError):
    """A plugin or service could not be registered."""
