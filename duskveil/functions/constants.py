"""Mask texts and limits."""

from __future__ import annotations

#: Labels of masks of the form ***LABEL*** (fixed values).
LABELS = (
    "INT", "FLOAT", "STRING", "BOOL", "NULL", "ARRAY", "OBJECT", "RESOURCE",
    "MASKED", "REDACTED", "FILTERED",
    "HETU", "SSN", "USSSN", "UKNI", "CASIN", "PASSPORT",
    "IBAN", "CC", "CARD", "UKBANK", "CABANK",
    "EMAIL", "PHONE", "IP", "IPv4", "IPv6",
    "TOKEN", "APIKEY", "SECRET", "DOB", "MAC", "VEHICLE", "MEDICARE", "EHIC",
    "INTERNAL", "CUSTOMER", "NUMBER", "ITEM", "INVALID", "TOOLONG", "ERROR",
)


def mask(label: str) -> str:
    """The mask text of a label."""
    if label not in LABELS:
        raise KeyError(label)
    return f"***{label}***"


GENERIC = "***"
MASKED, REDACTED, FILTERED = mask("MASKED"), mask("REDACTED"), mask("FILTERED")
MASKED_BRACKETS, REDACTED_BRACKETS = "[MASKED]", "[REDACTED]"
SSN_SHAPE, EMAIL_SHAPE = "***-**-****", "***@***.***"

#: The default mask of each value type (fixed values).
TYPE_MASKS = {
    "integer": mask("INT"),
    "double": mask("FLOAT"),
    "string": mask("STRING"),
    "boolean": mask("BOOL"),
    "NULL": mask("NULL"),
    "array": mask("ARRAY"),
    "object": mask("OBJECT"),
    "resource": mask("RESOURCE"),
}

MAX_DEPTH = 100
JSON_DEPTH = 512
