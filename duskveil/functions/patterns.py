"""Ordered regex patterns: parsing, translation to Java and Python, the 25 defaults, and the Column that applies them.

Patterns are written with delimiters and flags (``/…/iu``). Without ``u``, word boundaries and classes are ASCII; with ``u``
they are Unicode. A replacement may refer to groups as ``$1``, ``${1}`` or ``\\1``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce
from operator import or_
from re import _constants as K  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import mask
from .errors import PatternError

#: The default patterns, in the order they apply in (fixed values).
DEFAULTS = (
    (r"/\b\d{6}[-+A]?\d{3}[A-Z]\b/u", mask("HETU")),
    (r"/\b\d{2}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{1,4}\b/", mask("EHIC")),
    (r"/\b\d{6}[-\s]\d{8}\b/", mask("UKBANK")),
    (r"/\b\d{5}[-\s]\d{7,12}\b/", mask("CABANK")),
    (r"/\b\d{3}[-\s]\d{3}[-\s]\d{3}\b/", mask("CASIN")),
    (r"/\b\d{3}-\d{2}-\d{4}\b/", mask("USSSN")),
    (r"/\b\d{3}[-\s]\d{2}[-\s]\d{4}\b/", mask("MEDICARE")),
    (r"/\b[A-Z]{2}\d{6}[A-Z]\b/", mask("UKNI")),
    (r"/\bA\d{6}\b/", mask("PASSPORT")),
    (r"/\bFI\d{2}(?: ?\d{4}){3} ?\d{2}\b/u", mask("IBAN")),
    (r"/\bFI\d{16}\b/u", mask("IBAN")),
    (r"/\b(?:4111 1111 1111 1111|5500-0000-0000-0004|340000000000009|6011000000000004)\b/", mask("CC")),
    (r"/\b[0-9]{16}\b/u", mask("CC")),
    (r"/\b(?:19|20)\d{2}-[01]\d\-[0-3]\d\b/", mask("DOB")),
    (r"/\b[0-3]\d\/[01]\d\/(?:19|20)\d{2}\b/", mask("DOB")),
    (r"/(?<![\d+])\+\d{1,3}[\s-]?\d{1,4}[\s-]?\d{1,4}[\s-]?\d{1,9}\b/", mask("PHONE")),
    (r"/\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b/", mask("EMAIL")),
    (r"/\bBearer [A-Za-z0-9\-\._~\+\/]{10,}/", mask("TOKEN")),
    (r"/\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b/", mask("APIKEY")),
    (r"/\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b/", mask("MAC")),
    (r"/\b[0-9a-fA-F]{1,4}:[0-9a-fA-F:]{7,35}\b/", mask("IPv6")),
    (r"/\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b/", mask("IPv4")),
    (r"/\b[A-Z]{2,3}[-\s]?\d{3,4}\b/", mask("VEHICLE")),
    (r"/\b\d{3,4}[-\s]?[A-Z]{2,3}\b/", mask("VEHICLE")),
    (r"/^[A-Za-z0-9\-_]{20,}$/", mask("APIKEY")),
)

ASCII_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: A boundary beside a character that is known to be a word's.
NOT_AFTER, NOT_BEFORE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
ASCII_INSIDE = r"(?:(?<![A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_]))"
CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


@dataclass(frozen=True)
class Pattern:
    """One delimited pattern with its replacement."""

    source: str
    replacement: str = mask("MASKED")

    @cached_property
    def _parts(self) -> tuple[str, str]:
        s = self.source
        if len(s) < 3 or s[0].isalnum() or s[0] in "\\ ":
            raise PatternError("a pattern needs delimiters", pattern=s)
        end = s.rfind(CLOSING.get(s[0], s[0]))
        if end <= 0 or not set(s[end + 1 :]) <= set("imsxuUD"):
            raise PatternError("a pattern's delimiters or flags are wrong", pattern=s)
        return s[1:end], s[end + 1 :]

    @property
    def flags(self) -> str:
        return self._parts[1]

    @property
    def body(self) -> str:
        """The pattern without delimiters; escaped delimiters stand for themselves."""
        body = self._parts[0]
        return body.replace("\\/", "/") if self.source[0] == "/" else body

    @property
    def _tree(self):
        """The parsed body; None where Python's parser doesn't take it."""
        return _parsed(self.body, self.python.flags & (re.I | re.X | re.M | re.S))

    def _rewritten(self, at: dict[str, str], body: str | None = None) -> str:
        """The body with some escapes outside of classes, and ``$``, replaced."""
        out, k, inside, body = [], 0, False, self.body if body is None else body
        while k < len(body):
            two = body[k : k + 2]
            if two[0] == "\\":
                out.append(two if inside else at.get(two, two))
                k += 2
                continue
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(at.get(two[0], two[0]) if not inside and two[0] == "$" else two[0])
            k += 1
        return "".join(out)

    @cached_property
    def java(self) -> str:
        """For java.util.regex: only \\n ends a line, and classes and boundaries are ASCII unless ``u`` is set."""
        at = {} if "u" in self.flags else {"\\b": ASCII_BOUNDARY, "\\B": ASCII_INSIDE}
        if "D" in self.flags and "m" not in self.flags:
            at["$"] = "\\z"
        flags = f"(?d{''.join(f for f in 'imsx' if f in self.flags)}{'U' * ('u' in self.flags)})"
        body, lead, trail = self.body, "", ""
        if self._tree is not None and not ("x" in self.flags or {"i", "u"} <= set(self.flags) or _splits(body)):
            first, last = (_edge(self._tree, "u" in self.flags, "i" in self.flags, end) for end in (False, True))
            if first and not body.startswith("^"):
                lead = f"(?={first.java()})"  # rules out most places at once
            if at and first and first.word() and body.startswith("\\b") and self._tree[0][0] is K.AT:
                lead, body = lead + NOT_AFTER, body[2:]
            if at and last and last.word() and body.endswith("\\b") and self._tree[-1][0] is K.AT:
                trail, body = NOT_BEFORE, body[:-2]
        return flags + lead + self._rewritten(at, body) + trail

    @cached_property
    def python(self) -> re.Pattern:
        flags = 0 if "u" in self.flags else re.ASCII
        for name, flag in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)):
            flags |= flag if name in self.flags else 0
        return re.compile(self._rewritten({"$": "\\Z"} if "D" in self.flags and "m" not in self.flags else {}), flags)

    def _replacement(self, group, literal) -> str:
        out, last = [], 0
        for m in re.finditer(r"\\(\d{1,2})|\$(\d{1,2})|\$\{(\d{1,2})\}", self.replacement):
            out += [literal(self.replacement[last : m.start()]), group(int(m[1] or m[2] or m[3]))]
            last = m.end()
        return "".join([*out, literal(self.replacement[last:])])

    @cached_property
    def java_replacement(self) -> str:
        return self._replacement(lambda n: f"${n}", lambda s: s.replace("\\", "\\\\").replace("$", "\\$"))

    @cached_property
    def python_replacement(self) -> str:
        return self._replacement(lambda n: f"\\g<{n}>", lambda s: s.replace("\\", "\\\\"))

    def column(self, value: Column) -> Column:
        out = lambda v: F.regexp_replace(v, F.lit(self.java), F.lit(self.java_replacement))
        first = None if self._tree is None else _edge(self._tree, "u" in self.flags, "i" in self.flags, False)
        if self.literal and not (first and first.word()):  # tries most places: look for the literal before
            return F.transform(F.array(value), lambda v: F.when(v.contains(self.literal), out(v)).otherwise(v))[0]
        return out(value)

    def text(self, value: str) -> str:
        return self.python.sub(self.python_replacement, value)

    @property
    def literal(self) -> str:
        """A text of two characters or more, or an at sign, that every match holds; else nothing."""
        run = "" if self._tree is None else max(_literals(self._tree), key=len, default="")
        return run if (len(run) > 1 or run == "@") and "i" not in self.flags else ""

    @cached_property
    def necessary(self) -> str:
        """A Java regex that finds something wherever the pattern does: its literal in any case of letters, a run of three or more digits,
        or the pattern itself."""
        if self._tree is not None and not {"i", "u"} <= set(self.flags):
            run = max(_literals(self._tree), key=len, default="")
            if "i" in self.flags and len(run) > 1:
                return "(?i:" + re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", run) + ")"
            if (n := _digits(self._tree)) > 2:
                return ("(?U:\\d)" if "u" in self.flags else "[0-9]") + f"{{{n}}}"
        return f"(?:{self.java})"


@lru_cache(maxsize=1000)
def _parsed(body: str, flags: int):
    try:
        return _parser.parse(body, flags)
    except re.error:
        return None


WORD = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"))


@dataclass(frozen=True)
class Chars:
    """A set of characters; ``digits``: all Unicode digits are in it."""

    points: frozenset[int] = frozenset()
    digits: bool = False

    def __or__(self, other: Chars) -> Chars:
        return Chars(self.points | other.points, self.digits or other.digits)

    def word(self) -> bool:
        return not self.digits and self.points <= WORD

    def java(self) -> str:
        shown = (c if c.isalnum() and c.isascii() else f"\\{c}" if 33 <= ord(c) < 127 else f"\\u{ord(c):04x}" for c in map(chr, sorted(self.points)))
        return f"[{''.join(shown)}{'\\p{Nd}' * self.digits}]"


class _Unknown(Exception):
    """The characters can't be told."""


def _of(op, arg, unicode: bool, fold: bool) -> Chars:
    if op is K.LITERAL:
        if arg > 0xFFFF or fold and arg > 127:
            raise _Unknown
        return Chars(frozenset({arg, ord(chr(arg).lower()), ord(chr(arg).upper())} if fold else {arg}))
    if op is K.RANGE and arg[1] - arg[0] < 256:
        return reduce(or_, (_of(K.LITERAL, c, unicode, fold) for c in range(arg[0], arg[1] + 1)))
    if op is K.CATEGORY and arg is K.CATEGORY_DIGIT:
        return Chars(digits=True) if unicode else Chars(frozenset(range(48, 58)))
    if op is K.CATEGORY and arg is K.CATEGORY_WORD and not unicode:
        return Chars(WORD)
    if op is K.CATEGORY and arg is K.CATEGORY_SPACE and not unicode:
        return Chars(frozenset(map(ord, " \t\n\r\f\v")))
    raise _Unknown


def _ends(tree, unicode: bool, fold: bool, last: bool) -> tuple[Chars, bool]:
    """(characters that a match may begin with, or end with; whether it may be empty)."""
    out = Chars()
    for op, arg in reversed(list(tree)) if last else tree:
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        if op is K.IN:
            own, empty = reduce(or_, (_of(o, a, unicode, fold) for o, a in arg)), False
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            own, empty = _ends(arg[2], unicode, fold, last)
            empty = empty or not arg[0]
        elif op is K.SUBPATTERN and not arg[1] and not arg[2]:
            own, empty = _ends(arg[3], unicode, fold, last)
        elif op is K.BRANCH:
            each = [_ends(x, unicode, fold, last) for x in arg[1]]
            own, empty = reduce(or_, (e[0] for e in each)), any(e[1] for e in each)
        else:
            own, empty = _of(op, arg, unicode, fold), False
        out |= own
        if not empty:
            return out, False
    return out, True


def _edge(tree, unicode: bool, fold: bool, last: bool) -> Chars | None:
    """The characters that a match begins (or ends) with; None where they can't be told."""
    try:
        out, empty = _ends(tree, unicode, fold, last)
    except _Unknown:
        return None
    return None if empty else out


def _splits(body: str) -> bool:
    """Whether the body has alternatives outside of groups."""
    depth, inside, k = 0, False, 0
    while k < len(body):
        ch = body[k]
        if ch == "\\":
            k += 1
        elif inside:
            inside = ch != "]"
        elif ch == "[":
            inside = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and not depth:
            return True
        k += 1
    return False


def _literals(tree) -> list[str]:
    """Runs of characters that every match holds."""
    out, run = [], ""
    for op, arg in tree:
        if op is K.LITERAL:
            run += chr(arg)
        elif op is not K.AT:
            out.append(run)
            run = ""
    return [*out, run]


def _digit(op, arg) -> bool:
    """Whether the item is always a digit."""
    if op is K.LITERAL:
        return 48 <= arg <= 57
    return op is K.IN and all(o is K.CATEGORY and a is K.CATEGORY_DIGIT or o is K.RANGE and 48 <= a[0] <= a[1] <= 57 or o is K.LITERAL and 48 <= a <= 57 for o, a in arg)


def _digits(tree) -> int:
    """The length of a run of digits that every match holds."""
    best = run = 0
    for op, arg in tree:
        if op is K.AT:
            continue
        if _digit(op, arg):
            run += 1
        elif op is K.MAX_REPEAT and len(arg[2]) == 1 and _digit(*arg[2][0]):
            best, run = max(best, run + arg[0]), 0 if arg[0] != arg[1] else run + arg[0]
        else:
            inner = _digits(arg[3]) if op is K.SUBPATTERN else min(map(_digits, arg[1])) if op is K.BRANCH else _digits(arg[2]) if op is K.MAX_REPEAT and arg[0] else 0
            best, run = max(best, inner), 0
        best = max(best, run)
    return best


def compiled(patterns: Mapping[str, str] | None = None) -> list[Pattern]:
    """Patterns in order; the defaults where none are given."""
    return [Pattern(p, r) for p, r in (dict(DEFAULTS) if patterns is None else patterns).items()]


def guards(patterns: list[Pattern]) -> tuple[list[str], list[str]]:
    """(literals, Java regexes): some of them is in every text that any of the patterns would change."""
    literals = list(dict.fromkeys(p.literal for p in patterns if p.literal))
    found = list(dict.fromkeys(p.necessary for p in patterns if not p.literal))
    runs = {n: [int(m[1]) for x in found if (m := re.fullmatch(re.escape(n) + r"\{(\d+)\}", x))] for n in ("[0-9]", "(?U:\\d)")}
    least = [f"{n}{{{min(k)}}}" for n, k in runs.items() if k]  # a shorter run is in every longer one
    every = {f"{n}{{{k}}}" for n, ks in runs.items() for k in ks}
    return literals, [*least, *(x for x in found if x not in every)]


def may_change(value: Column, patterns: list[Pattern]) -> Column:
    """Whether any of the patterns may find something; cheap tests come first, and the first that holds is enough."""
    literals, regexes = guards(patterns)
    return reduce(or_, [*(value.contains(x) for x in literals), *(value.rlike(x) for x in regexes)])


def apply_patterns(value: Column, patterns: list[Pattern], guarded: bool = True) -> Column:
    """The value after all patterns in turn. Guarded: texts that no pattern can change skip the chain."""
    if not patterns:
        return value
    out = value
    for p in patterns:
        out = p.column(out)
    return F.when(may_change(value, patterns), out).otherwise(value) if guarded else out


def apply_text(value: str, patterns: list[Pattern]) -> str:
    for p in patterns:
        value = p.text(value)
    return value


def matched_labels(value: Column, patterns: list[Pattern]) -> Column:
    """The distinct replacements whose pattern finds something in the value, in order (array<string>)."""
    hits = F.array(*(F.when(value.rlike(p.java), F.lit(p.replacement)) for p in patterns))
    found = F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))
    return F.when(may_change(value, patterns), found).otherwise(F.array().cast("array<string>"))


def matches(value: Column, pattern: Pattern) -> Column:
    """All that a pattern finds in the value (array<string>)."""
    return F.regexp_extract_all(value, F.lit(f"({pattern.java})"), F.lit(0))


def scrubbed_utf8(value: Column) -> Column:
    """A binary value as text, with U+FFFD for malformed bytes."""
    return F.make_valid_utf8(value.cast("string"))
