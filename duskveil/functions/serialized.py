"""Texts that hold dumps of values: JSON, print_r, var_export and serialize formats."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonmask import PAIRS, dumps, loads
from .patterns import Pattern, apply_text

#: Where a text looks like a dump, and the pairs in it (fixed values).
PRINT_R = (re.compile(r"Array\s*\(\s*\["), re.compile(r"(\[\S+\])\s*=>\s*([^\n\[]+)"))
VAR_EXPORT = (re.compile(r"array\s*\(\s*['\"]?\w+['\"]?\s*=>"), re.compile(r"(['\"])(\w+)\1\s*=>\s*(['\"])([^'\"]+)\3"))
SERIALIZE = (re.compile(r"[aOCs]:\d+:"), re.compile(r's:(\d+):"([^"]*)";'))


class DumpMasker:
    """Masks strings inside dumps; ``audit`` is told (path, original, masked) of each change."""

    def __init__(self, mask: Callable[[str], str], audit: Callable[[str, str, str], None] | None = None):
        self.mask, self.audit = mask, audit or (lambda path, original, masked: None)

    def process(self, text: str) -> str:
        for step in (self._json, self._print_r, self._var_export, self._serialize) if text else ():
            text = step(text)
        return text

    def _masked(self, path: str, value: str) -> str:
        out = self.mask(value)
        if out != value:
            self.audit(path, value, out)
        return out

    def _json(self, text: str) -> str:
        out, last = [], 0
        for start, end in sorted(_structures(text).items()):
            if start < last:
                continue
            found = text[start:end]
            try:
                found = dumps(_emptied(self._nested(loads(found), "json")))
            except (ValueError, RecursionError):
                pass
            out += [text[last:start], found]
            last = end
        return "".join([*out, text[last:]])

    def _nested(self, value, path: str):
        if isinstance(value, str):
            return self._masked(path, value)
        if isinstance(value, dict):
            return {k: self._nested(v, f"{path}.{k}") for k, v in value.items()}
        if isinstance(value, list):
            return [self._nested(v, f"{path}.{k}") for k, v in enumerate(value)]
        return value

    def _print_r(self, text: str) -> str:
        gate, pair = PRINT_R

        def put(m: re.Match) -> str:
            key, value = m[1].strip("[]"), m[2].strip(" \t\n\r\0\x0b")
            if value == "Array" or (out := self._masked(f"print_r.{key}", value)) == value:
                return m[0]
            return f"[{key}] => {out}"

        return pair.sub(put, text) if gate.search(text) else text

    def _var_export(self, text: str) -> str:
        gate, pair = VAR_EXPORT

        def put(m: re.Match) -> str:
            out = self._masked(f"var_export.{m[2]}", m[4])
            return m[0] if out == m[4] else f"{m[1]}{m[2]}{m[1]} => {m[3]}{out}{m[3]}"

        return pair.sub(put, text) if gate.search(text) else text

    def _serialize(self, text: str) -> str:
        gate, pair = SERIALIZE

        def put(m: re.Match) -> str:
            if len(m[2].encode()) != int(m[1]) or (out := self._masked("serialize.string", m[2])) == m[2]:
                return m[0]
            return f's:{len(out.encode())}:"{out}";'

        return pair.sub(put, text) if gate.search(text) else text


def _structures(text: str) -> dict[int, int]:
    """The end of each bracket's structure: brackets of its own kind are counted, strings are not looked at."""
    open_at: dict[str, list[int]] = {c: [] for c in PAIRS.values()}
    out = {}
    for m in re.finditer(r"[{}\[\]]", text):
        if m[0] in PAIRS:
            open_at[PAIRS[m[0]]].append(m.start())
        elif open_at[m[0]]:
            out[open_at[m[0]].pop()] = m.end()
    return out


def _emptied(value):
    """Empty objects become empty lists, as this format does not tell them apart."""
    if isinstance(value, dict):
        return {k: _emptied(v) for k, v in value.items()} if value else []
    return [_emptied(v) for v in value] if isinstance(value, list) else value


def mask_dumps(text: Column, patterns: list[Pattern]) -> Column:
    """The column with strings inside dumps masked; texts without any sign of a dump stay native."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        masker = DumpMasker(lambda x: apply_text(x, patterns))
        return s.map(lambda x: x if x is None else masker.process(x))

    return F.when(text.rlike(r"[{\[]|[aA]rray\s*\(|[aOCs]:\d+:"), run(text)).otherwise(text)
