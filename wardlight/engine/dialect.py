"""Rewrites of other dialects' SQL text outside string literals."""

from __future__ import annotations

import re

_table = re.compile(r'(?i)(\b(?:from|join)\s+)"?(\w+)"?\s*\.\s*"?(\w+)"?\s*\.\s*"?(\w+)"?')
_to_char = re.compile(r"(?i)(\bto_char\s*\([^()']*(?:\([^()']*\)[^()']*)*,\s*)('(?:[^']|'')*')")
# Date patterns of TO_CHAR and Spark's.
PATTERNS = (("YYYY", "yyyy"), ("HH24", "HH"), ("MI", "mm"), ("DD", "dd"), ("SS", "ss"))


def to_char_patterns(sql: str) -> str:
    def change(m: re.Match) -> str:
        pattern = m[2]
        for a, b in PATTERNS:
            pattern = pattern.replace(a, b)
        return m[1] + pattern

    return _to_char.sub(change, sql)


_quoted = re.compile(r"('(?:[^']|'')*'|--[^\n]*|/\*.*?\*/)", re.S)


def flat_names(sql: str) -> str:
    """catalog.schema.table after FROM or JOIN becomes the view catalog_schema_table of the session catalog; literals and comments stay."""
    change = lambda part: _table.sub(lambda m: m[1] + "_".join(m.group(2, 3, 4)).lower(), part)
    return "".join(part if i % 2 else change(part) for i, part in enumerate(_quoted.split(sql)))


def translate(sql: str) -> str:
    return flat_names(to_char_patterns(sql))
