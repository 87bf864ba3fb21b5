"""All queries by name, with their SQL twins."""

from __future__ import annotations

from formulaspark.plans import queries_formulas, queries_pixels, queries_symbols

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (queries_symbols, queries_formulas, queries_pixels):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
FLAGSHIP = "symbols_to_latex"
