"""Registry of the engine's table queries and the DuckDB SQL that states the same result."""

from __future__ import annotations

from . import answers, diffs, expansions, linking, measures, projections, relations, reviews, rules, semantic, spans, texts, themes, trees

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (reviews, measures, linking, texts, trees, themes, semantic, expansions, spans, rules, answers, diffs, relations, projections):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
