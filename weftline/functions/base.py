"""Small building blocks for Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_match(col: Column, patterns: Sequence[str]) -> Column:
    """True if one of the Java patterns is found; null counts as empty."""
    return F.coalesce(col, F.lit("")).rlike("|".join(f"(?:{p})" for p in patterns))


def led_match(col: Column, patterns: Sequence[str]) -> Column:
    """``any_match`` for patterns that begin with a plain word (or a dot and a word): a pattern is tried only on texts that contain its word,
    which costs a fraction of the search."""
    text, led = F.coalesce(col, F.lit("")), {}
    for p in patterns:
        led.setdefault(re.match(r"(?:\\\.)?([a-z]++)(?![?*+{|])", p)[1], []).append(p)
    out = F.lit(False)
    for word, ps in led.items():
        found = F.contains(text, F.lit(word))
        out = out | (found if ps == [word] else found & any_match(col, ps))
    return out


def holds(col: Column, parts: Sequence[str]) -> Column:
    """True if the text contains one of the parts (case as given)."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.coalesce(col, F.lit("")), F.lit(p))
    return out


def first_of(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """Ordered CASE: the first condition that holds decides."""
    out = None
    for when, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, value) if out is None else out.when(when, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def lookup(col: Column, values: Mapping[str, object], default: object) -> Column:
    """Literal map lookup with a default; a CASE is not needed for equality on one column."""
    flat = [F.lit(x) for kv in values.items() for x in kv]
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*flat), F.coalesce(col, F.lit(""))), default)


def labels(rules: Sequence[tuple[Column, str]]) -> Column:
    """Labels of all rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in rules]))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def js_or(col: Column, default: object) -> Column:
    """``col || default`` for text: null and the empty string take the default."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(col.isNull() | (col == ""), default).otherwise(col)


def nonempty_match(col: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match or null."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` as one variable, however often it is used: the expression neither grows nor is worked out again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
