"""Validation of nested code assignments: what is kept, with defaults, and what is wrong, with its path.

An assignment is a struct (name, description, business_value, technical_purpose, assigned_code, rationale,
contextual_meaning); assigned_code is an array of (file, hunks, ownership), hunks of (old_start, old_lines,
new_start, new_lines, changes), changes of (type, content). All three levels are walked by
array functions inside the row; nothing is exploded, and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import first_of, js_or
from .text import word_limit

CHANGE = "struct<type:string,content:string>"
HUNK = f"struct<old_start:int,old_lines:int,new_start:int,new_lines:int,changes:array<{CHANGE}>>"
CODE = f"struct<file:string,hunks:array<{HUNK}>,ownership:string>"
ASSIGNMENT = f"struct<name:string,description:string,business_value:string,technical_purpose:string,assigned_code:array<{CODE}>,rationale:string,contextual_meaning:string>"
#: Words kept of name, business value, technical purpose, contextual meaning and rationale.
LIMITS = {"name": 8, "business_value": 12, "technical_purpose": 10, "contextual_meaning": 20, "rationale": 15}


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def _whole(change: Column) -> Column:
    return ~_blank(change["type"]) & change["content"].isNotNull()


def _hunks(code: Column) -> Column:
    """Hunks with their whole changes and 0 for missing numbers; those without one are left out."""
    number = lambda h, c: F.coalesce(h[c], F.lit(0)).alias(c)
    clean = F.transform(code["hunks"], lambda h: F.struct(*[number(h, c) for c in ("old_start", "old_lines", "new_start", "new_lines")], F.filter(h["changes"], _whole).alias("changes")))
    return F.filter(clean, lambda h: F.size(h["changes"]) > 0)


def _code(assignment: Column) -> Column:
    """Code with a file and hunks, its context lines and who owns it; that without valid hunks is left out."""

    def clean(code: Column) -> Column:
        hunks = _hunks(code)
        return F.struct(
            code["file"].alias("file"), hunks.alias("hunks"), F.get(hunks, F.lit(0))["new_start"].alias("start_line"), F.element_at(hunks, -1)["new_start"].alias("end_line"),
            F.lit("function").alias("context_type"), js_or(code["ownership"], "primary").alias("ownership"),
        )

    sound = F.filter(assignment["assigned_code"], lambda c: ~_blank(c["file"]) & F.exists(c["hunks"], lambda h: F.exists(h["changes"], _whole)))
    return F.transform(sound, clean)


def kept(assignments: Column) -> Column:
    """The valid assignments with defaults for what they lack and their texts cut to ``LIMITS`` words."""

    def clean(a: Column) -> Column:
        text = {
            "name": a["name"], "business_value": js_or(a["business_value"], a["name"]), "technical_purpose": a["technical_purpose"],
            "contextual_meaning": js_or(a["contextual_meaning"], a["technical_purpose"]), "rationale": js_or(a["rationale"], "Distinct concern"),
        }
        limited = [word_limit(v, LIMITS[k]).alias(k) for k, v in text.items()]
        return F.struct(*limited, js_or(a["description"], a["technical_purpose"]).alias("description"), _code(a).alias("assigned_code"), F.lit("primary").alias("ownership"))

    named = F.filter(assignments, lambda a: ~_blank(a["name"]) & ~_blank(a["technical_purpose"]) & a["assigned_code"].isNotNull())
    return F.filter(F.transform(named, clean), lambda a: F.size(a["assigned_code"]) > 0)


def _at(path: Column, field: str, index: Column) -> Column:
    return F.concat(path, F.lit(f"{field}["), index.cast("string"), F.lit("]"))


def _said(path: Column, reason: Column) -> Column:
    return F.filter(F.array(F.struct(path.alias("path"), reason.alias("reason"))), lambda v: v["reason"].isNotNull())


def _below(items: Column, path: Column, field: str, rule: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(items, lambda x, i: rule(x, _at(path, field, i))))


def violations(assignments: Column) -> Column:
    """Array of (path, reason), in order of the paths; an element that is left out as a whole is not searched further.

    Reasons: missing name, technical_purpose, assigned_code, file, hunks, changes, type or content; and, for
    elements of which nothing is left, no valid changes, hunks or code."""
    nothing = F.lit(None).cast("string")

    def change(c: Column, path: Column) -> Column:
        return _said(path, first_of([(_blank(c["type"]), "missing type"), (c["content"].isNull(), "missing content")], nothing))

    def hunk(h: Column, path: Column) -> Column:
        own = first_of([(h["changes"].isNull(), "missing changes"), (~F.exists(h["changes"], _whole), "no valid changes")], nothing)
        return F.concat(_said(path, own), F.when(h["changes"].isNotNull(), _below(h["changes"], path, ".changes", change)).otherwise(_said(path, nothing)))

    def code(c: Column, path: Column) -> Column:
        lacking = first_of([(_blank(c["file"]), "missing file"), (c["hunks"].isNull(), "missing hunks")], nothing)
        own = F.coalesce(lacking, F.when(~F.exists(c["hunks"], lambda h: F.coalesce(F.exists(h["changes"], _whole), F.lit(False))), "no valid hunks"))
        return F.concat(_said(path, own), F.when(lacking.isNull(), _below(c["hunks"], path, ".hunks", hunk)).otherwise(_said(path, nothing)))

    def assignment(a: Column, path: Column) -> Column:
        lacking = first_of([(_blank(a["name"]), "missing name"), (_blank(a["technical_purpose"]), "missing technical_purpose"), (a["assigned_code"].isNull(), "missing assigned_code")], nothing)
        own = F.coalesce(lacking, F.when(F.size(_code(a)) == 0, "no valid code"))
        return F.concat(_said(path, own), F.when(lacking.isNull(), _below(a["assigned_code"], path, ".assigned_code", code)).otherwise(_said(path, nothing)))

    return _below(assignments, F.lit(""), "", assignment)


def problem(assignment: Column) -> Column:
    """Why one assignment cannot be taken over, or null: no assigned code, invalid code, empty hunk; the first in order."""
    code, nothing = assignment["assigned_code"], F.lit(None).cast("string")

    def of(c: Column) -> Column:
        bad = _blank(c["file"]) | c["hunks"].isNull() | (F.size(c["hunks"]) == 0)
        empty = F.exists(c["hunks"], lambda h: h["changes"].isNull() | (F.size(h["changes"]) == 0))
        return first_of([(bad, "invalid code"), (empty, "empty hunk")], nothing)

    first = F.get(F.filter(F.transform(code, of), lambda r: r.isNotNull()), F.lit(0))
    return F.when(code.isNull() | (F.size(code) == 0), "no assigned code").otherwise(first)
