"""Answers of language models checked against the schema of what they were asked.

An answer is one VARIANT value whatever it was asked; the schema that its row names decides which fields it needs and of
what kind. What is wrong comes out as rows of path and reason; a clear refusal is taken without
a full check, part of an answer may do, and where nothing usable is left a fixed answer stands in."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import first_of, js_or, let
from .jsonx import extract_json, has_keys

# ---- fixed values: fields and kinds by prompt type ("?": may be absent, "~": may be null, "a|b": one of these) ----
SCHEMAS = {
    "code_analysis": {
        "functionsChanged": ["string"], "classesChanged": ["string"], "importsChanged": ["string"], "fileType": "string", "isTestFile": "boolean", "isConfigFile": "boolean",
        "architecturalPatterns": ["string"], "businessDomain": "string", "codeComplexity": "low|medium|high", "semanticDescription": "string",
    },
    "theme_extraction": {
        "themeName": "string", "description": "string", "businessImpact": "string", "confidence": "number", "codePattern": "string", "detailedDescription?~": "string", "technicalSummary?": "string",
        "keyChanges?": ["string"], "userScenario?~": "string", "suggestedParent?~": "string",
    },
    "similarity_check": {
        "shouldMerge": "boolean", "confidence": "number", "reasoning": "string", "nameScore": "number", "descriptionScore": "number", "patternScore": "number", "businessScore": "number", "semanticScore": "number",
    },
    "theme_expansion": {
        "shouldExpand": "boolean", "confidence": "number",
        "subThemes": [{"name": "string", "description": "string", "businessValue": "string", "affectedComponents": ["string"], "relatedFiles": ["string"]}], "reasoning": "string",
    },
    "domain_extraction": {"domains": [{"domain": "string", "themes": ["string"], "confidence": "number", "userValue": "string"}]},
    "theme_naming": {"themeName": "string", "alternativeNames?": ["string"], "reasoning": "string"},
    "batch_similarity": {
        "results": [{"pairId": "string", "shouldMerge": "boolean", "confidence": "number", "scores": {"name": "number", "description": "number", "pattern": "number", "business": "number", "semantic": "number"}}],
    },
    "cross_level_similarity": {
        "relationship": "parent_child|duplicate|none", "confidence": "number", "action": "keep_both|merge_into_parent|merge_into_child|make_sibling", "reasoning": "string",
    },
}
FALLBACKS = {
    "code_analysis": {
        "functionsChanged": [], "classesChanged": [], "importsChanged": [], "fileType": "unknown", "isTestFile": False, "isConfigFile": False, "architecturalPatterns": [], "businessDomain": "unknown",
        "codeComplexity": "medium", "semanticDescription": "Analysis failed",
    },
    "theme_extraction": {
        "themeName": "Unknown Theme", "description": "Analysis unavailable", "businessImpact": "Unknown impact", "confidence": 0.3, "codePattern": "Unknown", "detailedDescription": None, "suggestedParent": None,
    },
    "similarity_check": {
        "shouldMerge": False, "confidence": 0.5, "reasoning": "Analysis failed - defaulting to no merge", "nameScore": 0, "descriptionScore": 0, "patternScore": 0, "businessScore": 0, "semanticScore": 0,
    },
    "theme_expansion": {"shouldExpand": False, "confidence": 0.5, "subThemes": [], "reasoning": "Analysis failed - no expansion"},
    "domain_extraction": {"domains": []},
    "theme_naming": {"themeName": "Unnamed Theme", "alternativeNames": [], "reasoning": "Naming analysis failed"},
    "batch_similarity": {"results": []},
    "cross_level_similarity": {"relationship": "none", "confidence": 0.5, "action": "keep_both", "reasoning": "Analysis failed - keeping both themes"},
}
#: Which kinds a clear refusal settles, and the answer it stands for beside its confidence.
REFUSALS = {
    "similarity_check": {"shouldMerge": False, "reasoning": "Quick analysis - clear non-match", "nameScore": 0, "descriptionScore": 0, "patternScore": 0, "businessScore": 0, "semanticScore": 0},
    "cross_level_similarity": {"relationship": "none", "action": "keep_both", "reasoning": "Quick analysis - no relationship"},
}

#: What ``schema_of_variant`` says of each kind.
_KINDS = {"string": "^STRING$", "boolean": "^BOOLEAN$", "number": "^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "array": "^ARRAY", "object": "^OBJECT"}
_ISSUE = "array<struct<path:string,reason:string>>"


def _none() -> Column:
    return F.array().cast(_ISSUE)


def _issue(path: Column, reason: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason"))).cast(_ISSUE)


def _value_issues(x: Column, rule, path: Column) -> Column:
    """Issues of one value that is there."""
    kind = F.schema_of_variant(x)
    if isinstance(rule, dict):
        return F.when(kind.rlike(_KINDS["object"]), _field_issues(x, rule, path)).otherwise(_issue(path, "expected object"))
    if isinstance(rule, list):
        items = F.try_variant_get(x, F.lit("$"), "array<variant>")
        each = F.flatten(F.transform(items, lambda e, i: _value_issues(e, rule[0], F.concat(path, F.lit("."), i.cast("string")))))
        return F.when(kind.rlike(_KINDS["array"]), F.coalesce(each, _none())).otherwise(_issue(path, "expected array"))
    if "|" in rule:
        text = F.try_variant_get(x, F.lit("$"), "string")
        return F.when(kind.rlike(_KINDS["string"]) & text.isin(*rule.split("|")), _none()).otherwise(_issue(path, f"expected one of {rule}"))
    return F.when(kind.rlike(_KINDS[rule]), _none()).otherwise(_issue(path, f"expected {rule}"))


def _field_issues(value: Column, fields: dict, path: Column | None, partial: bool = False) -> Column:
    def field(name: str, rule) -> Column:
        bare = name.rstrip("?~")
        own = F.lit(bare) if path is None else F.concat(path, F.lit(f".{bare}"))
        absent = _none() if partial or "?" in name else _issue(own, "missing")

        def judged(x: Column) -> Column:
            found = _value_issues(x, rule, own)
            if "~" in name:
                found = F.when(F.schema_of_variant(x) == "VOID", _none()).otherwise(found)
            return F.when(x.isNull(), absent).otherwise(found)

        return let(F.try_variant_get(value, F.lit(f"$.{bare}"), "variant"), judged)

    return F.concat(*[field(name, rule) for name, rule in fields.items()])


def issues(value: Column, kind: Column, partial: bool = False) -> Column:
    """Array of (path, reason) of a VARIANT against the schema that ``kind`` names; null for an unknown kind.

    With ``partial`` no field has to be there; those that are must fit."""
    cases = [(kind == name, _field_issues(value, fields, None, partial)) for name, fields in SCHEMAS.items()]
    return first_of(cases, F.lit(None).cast(_ISSUE))


def refusal(text: Column, kind: Column) -> Column:
    """Confidence (below 0.3) of an answer that clearly says no, else null: no merge at low confidence, or no
    relationship. Only where ``REFUSALS`` has the kind."""
    no_merge = text.rlike(r'(?i)"shouldMerge":\s*false') & text.rlike(r'(?i)"confidence":\s*0\.([0-2])\d*')
    number = F.regexp_extract(text, r'"confidence":\s*(0\.\d+)', 1)
    sure = F.when(number == "", F.lit(0.1)).otherwise(number.cast("double"))
    return F.when(kind.isin(*REFUSALS) & (no_merge | text.rlike(r'(?i)"relationship":\s*"none"')) & (sure < 0.3), sure)


def _json(values: dict[str, dict], kind: Column) -> Column:
    return first_of([(kind == name, json.dumps(value)) for name, value in values.items()], F.lit(None).cast("string"))


def fallback(kind: Column, file_type: Column | None = None, file_name: Column | None = None, default_name: Column | None = None) -> Column:
    """The JSON that stands in for an answer of ``kind``, with what is known of its file; null for an unknown kind."""
    fixed = F.try_parse_json(_json(FALLBACKS, kind))
    put = []
    if file_type is not None:
        put.append(("code_analysis", "fileType", js_or(file_type, FALLBACKS["code_analysis"]["fileType"])))
    if file_name is not None:
        put.append(("theme_extraction", "themeName", F.when(file_name != "", F.concat(F.lit("Changes in "), file_name)).otherwise(FALLBACKS["theme_extraction"]["themeName"])))
    if default_name is not None:
        put.append(("theme_naming", "themeName", js_or(default_name, FALLBACKS["theme_naming"]["themeName"])))
    out = F.to_json(fixed)
    for name, field, value in put:
        rest = {k: v for k, v in FALLBACKS[name].items() if k != field}
        out = F.when(kind == name, F.to_json(F.try_parse_json(F.concat(F.lit(json.dumps(rest)[:-1] + f', "{field}": '), F.to_json(F.try_parse_json(F.concat(F.lit('"'), _escaped(value), F.lit('"')))), F.lit("}"))))).otherwise(out)
    return out


def _escaped(text: Column) -> Column:
    """A text's inside as in JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)


def checked(text: Column, kind: Column) -> Column:
    """Struct (status, issues, confidence) of a raw answer: refused (with its confidence), valid, rejected, no-schema or no-json."""
    row = lambda status, what, sure: F.struct(F.lit(status).alias("status"), what.alias("issues"), sure.cast("double").alias("confidence"))
    nothing = F.lit(None)

    def judged(value: Column, no: Column, own: Column) -> Column:
        no_object = value.isNull() | ~F.coalesce(F.schema_of_variant(value).rlike(_KINDS["object"]), F.lit(False))
        sound = row("valid", _none(), F.try_variant_get(value, F.lit("$.confidence"), "double"))
        return first_of([(no.isNotNull(), row("refused", _none(), no)), (no_object, row("no-json", _issue(F.lit(""), "no object"), nothing)), (own.isNull(), row("no-schema", _none(), nothing)), (F.size(own) == 0, sound)], row("rejected", own, nothing))

    return let(F.try_parse_json(extract_json(text)), lambda value: let(refusal(text, kind), lambda no: let(issues(value, kind), lambda own: judged(value, no, own))))


def partly(text: Column, kind: Column, required: list[str]) -> Column:
    """Struct (ok, json, clean) of an answer that needs only ``required``: their JSON if all are there; ``clean`` says whether what is there fits the schema."""

    def judged(found: Column) -> Column:
        ok = F.coalesce(has_keys(found, required), F.lit(False))
        fits = let(F.try_parse_json(found), lambda value: F.coalesce(F.size(issues(value, kind, partial=True)) == 0, F.lit(False)))
        return F.struct(ok.alias("ok"), F.when(ok, found).alias("json"), (ok & fits).alias("clean"))

    return let(extract_json(text), judged)
