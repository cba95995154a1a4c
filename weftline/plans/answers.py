"""Answer queries: raw answers of eight kinds and their validation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.base import let
from ..operators import relational
from ..operators.cluster import stored
from .rules import _list, _pick, _quoted
from .tables import read

KINDS = (*answers.SCHEMAS, "other")


def _sample(rule, broken: int = 0):
    """A value that fits ``rule``; ``broken`` 1 has wrong scalars inside arrays, 2 nulls, 3 no arrays."""
    if isinstance(rule, dict):
        return {name.rstrip("?~"): _sample(r, broken) for name, r in rule.items()}
    if isinstance(rule, list):
        inner = _sample(rule[0], 0)
        return {0: [inner, inner], 1: [inner, 7, None], 2: [], 3: "none"}[broken]
    return {"boolean": True, "number": 0.75, "string": 'some "text"'}.get(rule, rule.split("|")[0])


def _texts(kind: str) -> list[str]:
    schema = answers.SCHEMAS.get(kind, {"a": "string"})
    whole = _sample(schema)
    names = list(whole)
    lacking = {k: v for k, v in whole.items() if k != names[0]} | {"confidence": "high", "extra": 1}
    nulls = dict.fromkeys(names)
    show = json.dumps
    return [
        show(whole), f"Here it is:\n```json\n{show(whole, indent=1)}\n```\nDone.", show(lacking), f"The answer {show(_sample(schema, 1))} follows.", "no object at all", "[1, 2]",
        '{"shouldMerge": false, "confidence": 0.15, "relationship": "none"}', '{"shouldMerge": FALSE, "confidence": 0.9}', show(nulls), show(_sample(schema, 2) | {names[-1]: 3}), show(_sample(schema, 3)), "{}",
    ]


TEXTS = [_texts(kind) for kind in KINDS]
_N = len(TEXTS[0])


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind, which = F.col("p_partkey") % len(KINDS), F.col("p_size") % _N
    text = _pick([t for row in TEXTS for t in row], kind * _N + which)
    return p.select(F.col("p_partkey").alias("key"), _pick(KINDS, kind).alias("kind"), text.alias("text"), F.col("p_name"), F.col("p_brand"), F.col("p_size"))


def _judged(answers_: DataFrame) -> DataFrame:
    """kind, text, status, issues, confidence, partial_ok and partial_clean, once for each distinct answer of a kind: an answer given
    again is not checked again."""
    kind = F.col("kind")
    found, part = answers.checked(F.col("text"), kind), answers.partly(F.col("text"), kind, ["confidence"])
    said = F.array_join(F.transform(F.col("c.issues"), lambda i: F.concat_ws("=", i["path"], i["reason"])), ";")
    rows = answers_.select("kind", "text").distinct().repartition(48, "kind", "text").withColumn("c", found).withColumn("p", part)
    return stored(rows.select("kind", "text", F.col("c.status").alias("status"), said.alias("issues"), F.col("c.confidence").alias("confidence"), F.col("p.ok").alias("partial_ok"), F.col("p.clean").alias("partial_clean")))


def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and issues of every answer by the schema of its kind; of those that are no use, what stands in for them."""
    a, kind = _answers(spark, sf_dir), F.col("kind")
    name = F.when(F.col("p_size") % 3 > 0, F.col("p_name"))
    stand_in = answers.fallback(kind, F.col("p_brand"), name, name)
    title = let(stand_in, lambda s: F.coalesce(F.get_json_object(s, "$.themeName"), F.get_json_object(s, "$.fileType"), F.get_json_object(s, "$.reasoning")))
    judged = relational.small(_judged(a).withColumnsRenamed({"kind": "kind_j", "text": "text_j"}), 10_000)
    rows = a.join(judged, kind.eqNullSafe(F.col("kind_j")) & F.col("text").eqNullSafe(F.col("text_j")))
    return rows.select("key", "kind", "status", "issues", "confidence", "partial_ok", "partial_clean", F.when(~F.col("status").isin("valid", "refused"), title).alias("stand_in"))


_EMPTY = "[]::STRUCT(path VARCHAR, reason VARCHAR)[]"
_TYPES = {"string": "('VARCHAR')", "boolean": "('BOOLEAN')", "number": "('BIGINT', 'UBIGINT', 'DOUBLE')"}


def _say(path: str, reason: str) -> str:
    return f"[{{'path': {path}, 'reason': {_quoted(reason)}}}]"


def _value_sql(j: str, rule, path: str, depth: int = 0) -> str:
    if isinstance(rule, dict):
        return f"CASE WHEN json_type({j}) = 'OBJECT' THEN {_fields_sql(j, rule, path + " || '.' || ", False, depth)} ELSE {_say(path, 'expected object')} END"
    if isinstance(rule, list):
        inner = _value_sql(f"e{depth}", rule[0], f"{path} || '.' || (i{depth} - 1)", depth + 1)
        return f"CASE WHEN json_type({j}) = 'ARRAY' THEN list_concat({_EMPTY}, flatten(list_transform(json_extract({j}, '$[*]'), lambda e{depth}, i{depth}: {inner}))) ELSE {_say(path, 'expected array')} END"
    if "|" in rule:
        values = ", ".join(_quoted(v) for v in rule.split("|"))
        return f"CASE WHEN json_type({j}) = 'VARCHAR' AND {j}->>'$' IN ({values}) THEN {_EMPTY} ELSE {_say(path, f'expected one of {rule}')} END"
    return f"CASE WHEN json_type({j}) IN {_TYPES[rule]} THEN {_EMPTY} ELSE {_say(path, f'expected {rule}')} END"


def _fields_sql(j: str, fields: dict, prefix: str, partial: bool, depth: int = 0) -> str:
    out = _EMPTY
    for name, rule in fields.items():
        bare = name.rstrip("?~")
        path, x = f"{prefix}{_quoted(bare)}", f"json_extract({j}, '$.{bare}')"
        absent = _EMPTY if partial or "?" in name else _say(path, "missing")
        null = f" WHEN json_type({x}) = 'NULL' THEN {_EMPTY}" if "~" in name else ""
        out = f"list_concat({out}, CASE WHEN {x} IS NULL THEN {absent}{null} ELSE {_value_sql(x, rule, path, depth)} END)"
    return out


def _issues_sql(partial: bool) -> str:
    return "CASE kind " + " ".join(f"WHEN '{name}' THEN {_fields_sql('j', fields, '', partial)}" for name, fields in answers.SCHEMAS.items()) + " END"


def _stand_in_sql() -> str:
    fixed = {k: next((v[f] for f in ("themeName", "fileType", "reasoning") if f in v), None) for k, v in answers.FALLBACKS.items()}
    named = {"theme_extraction": "CASE WHEN p_size % 3 > 0 THEN 'Changes in ' || p_name ELSE 'Unknown Theme' END", "theme_naming": "CASE WHEN p_size % 3 > 0 THEN p_name ELSE 'Unnamed Theme' END", "code_analysis": "p_brand"}
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {named.get(k) or _quoted(v)}" for k, v in fixed.items()) + " END"


ANSWER_SQL = f"""
WITH a AS (SELECT p_partkey AS key, {_list(KINDS)}[p_partkey % {len(KINDS)} + 1] AS kind, {_list([t for row in TEXTS for t in row])}[p_partkey % {len(KINDS)} * {_N} + p_size % {_N} + 1] AS t, p_name, p_brand, p_size FROM part),
b AS (SELECT *, CASE WHEN json_valid(t) THEN t WHEN contains(t, '```json') THEN regexp_extract(t, '(?s)```json\\s*(.*?)\\s*```', 1) ELSE nullif(regexp_extract(t, '(?s)\\{{.*\\}}', 0), '') END AS found FROM a),
c AS (SELECT *, CASE WHEN json_valid(found) THEN found::JSON END AS j,
        CASE WHEN kind IN ('similarity_check', 'cross_level_similarity') AND ((regexp_matches(t, '(?i)"shouldMerge":\\s*false') AND regexp_matches(t, '(?i)"confidence":\\s*0\\.([0-2])\\d*')) OR regexp_matches(t, '(?i)"relationship":\\s*"none"'))
             THEN coalesce(nullif(regexp_extract(t, '"confidence":\\s*(0\\.\\d+)', 1), '')::DOUBLE, 0.1::DOUBLE) END AS sure FROM b),
d AS (SELECT *, CASE WHEN sure < 0.3::DOUBLE THEN 'refused' WHEN coalesce(json_type(j), '') <> 'OBJECT' THEN 'no-json' WHEN kind = 'other' THEN 'no-schema' END AS early, {_issues_sql(False)} AS i, {_issues_sql(True)} AS p FROM c),
e AS (SELECT *, coalesce(early, CASE WHEN len(i) = 0 THEN 'valid' ELSE 'rejected' END) AS status FROM d)
SELECT key, kind, status, CASE status WHEN 'rejected' THEN array_to_string(list_transform(i, lambda x: x.path || '=' || x.reason), ';') WHEN 'no-json' THEN '=no object' ELSE '' END AS issues,
  CASE status WHEN 'refused' THEN sure WHEN 'valid' THEN TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS confidence,
  coalesce(json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'confidence'), false) AS partial_ok, coalesce(json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'confidence') AND len(p) = 0, false) AS partial_clean,
  CASE WHEN status NOT IN ('valid', 'refused') THEN {_stand_in_sql()} END AS stand_in FROM e
"""

QUERIES = {"answer_check": answer_check}
ORACLES = {"answer_check": ANSWER_SQL}
