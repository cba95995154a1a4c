"""JSON answers inside prose, hashing keys and identifiers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def balanced(text: str) -> list[str]:
    """Top-level balanced {...} and [...] stretches, minding strings and escapes."""
    found, depth, start, quoted, skip = [], {"{": 0, "[": 0}, -1, False, False
    pair = {"}": "{", "]": "["}
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c in depth:
            if not any(depth.values()):
                start = i
            depth[c] += 1
        elif c in pair:
            depth[pair[c]] -= 1
            if not any(depth.values()) and start != -1:
                found.append(text[start : i + 1])
                start = -1
    return found


def _first_valid(text: str | None) -> str | None:
    for x in balanced(text or ""):
        try:
            json.loads(x)
        except ValueError:
            continue
        return x
    return None


@F.pandas_udf(StringType())
def balanced_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """First balanced stretch that parses: the one scan that no built-in expression states."""
    for s in texts:
        yield s.map(_first_valid)


def _valid(text: Column) -> Column:
    # the parser stops after one value; as the only element of an array nothing may follow it
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(F.try_parse_json(text).isNotNull() & (F.trim(text) != "") & alone, text)


def extract_json(text: Column) -> Column:
    """JSON text of an answer, or null: the whole; a block fenced as json (whose failure is final); any
    fenced block; the widest braces; the widest brackets; the first balanced stretch that parses."""
    t = F.trim(text)
    fenced = r"(?s)```json\s*(.*?)\s*```"
    bare, braces, brackets = r"(?s)```\s*(.*?)\s*```", r"(?s)\{.*\}", r"(?s)\[.*\]"
    loose = F.coalesce(_valid(F.trim(F.regexp_extract(t, bare, 1))), _valid(F.regexp_extract(t, braces, 0)), _valid(F.regexp_extract(t, brackets, 0)))
    # the scan runs only for what nothing else settles
    rest = F.when(_valid(t).isNull() & ~t.rlike(fenced) & loose.isNull(), t)
    return F.coalesce(_valid(t), F.when(t.rlike(fenced), _valid(F.trim(F.regexp_extract(t, fenced, 1)))).otherwise(F.coalesce(loose, balanced_json(rest))))


def has_keys(text: Column, keys: list[str]) -> Column:
    """An object that holds all keys (their values may be null)."""
    found = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), found)) == 0


def valid_answer(text: Column, keys: list[str]) -> Column:
    """Struct (json, ok)."""
    j = extract_json(text)
    return F.struct(j.alias("json"), F.coalesce(has_keys(j, keys), F.lit(False)).alias("ok"))


def content_key(file: Column, diff: Column) -> Column:
    """First 16 hex digits of sha256(file:diff)."""
    return F.substring(F.sha2(F.concat_ws(":", file, diff), 256), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    """Unordered pair as one text."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def struct_key(*columns: Column) -> Column:
    """First 16 hex digits of sha256 over the JSON of the columns in the given order."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def typed_key(kind: Column, file: Column, content: Column) -> Column:
    return F.concat_ws(":", kind, file, F.substring(F.sha2(content, 256), 1, 8))


def prefix_key(identifier: Column, rest: Column) -> Column:
    """First 16 base64 digits: the first 12 bytes, in effect a prefix of the identifier."""
    return F.substring(F.base64(F.encode(F.concat_ws("-", identifier, rest), "UTF-8")), 1, 16)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Deterministic identifier of a row (in place of a random one)."""
    return F.concat(F.lit(f"{prefix}-"), F.lower(F.hex(F.xxhash64(*parts))))


def hierarchical_id(kind: str, parent: Column, ordinal: Column) -> Column:
    return F.concat_ws("_", F.coalesce(parent, F.lit("root")), F.lit(kind), ordinal.cast("string"))


def secure_name(name: Column) -> Column:
    """Parts split at dashes and underscores: at least three, none empty."""
    parts = F.split(name, "[-_]")
    return (F.size(parts) >= 3) & F.forall(parts, lambda p: p != "")


def log_name(prefix: str, at: Column) -> Column:
    """File name of a timestamp with ':' and '.' as '-'."""
    return F.concat(F.lit(prefix), F.translate(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--"))


def json_size(value: Column) -> Column:
    """Estimate of an answer's memory: two bytes a character of its JSON."""
    return F.length(F.to_json(value)) * 2
