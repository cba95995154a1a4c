"""Rule queries: ordered path, text and key rules over parts, whose names, sizes and types are spelt as files and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, jsonx
from ..functions import predicates as pred
from ..functions import text as texts
from .tables import read

FOLDERS = ("src/components", "src/utils", "tests", "src/api", "config", "__tests__", "docs", "src/types", "src/helpers", "src/auth", "src/ui/test", "lib")
ENDINGS = (".ts", ".test.ts", ".spec.js", ".json", ".md", ".css", ".tsx", ".yml", ".sql", ".d.ts", ".config.js", "")
NAMES = ("useThing", "CONST_A", "Widget", "helper", "Use", "useful")
LETTERS = ("A", "M", "D", "R", "C", "?", "T")
DIFFS = ("+ added", "- removed", "+ a\n- b", "same", "")
SENTENCES = (
    "Replaced console.warn with structured logging", "Add import for user authentication, and fix typo", "New feature: payment workflow for checkout", "HTTP 429 Too Many Requests",
    "JSON parse error at line 3", "network timeout after 30 s", "This is the user that waits.", "Improve Error Handling", "fix typo in a single small file as a change",
    "multiple components of a business feature", "import a\nfrom b", "file, file and file of the file", "function main() { return 1 }", " padded name ", "ok", "Update test config component and add service util model for many things at once today",
    "unauthorized: 401", "export const answer = 42", "503 from upstream", "user workflow",
)
LEVELS = ("simple", "complex", "moderate", None)


def _pick(values, n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: key, path, name, letter, diff, sentence and the next sentence as context."""
    p = read(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(_pick(FOLDERS, size % len(FOLDERS)), F.when(size % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")))), _pick(ENDINGS, k % len(ENDINGS)))
    return p.select(
        k.alias("key"), path.alias("path"), _pick(NAMES, size % len(NAMES)).alias("name"), _pick(LETTERS, k % len(LETTERS)).alias("letter"), _pick(DIFFS, size % len(DIFFS)).alias("diff"),
        _pick(SENTENCES, k % len(SENTENCES)).alias("said"), _pick(SENTENCES, (k + size) % len(SENTENCES)).alias("context"), size.alias("n"), F.col("p_name").alias("p_name"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"),
        _pick(LEVELS, size % len(LEVELS)).alias("level"),
    )


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _any(column: str, patterns) -> str:
    return f"regexp_matches({column}, {_quoted('|'.join('(?:' + p + ')' for p in patterns))})"


def _holds(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(p)})" for p in parts) + ")"


def _ends(column: str, parts) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {_quoted(p)})" for p in parts) + ")"


def _case(cases, default) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


_FILES_SQL = f"""
f AS (SELECT p_partkey AS key, {_list(FOLDERS)}[p_size % {len(FOLDERS)} + 1] || CASE WHEN p_size % 5 = 0 THEN '' ELSE '/' || replace(p_name, ' ', '_') END || {_list(ENDINGS)}[p_partkey % {len(ENDINGS)} + 1] AS path,
  {_list(NAMES)}[p_size % {len(NAMES)} + 1] AS name, {_list(LETTERS)}[p_partkey % {len(LETTERS)} + 1] AS letter, {_list(DIFFS)}[p_size % {len(DIFFS)} + 1] AS diff,
  {_list(SENTENCES)}[p_partkey % {len(SENTENCES)} + 1] AS said, {_list(SENTENCES)}[(p_partkey + p_size) % {len(SENTENCES)} + 1] AS context, p_size AS n, p_name, p_retailprice AS price, p_brand AS brand, {_list(LEVELS)}[p_size % {len(LEVELS)} + 1] AS level FROM part)
"""


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path alone says of a file: kind, change type, context, the fallbacks' domain, analysis and context, what it tests."""
    f, p = _files(spark, sf_dir), F.col("path")
    domain, analysis, context = texts.fallback_domain(p), texts.fallback_analysis(p, F.col("diff")), texts.fallback_file_context(p)
    kind = pred.diff_file_kind(p)
    rules = {
        "kind": kind, "change_type": pred.change_type_of_file(p), "context_type": pred.context_type(p), "domain": domain["domain"], "domain_confidence": domain["confidence"],
        "analysis": F.concat_ws("/", analysis["change_type"], analysis["impact"]), "analysis_confidence": analysis["confidence"],
        "file_context": F.concat_ws("/", context["context_type"], context["purpose"], context["role"], context["significance"]), "user_facing": context["user_facing"],
        "tested": code.tested_file(p), "component": code.component_type(F.col("name"), p, kind), "status": pred.change_status(F.col("letter")), "valid_name": pred.valid_file_name(p),
        "language": texts.language_context(F.regexp_extract(p, r"\.([^.]*)$", 1)),
    }
    return f.select("key", *[c.alias(name) for name, c in rules.items()])


_KIND = _case(
    [(_holds("path", (".test.", ".spec.", "__tests__")), "'test'"), (f"{_ends('path', ('.md',))} OR {_holds('path', ('README',))}", "'documentation'"), (_ends("path", (".css", ".scss", ".less")), "'style'"),
     (f"contains(path, 'config') OR {_ends('path', ('.json', '.yaml', '.yml'))}", "'config'"), (f"{_holds('path', ('webpack', 'rollup', 'vite'))} OR ends_with(path, '.build.js')", "'build'"),
     (f"{_ends('path', ('.sql', '.graphql'))} OR contains(path, 'schema')", "'data'")], "'source'")
_CHANGE = _case(
    [(_holds("path", (".test.", ".spec.", "/test/")), "'test'"), (f"contains(path, 'config') OR {_ends('path', ('.json', '.yaml', '.yml'))}", "'config'"), (_holds("path", ("/components/", "/ui/", ".css", ".scss")), "'ui'"),
     (_holds("path", ("/api/", "/services/", "/business/")), "'logic'"), ("contains(path, '/types/') OR ends_with(path, '.d.ts')", "'types'"), (_holds("path", ("/utils/", "/helpers/")), "'utils'"), ("contains(path, 'README') OR ends_with(path, '.md')", "'docs'")],
    "'implementation'")
_DOMAIN = [
    (_holds("base", ("test", "spec")), "test"), (_holds("base", ("auth", "login")), "auth"), (_holds("base", ("log", "debug")), "log"), ("contains(base, 'config') OR ends_with(file, '.json')", "config"), (_holds("base", ("component", "ui")), "ui"),
]
_SIDES = "CASE WHEN contains(diff, '-') AND NOT contains(diff, '+') THEN 1 WHEN contains(diff, '+') AND NOT contains(diff, '-') THEN 2 ELSE 3 END"
_QUIET = "test OR contains(low, 'config') OR ends_with(low, '.json')"
PATH_SQL = f"""
WITH {_FILES_SQL},
x AS (SELECT *, path AS base, regexp_extract(path, '[^/]*$', 0) AS file, lower(path) AS low, contains(lower(path), 'test') OR contains(lower(path), 'spec') AS test, {_holds("path", ("test", "spec"))} AS seems_test, {_SIDES} AS sides,
        lower(list_last(string_split(regexp_extract(path, '[^/]*$', 0), '.'))) AS ext, {_KIND} AS kind FROM f),
y AS (SELECT *, contains(path, 'config') OR ext IN ('json', 'yaml', 'yml') AS config FROM x)
SELECT key, kind, {_CHANGE} AS change_type, {_case([(_holds("path", ("test", "spec")), "'test'"), (f"contains(path, 'config') OR {_ends('path', ('.json', '.yml'))}", "'config'"), (_ends("path", (".ts", ".js")), "'function'")], "'module'")} AS context_type,
  {_case([(c, _quoted(texts.FALLBACK_DOMAIN[k][0])) for c, k in _DOMAIN], _quoted(texts.FALLBACK_DOMAIN[""][0]))} AS domain, {_case([(c, f"{texts.FALLBACK_DOMAIN[k][1]}::DOUBLE") for c, k in _DOMAIN], f"{texts.FALLBACK_DOMAIN[''][1]}::DOUBLE")} AS domain_confidence,
  CASE WHEN {_QUIET} OR sides <> 2 THEN 'refactoring/internal' ELSE 'new-feature/enhancement' END AS analysis, CASE WHEN {_QUIET} THEN 0.4 WHEN sides < 3 THEN 0.3 ELSE 0.2 END::DOUBLE AS analysis_confidence,
  CASE WHEN seems_test THEN 'test/Test coverage/Testing infrastructure' WHEN config THEN 'config/Configuration/System configuration' ELSE 'function/System component/Application logic' END || CASE WHEN config THEN '/high' ELSE '/medium' END AS file_context,
  {_holds("path", ("component", "ui"))} AS user_facing,
  CASE WHEN regexp_matches(path, '(.*)\\.test\\.(ts|tsx|js|jsx)$') THEN regexp_replace(path, '\\.test\\.(ts|tsx|js|jsx)$', '.\\1') WHEN regexp_matches(path, '(.*)\\.spec\\.(ts|tsx|js|jsx)$') THEN regexp_replace(path, '\\.spec\\.(ts|tsx|js|jsx)$', '.\\1')
       WHEN regexp_matches(path, '__tests__/(.+)\\.(ts|tsx|js|jsx)$') THEN regexp_extract(path, '__tests__/(.+\\.(?:ts|tsx|js|jsx))$', 1) END AS tested,
  CASE WHEN regexp_matches(name, '^[A-Z]') AND kind = 'source' THEN CASE WHEN contains(path, 'components') THEN 'class' ELSE 'type' END WHEN regexp_matches(name, '^use[A-Z]') THEN 'function' WHEN regexp_matches(name, '^[A-Z_]+$') THEN 'constant'
       WHEN {_holds("path", ("utils", "helpers"))} THEN 'utility' ELSE 'function' END AS component,
  CASE letter {" ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in pred.STATUS.items())} ELSE 'modified' END AS status, NOT {_holds("path", ("..", "/", chr(92)))} AND regexp_matches(path, '^[A-Za-z0-9._-]+$') AS valid_name,
  CASE regexp_extract(path, '\\.([^.]*)$', 1) {" ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in texts.LANGUAGE_CONTEXT.items())} ELSE 'Unknown' END AS language FROM y
"""


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sentence says of a change: complexity by four rule sets, naming, aspects, names, errors, limits."""
    f, said, context, p, n = _files(spark, sf_dir), F.col("said"), F.col("context"), F.col("path"), F.col("n")
    plain, wide = texts.change_complexity(said, p), texts.change_complexity(said, p, context)
    naming, profile = texts.naming_strategy(F.col("level"), said, p), texts.complexity_profile(n % 4, n % 3, F.col("name"), said, said, context)
    themes, verdict = texts.themes_complexity(n % 4, n % 3, said, F.concat_ws(" ", said, context)), texts.context_verdict(context)
    with_context = texts.themes_complexity(n % 4, n % 3, said, F.concat_ws(" ", said, context), context)
    aspects = texts.multiple_aspects(F.col("name"), said)
    flags = lambda s: F.concat_ws("/", s["simple"].cast("string"), s["complex"].cast("string"))
    rules = {
        "complexity": flags(plain), "complexity_confidence": plain["confidence"], "wide_complexity": flags(wide), "naming": F.concat_ws("/", naming["complexity"], naming["approach"], naming["max_words"].cast("string")),
        "profile": F.concat_ws("/", profile["complexity"], profile["pattern"]), "profile_confidence": profile["confidence"], "themes": F.concat_ws("/", themes["complexity"], themes["pattern"]),
        "themes_in_context": F.concat_ws("/", with_context["complexity"], with_context["pattern"]), "verdict": flags(verdict), "examples": F.get(texts.pattern_examples(F.array(profile["pattern"])), F.lit(0)),
        "aspects": aspects, "expand": pred.worth_expanding(n % 5, said, aspects), "domain_name": pred.valid_domain_name(said), "theme_name": pred.valid_theme_name(said), "rate_limited": pred.is_rate_limit_error(said),
        "retryable": texts.retryable(said), "key_change": pred.is_key_change(said), "limited": texts.word_limit(said, 5), "truncated": texts.truncated(said, 30), "significant": pred.significant_issues(n % 2, n % 3, F.col("level")),
        "validated": texts.validated(F.col("level"), "impact"), "functions": code.count_functions(said).cast("long"), "classes": code.count_classes(said).cast("long"),
    }
    return f.select("key", *[c.alias(name) for name, c in rules.items()])


def _complexity_sql(simple, hard, wide: bool) -> tuple[str, str]:
    hit = lambda ps: f"{_any('low', ps)} OR {_any('lcontext', ps)}" if wide else _any("low", ps)
    is_simple = f"({hit(simple)} OR {_holds('lower(path)', ('test', 'spec'))} OR (contains(low, 'import') AND len(string_split(low, chr(10))) < 5))"
    is_complex = f"({hit(hard)} OR len(string_split(low, 'file')) > 3 OR {_holds('low', ('new feature', 'business requirement'))})"
    return is_simple, is_complex


_S, _C = _complexity_sql(texts.SIMPLE_CHANGE, texts.COMPLEX_CHANGE, False)
_WS, _WC = _complexity_sql(texts.SIMPLE_CHANGE_WIDE, texts.COMPLEX_CHANGE_WIDE, True)
_PROFILE = [
    (f"n % 4 = 1 AND n % 3 <= 2 AND {_any('every', texts.SIMPLE_TECHNICAL_WIDE)}", "simple", 0.9, "single-file-technical-change"),
    (f"n % 4 >= 3 OR {_any('some_', texts.BUSINESS_FEATURE_WIDE)}", "complex", 0.8, "multiple-themes-or-business-feature"),
    (_any("lcontext", texts.CONTEXT_SIMPLE_WIDE), "simple", 0.95, "simple-context-pattern"),
]
_THEMES = [
    (f"n % 4 = 1 AND n % 3 <= 2 AND {_any('low', texts.SIMPLE_TECHNICAL)}", "simple/single-file-technical-change"), (f"n % 4 >= 3 OR {_any('both_', texts.BUSINESS_FEATURE)}", "complex/multiple-themes-or-business-feature"),
]
_MODERATE = "'moderate/moderate-complexity-default'"
_FOUND = lambda words: " + ".join(f"contains(nd, '{w}')::INT" for w in words)
_RETRY = [
    (_holds("low", ("network", "connection", "timeout", "econnreset", "enotfound")), "true"), (_holds("low", ("rate limit", "too many requests", "429")), "true"), (_holds("low", ("500", "502", "503", "504")), "true"),
    (_holds("low", ("json", "parse", "syntax")), "false"), (_holds("low", ("raw mode is not supported", "israwmodesupported", "configuration error", "ci environment")), "false"), (_holds("low", ("auth", "unauthorized", "forbidden", "401", "403")), "false"),
]
_PATTERN = _case([(c, _quoted(p)) for c, _, _, p in _PROFILE], "'moderate-complexity-default'")
TEXT_SQL = f"""
WITH {_FILES_SQL},
x AS (SELECT *, lower(said) AS low, lower(context) AS lcontext, lower(name || ' ' || said || ' ' || said || ' ' || context) AS every, lower(name || ' ' || said || ' ' || said) AS some_, lower(said || ' ' || context) AS both_, lower(name || ' ' || said) AS nd,
        string_split_regex(trim(said), '\\s+') AS words FROM f),
y AS (SELECT *, {_S} AS s, {_C} AS c, {_WS} AS ws, {_WC} AS wc, {_PATTERN} AS pattern, ({_FOUND(texts.ACTIONS)}) > 1 OR {_holds("nd", (" and ", ", "))} OR ({_FOUND(texts.ASPECT_TYPES)}) > 1 AS aspects FROM x)
SELECT key, s || '/' || c AS complexity, CASE WHEN s OR c THEN 0.9 ELSE 0.6 END::DOUBLE AS complexity_confidence, ws || '/' || wc AS wide_complexity,
  CASE WHEN coalesce(level, 'moderate') = 'simple' OR s THEN 'simple/technical-specific/12' WHEN coalesce(level, 'moderate') = 'complex' OR c THEN 'complex/business-focused/8' ELSE 'moderate/hybrid/10' END AS naming,
  {_case([(c, _quoted(f"{k}/{p}")) for c, k, _, p in _PROFILE], _MODERATE)} AS profile, {_case([(c, f"{x}::DOUBLE") for c, _, x, _ in _PROFILE], "0.7::DOUBLE")} AS profile_confidence,
  {_case([(c, _quoted(v)) for c, v in _THEMES], _MODERATE)} AS themes, {_case([(_any("lcontext", texts.CONTEXT_SIMPLE), "'simple/simple-context-pattern'"), *[(c, _quoted(v)) for c, v in _THEMES]], _MODERATE)} AS themes_in_context,
  {_any("lcontext", texts.CONTEXT_SIMPLE_WIDE)} || '/' || {_any("lcontext", texts.CONTEXT_COMPLEX)} AS verdict, CASE pattern {" ".join(f"WHEN {_quoted(k)} THEN {_quoted(v[0])}" for k, v in texts.PATTERN_EXAMPLES.items())} END AS examples,
  aspects, (n % 5 > 2 OR length(said) > 100) AND aspects AS expand,
  length(said) BETWEEN 3 AND 30 AND trim(said) = said AND len(words) BETWEEN 2 AND 5 AND NOT {_any("said", (r"(?i:^(?:this|it|based|the)\s)", r"\.$", r"(?i:\bthat\b)", r"(?i:\bwhich\b)", '^".*"$'))} AS domain_name,
  length(said) BETWEEN 3 AND 50 AND NOT {_any("low", ("error", "failed"))} AND trim(said) = said AS theme_name, {_holds("low", pred.RATE_LIMIT)} AS rate_limited, {_case(_RETRY, "true")} AS retryable, {_any("said", pred.KEY_CHANGE)} AS key_change,
  CASE WHEN len(words) <= 5 THEN said ELSE array_to_string(words[1:5], ' ') END AS limited, CASE WHEN length(said) > 30 THEN substring(said, 1, 27) || '...' ELSE said END AS truncated,
  n % 2 > 0 OR n % 3 >= 2 OR coalesce(level IN ('high', 'critical'), NULL) AS significant, 'internal' AS validated,
  {" + ".join(f"len(regexp_extract_all(said, {_quoted(p)}))" for p in code.FUNCTION_FORMS)} AS functions, {" + ".join(f"len(regexp_extract_all(said, {_quoted(p)}))" for p in code.CLASS_FORMS)} AS classes FROM y
"""


def key_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and identifiers of files and pairs: content, struct, typed, unordered and prefix keys, hierarchical identifiers, names."""
    f = _files(spark, sf_dir)
    p, said, name = F.col("path"), F.col("said"), F.col("p_name")
    rules = {
        "content": jsonx.content_key(p, said), "struct": jsonx.struct_key(name, F.col("n")), "typed": jsonx.typed_key(F.lit("analysis"), p, said), "pair": jsonx.pair_key(name, F.col("brand")), "prefix": jsonx.prefix_key(p, said),
        "child": jsonx.hierarchical_id("sub", F.when(F.col("n") % 3 > 0, name), F.col("n")), "secure": jsonx.secure_name(p), "size": jsonx.json_size(F.struct(name, F.col("n"))).cast("long"),
        "log": jsonx.log_name("log-", F.timestamp_millis(F.col("key") * 86_400_123)),
    }
    return f.select("key", *[c.alias(k) for k, c in rules.items()])


KEY_SQL = f"""
WITH {_FILES_SQL}, x AS (SELECT *, string_split_regex(path, '[-_]') AS parts, '{{"p_name":"' || p_name || '","n":' || n || '}}' AS js FROM f)
SELECT key, substr(sha256(path || ':' || said), 1, 16) AS content, substr(sha256(js), 1, 16) AS struct, 'analysis:' || path || ':' || substr(sha256(said), 1, 8) AS typed, least(p_name, brand) || '-' || greatest(p_name, brand) AS pair,
  substr(base64(encode(path || '-' || said)), 1, 16) AS prefix, CASE WHEN n % 3 > 0 THEN p_name ELSE 'root' END || '_sub_' || n AS child, len(parts) >= 3 AND len(list_filter(parts, lambda s: s = '')) = 0 AS secure, 2 * length(js) AS size,
  'log-' || replace(replace(strftime(make_timestamp(key * 86400123000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', ':', '-'), '.', '-') AS log FROM x
"""

QUERIES = {"path_rules": path_rules, "text_rules": text_rules, "key_rules": key_rules}
ORACLES = {"path_rules": PATH_SQL, "text_rules": TEXT_SQL, "key_rules": KEY_SQL}
