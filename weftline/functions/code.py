"""Diff and code expressions: symbols, imports, exports, test targets, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import first_of, lookup, nonempty_match

# ---- fixed values: patterns and weights ----
HUNK = r"@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)"
CONTEXT_NAMES = (r"function\s+(\w+)", r"class\s+(\w+)", r"interface\s+(\w+)", r"const\s+(\w+)", r"export\s+\w+\s+(\w+)")
IMPORT = r"""import\s+(?:(\*\s+as\s+\w+)|(\{[^}]+\})|(\w+))?\s*(?:,\s*(?:(\*\s+as\s+\w+)|(\{[^}]+\})|(\w+)))?\s*from\s+['"]([^'"]+)['"]"""
EXPORT_DEFAULT = r"export\s+default\s+"
EXPORT_NAMED = r"export\s+(?:const|let|var|function|class|interface|type)\s+(\w+)"
SYMBOLS = (r"function\s+(\w+)", r"class\s+(\w+)", r"const\s+(\w+)", r"let\s+(\w+)", r"var\s+(\w+)")
TESTED = ((r"(.*)\.test\.(ts|tsx|js|jsx)$"), (r"(.*)\.spec\.(ts|tsx|js|jsx)$"), (r"__tests__/(.+)\.(ts|tsx|js|jsx)$"))
FUNCTION_FORMS = (r"function\s+\w+", r"\w+\s*:\s*function", r"\w+\s*=>\s*\{", r"async\s+\w+\s*\(", r"\w+\s*\([^)]*\)\s*\{", r"export\s+function\s+\w+", r"private\s+\w+\s*\(", r"public\s+\w+\s*\(")
CLASS_FORMS = (r"class\s+\w+", r"interface\s+\w+", r"type\s+\w+\s*=", r"enum\s+\w+", r"export\s+class\s+\w+", r"export\s+interface\s+\w+")
CONDITIONALS, BRANCHES = r"if\s*\(|switch\s*\(|case\s+|ternary\s*\?", r"if\s*\(|case\s+"
LOOPS, ERRORS, ASYNC = r"for\s*\(|while\s*\(|forEach|map\(|filter\(", r"try\s*\{|catch\s*\(|throw\s+|\.catch\(", r"async\s+|await\s+|Promise\.|\.then\("
TYPE_WEIGHT = {"source": 1.0, "test": 0.5, "config": 0.3, "documentation": 0.1, "style": 0.2, "build": 0.4, "data": 0.6}
SPECIFICITY = {"modifies": 5, "modified-by": 5, "depends-on": 4, "dependency-of": 4, "uses": 3, "used-by": 3, "shared-utility": 2, "related-feature": 1}
REVERSED = {"uses": "used-by", "modifies": "modified-by", "depends-on": "dependency-of"}
IMPACT = {"breaking": "breaking", "enhancement": "enhancement", "fix": "fix", "internal": "refactor"}


def semantic_context(header: Column) -> Column:
    """Name of the function, class, interface, const or export in a hunk header, or null."""
    return F.coalesce(*[nonempty_match(header, p) for p in CONTEXT_NAMES])


def import_of(line: Column) -> Column:
    """Struct (module, items) of an import on one line, or null. Namespace items keep the source's doubled prefix."""
    g = lambda i: F.regexp_extract(line, IMPORT, i)
    either = lambda a, b: F.when(g(a) != "", g(a)).otherwise(g(b))
    space, named, plain = either(1, 4), either(2, 5), either(3, 6)
    none = F.array().cast("array<string>")
    items = F.concat(
        F.when(space != "", F.array(F.concat(F.lit("* as "), space))).otherwise(none),
        F.when(named != "", F.transform(F.split(F.regexp_replace(named, r"[{}]", ""), ","), lambda s: F.trim(s))).otherwise(none),
        F.when(plain != "", F.array(plain)).otherwise(none),
    )
    return F.when(line.rlike(IMPORT), F.struct(g(7).alias("module"), items.alias("items")))


def export_of(line: Column) -> Column:
    """Struct (name, export_type) of an export on one line, default before named, or null."""
    row = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("export_type"))
    name = F.coalesce(nonempty_match(line, EXPORT_DEFAULT + r"(\w+)"), F.lit("default"))
    return F.when(line.rlike(EXPORT_DEFAULT), row(name, "default")).when(line.rlike(EXPORT_NAMED), row(F.regexp_extract(line, EXPORT_NAMED, 1), "named"))


def symbols(line: Column) -> Column:
    """Declared names, distinct, by pattern then place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in SYMBOLS]))


def resolve_import(path: Column, module: Column, mode: str = "faithful") -> Column:
    """Directory of ``path`` and the module. Faithful keeps './'; fixed removes './' and every '../' with
    the folder before it and adds '.ts' where the module has no extension."""
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    joined = F.concat(folder, F.lit("/"), module)
    if mode == "faithful":
        return F.when(F.contains(joined, F.lit(".")), joined).otherwise(F.concat(joined, F.lit(".ts")))
    parts = F.split(F.regexp_replace(joined, r"/(?:\./)+", "/"), "/")
    last = F.element_at(parts, -1)
    # a '..' takes off the folder before it, if there is one; any number of them
    step = lambda kept, x: F.when((x == "..") & ~F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")).isin("", ".."), F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.array_append(kept, x))
    folders = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<string>"), step)
    out = F.regexp_replace(F.array_join(F.array_append(folders, last), "/"), r"^/", "")
    return F.when(out.rlike(r"\.[A-Za-z0-9]+$"), out).otherwise(F.concat(out, F.lit(".ts")))


def tested_file(path: Column) -> Column:
    """The file that a test file tests, by name, or null."""
    return F.coalesce(*[F.when(path.rlike(p), F.concat(F.regexp_extract(path, p, 1), F.lit("."), F.regexp_extract(path, p, 2))) for p in TESTED])


def component_type(name: Column, path: Column, file_kind: Column) -> Column:
    has = lambda p: F.contains(path, F.lit(p))
    return first_of(
        [(name.rlike("^[A-Z]") & (file_kind == "source"), F.when(has("components"), "class").otherwise("type")), (name.rlike("^use[A-Z]"), "function"), (name.rlike("^[A-Z_]+$"), "constant"), (has("utils") | has("helpers"), "utility")],
        "function",
    )


def count_forms(text: Column, forms) -> Column:
    """Sum of matches of all patterns; overlapping forms count more than once."""
    return sum((F.regexp_count(text, F.lit(p)) for p in forms[1:]), F.regexp_count(text, F.lit(forms[0])))


def count_functions(text: Column) -> Column:
    return count_forms(text, FUNCTION_FORMS)


def count_classes(text: Column) -> Column:
    return count_forms(text, CLASS_FORMS)


def complexity_flags(text: Column) -> Column:
    """Struct of flags, branches (only where a conditional is found) and brace imbalance of one snippet."""
    conditional = text.rlike(CONDITIONALS)
    return F.struct(
        conditional.alias("conditionals"), text.rlike(LOOPS).alias("loops"), text.rlike(ERRORS).alias("errors"), text.rlike(ASYNC).alias("asynchronous"),
        F.when(conditional, F.regexp_count(text, F.lit(BRANCHES))).otherwise(0).alias("branches"), F.abs(F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))).alias("nesting"),
    )


def file_complexity(changes: Column, kind: Column, semantic: Column, imports: Column, exports: Column) -> Column:
    return F.least(changes, F.lit(10)) * lookup(kind, TYPE_WEIGHT, 1.0) * (semantic + 1) * (imports + exports + 1) / 10


def specificity(relationship: Column) -> Column:
    return lookup(relationship, SPECIFICITY, 0)


def reversed_relationship(relationship: Column) -> Column:
    return lookup(relationship, REVERSED, relationship)


def semantic_impact(impact: Column) -> Column:
    return lookup(impact, IMPACT, "refactor")


def depends_on(source_paths: Column, test_paths: Column) -> Column:
    """Some test path contains some source path without its extension."""
    is_test = lambda f: F.contains(f, F.lit(".test.")) | F.contains(f, F.lit(".spec."))
    sources = F.filter(source_paths, lambda f: ~is_test(f))
    return F.exists(F.filter(test_paths, is_test), lambda t: F.exists(sources, lambda s: F.contains(t, F.regexp_replace(s, r"\.[^.]+$", ""))))


def first_diff_file(text: Column) -> Column:
    """Path of the first '---' or '+++' line without its a/ or b/."""
    return F.regexp_replace(nonempty_match(text, r"(?m)^[+-]{3}\s+(.+)$"), r"^[ab]/", "")


def hunk_starts(text: Column) -> Column:
    """array<struct(old_start, new_start)> of all hunk headers."""
    p = r"@@ -(\d+),?\d* \+(\d+),?\d* @@"
    old, new = F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2))
    return F.zip_with(old, new, lambda a, b: F.struct(a.cast("int").alias("old_start"), b.cast("int").alias("new_start")))
