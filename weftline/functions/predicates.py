"""Path and text classifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import any_match, first_of, holds, labels, lookup

# ---- fixed values: patterns and tables that decide the classes ----
EXCLUDED = (r"^dist/", r"\.d\.ts$", r"node_modules/", r"\.map$", r"package-lock\.json$", r"\.md$", r"\.txt$", r"\.json$")
TEST_FILE = (r"\.test\.", r"\.spec\.", r"^tests?/", r"^spec/", r"__tests__/", r"\.test$", r"\.spec$")
CONFIG_FILE = (
    r"\.config\.", r"^package\.json$", r"^tsconfig", r"^jest\.config", r"^webpack\.config", r"^\.env", r"^\.eslintrc", r"^\.prettierrc",
    r"(?i:^docker)", r"(?i:^makefile$)", r"\.ya?ml$", r"\.toml$", r"\.ini$",
)
LANGUAGES = {
    ".ts": "TypeScript", ".js": "JavaScript", ".py": "Python", ".java": "Java", ".go": "Go", ".rs": "Rust", ".cpp": "C++", ".c": "C",
    ".cs": "C#", ".php": "PHP", ".rb": "Ruby", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".sh": "Shell", ".sql": "SQL",
    ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".xml": "XML", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".md": "Markdown",
}
KEY_CHANGE = (r"(?i:api\s*\()", r"export", r"public\s+", r"return\s+", r"throw\s+", r"async\s+", r"await\s+", r"new\s+", r"delete\s+")
RATE_LIMIT = ("rate_limit_error", "rate limit", "too many requests", "quota exceeded", "429", "throttled")
STATUS = {"A": "added", "M": "modified", "D": "removed", "R": "renamed", "T": "modified"}
DOMAINS = (
    (("test", "spec", "quality"), "Development Workflow Optimization"),
    (("config", "setting", "deploy"), "Development Workflow Optimization"),
    (("auth", "login", "password", "security", "account"), "User Account Management"),
    (("payment", "purchase", "order", "transaction", "billing"), "Transaction Processing"),
    (("search", "discover", "browse", "filter", "recommend"), "Content Discovery"),
    (("message", "notification", "email", "alert", "communication"), "Communication & Collaboration"),
    (("ui", "component", "interface", "design", "layout"), "User Experience Enhancement"),
    (("data", "database", "storage", "backup", "export"), "Data Management"),
    (("api", "endpoint", "service", "integration", "connect"), "Integration & Connectivity"),
    (("report", "analytics", "dashboard", "metrics", "insights"), "Analytics & Insights"),
    (("workflow", "automation", "process", "efficiency", "streamline"), "Workflow Automation"),
    (("create", "author", "edit", "publish", "content"), "Content Creation & Publishing"),
    (("error", "fix", "bug", "debug", "log"), "Development Workflow Optimization"),
)
DEFAULT_DOMAIN = "User Experience Enhancement"
PATTERN_LABELS = (
    (("add", "implement"), "addition"), (("remove", "delete"), "removal"), (("update", "modify"), "modification"), (("refactor",), "refactoring"),
    (("interface", "type"), "type_definition"), (("service", "class"), "service_implementation"), (("test",), "testing"), (("configuration", "config"), "configuration"),
)
KEYWORD_LABELS = (
    (("greeting",), "greeting"), (("authentication", "auth"), "authentication"), (("user", "customer"), "user_experience"), (("api", "service"), "api_service"),
    (("data", "storage"), "data_management"), (("security",), "security"), (("performance",), "performance"), (("integration",), "integration"), (("workflow", "process"), "workflow"),
)
ISSUE_CATEGORY = {
    "similarity-analysis": "similarity", "batch-similarity": "batch-sim", "domain-classification": "domain", "multi-domain-analysis": "multi-domain",
    "theme-expansion": "expansion", "theme-analysis": "theme", "code-analysis": "code", "hierarchical-analysis": "hierarchy",
}


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or ''; a leading dot of a name starts none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/]*$", 0), r"^.+(\.[^.]*)$", 1))


def included(path: Column) -> Column:
    return ~any_match(path, EXCLUDED)


def is_test_file(path: Column) -> Column:
    return any_match(path, TEST_FILE)


def is_config_file(path: Column) -> Column:
    return any_match(path, CONFIG_FILE)


def file_type(path: Column) -> Column:
    e = extension(path)
    return F.when(e == "", F.lit("unknown")).otherwise(e)


def language(path: Column) -> Column:
    return lookup(extension(path), LANGUAGES, "Unknown")


def diff_file_kind(path: Column, decided: Column | None = None) -> Column:
    """test, documentation, style, then a recorded decision, then config, build, data, source."""
    ends = lambda *e: any_match(path, [x.replace(".", r"\.") + "$" for x in e])
    cases = [(holds(path, (".test.", ".spec.", "__tests__")), "test"), (ends(".md") | holds(path, ("README",)), "documentation"), (ends(".css", ".scss", ".less"), "style")]
    if decided is not None:
        cases.append((decided.isNotNull(), lookup(decided, {"config": "config", "test": "test"}, "source")))
    cases += [
        (holds(path, ("config",)) | ends(".json", ".yaml", ".yml"), "config"),
        (holds(path, ("webpack", "rollup", "vite")) | ends(".build.js"), "build"),
        (ends(".sql", ".graphql") | holds(path, ("schema",)), "data"),
    ]
    return first_of(cases, "source")


def change_type_of_file(path: Column) -> Column:
    """The one change type a path stands for (first match decides)."""
    ends = lambda *e: any_match(path, [x.replace(".", r"\.") + "$" for x in e])
    return first_of(
        [
            (holds(path, (".test.", ".spec.", "/test/")), "test"),
            (holds(path, ("config",)) | ends(".json", ".yaml", ".yml"), "config"),
            (holds(path, ("/components/", "/ui/", ".css", ".scss")), "ui"),
            (holds(path, ("/api/", "/services/", "/business/")), "logic"),
            (holds(path, ("/types/",)) | ends(".d.ts"), "types"),
            (holds(path, ("/utils/", "/helpers/")), "utils"),
            (holds(path, ("README",)) | ends(".md"), "docs"),
        ],
        "implementation",
    )


def change_types(paths: Column, snippets: Column) -> Column:
    """Distinct change types of all paths, then those that the snippets show."""
    from_text = F.transform(snippets, lambda s: labels([(holds(s, ("import", "export")), "imports"), (holds(s, ("test(", "describe(", "it(")), "test"), (holds(s, ("interface", "type ")), "types")]))
    return F.array_distinct(F.concat(F.transform(paths, change_type_of_file), F.flatten(from_text)))


def context_type(path: Column) -> Column:
    """test, config, function (scripts) or module, by the path; the first that holds."""
    ends = lambda *names: any_match(path, [f"{re.escape(n)}$" for n in names])
    return first_of([(holds(path, ("test", "spec")), "test"), (holds(path, ("config",)) | ends(".json", ".yml"), "config"), (ends(".ts", ".js"), "function")], "module")


def is_key_change(content: Column) -> Column:
    return any_match(content, KEY_CHANGE)


def is_rate_limit_error(message: Column) -> Column:
    return holds(F.lower(message), RATE_LIMIT)


def change_status(letter: Column) -> Column:
    return lookup(letter, STATUS, "modified")


def valid_domain_name(name: Column) -> Column:
    words = F.size(F.split(F.trim(name), r"\s+"))
    sentence = any_match(name, [r"(?i:^(?:this|it|based|the)\s)", r"\.$", r"(?i:\bthat\b)", r"(?i:\bwhich\b)", r'^".*"$'])
    return F.length(name).between(3, 30) & (F.trim(name) == name) & words.between(2, 5) & ~sentence


def valid_theme_name(name: Column) -> Column:
    return F.length(name).between(3, 50) & ~any_match(F.lower(name), ["error", "failed"]) & (F.trim(name) == name)


def valid_file_name(name: Column) -> Column:
    """No traversal and only plain characters."""
    return ~holds(name, ("..", "/", "\\")) & name.rlike(r"^[A-Za-z0-9._-]+$")


def named_text(name: Column, description: Column) -> Column:
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def business_domain(name: Column, description: Column, lowered: Column | None = None) -> Column:
    """``lowered``: their ``named_text``, where it is at hand."""
    text = named_text(name, description) if lowered is None else lowered
    return first_of([(holds(text, words), domain) for words, domain in DOMAINS], DEFAULT_DOMAIN)


def pattern_labels(text: Column, lowered: Column | None = None) -> Column:
    t = F.lower(text) if lowered is None else lowered
    return labels([(holds(t, words), name) for words, name in PATTERN_LABELS])


def keyword_labels(text: Column, lowered: Column | None = None) -> Column:
    t = F.lower(text) if lowered is None else lowered
    return labels([(holds(t, words), name) for words, name in KEYWORD_LABELS])


def queue_category(context: Column) -> Column:
    return lookup(context, ISSUE_CATEGORY, context)


def significant_issues(critical: Column, major: Column, risk: Column) -> Column:
    return (critical > 0) | (major >= 2) | risk.isin("high", "critical")


def worth_expanding(n_files: Column, description: Column, aspects: Column) -> Column:
    return ((n_files > 2) | (F.length(description) > 100)) & aspects
