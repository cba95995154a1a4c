"""Text limits, complexity classes, recorded-decision defaults and domain phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import any_match, clamp, first_of, holds, js_or, led_match, lookup

# ---- fixed values ----
SIMPLE_CHANGE = (
    r"console\.(log|warn|error)", r"import.*logger", r"logger\.(info|warn|error)", r"\.warn\(", r"console\.warn.*replaced.*logger", r"add.*import", r"replace.*console",
    r"fix.*typo", r"update.*comment", r"rename.*variable", r"add.*semicolon",
)
SIMPLE_CHANGE_WIDE = (*SIMPLE_CHANGE, r"structured logging", r"logger.*service")
COMPLEX_CHANGE = (r"authentication", r"authorization", r"payment", r"checkout", r"registration", r"onboarding", r"workflow", r"business.*logic", r"user.*flow", r"feature.*flag")
COMPLEX_CHANGE_WIDE = (*COMPLEX_CHANGE, r"user.*journey", r"business.*process")
SIMPLE_TECHNICAL = (r"console\.warn", r"logger", r"import", r"logging", r"replace.*with", r"add.*import", r"fix.*typo", r"update.*comment")
SIMPLE_TECHNICAL_WIDE = (*SIMPLE_TECHNICAL, r"structured logging", r"replaced.*console.*warn")
BUSINESS_FEATURE = (r"authentication", r"authorization", r"user.*flow", r"business.*logic", r"workflow", r"onboarding", r"payment", r"checkout")
BUSINESS_FEATURE_WIDE = (*BUSINESS_FEATURE, r"user.*journey", r"business.*process")
CONTEXT_SIMPLE = (r"replaced console\.warn with", r"add.*import", r"logger.*service", r"structured logging", r"fix.*typo", r"update.*comment")
CONTEXT_SIMPLE_WIDE = (*CONTEXT_SIMPLE, r"single.*file.*change", r"minor.*refactor")
CONTEXT_COMPLEX = (r"multiple.*components", r"business.*feature", r"user.*workflow", r"new.*functionality", r"feature.*implementation", r"system.*integration")
ACTIONS = ("add", "update", "fix", "remove", "modify", "create", "implement")
ASPECT_TYPES = ("test", "config", "component", "service", "util", "model")
DOMAIN_VERBS = ("fix", "handle", "improve", "debug", "resolve", "add", "remove", "enable", "enhance", "streamline", "simplify", "optimize", "modernize", "clean")
LANGUAGE_CONTEXT = {
    "ts": "TypeScript", "tsx": "TypeScript React", "js": "JavaScript", "jsx": "JavaScript React", "py": "Python", "java": "Java", "cpp": "C++", "cs": "C#", "go": "Go", "rs": "Rust",
    "rb": "Ruby", "php": "PHP", "json": "JSON Configuration", "yaml": "YAML Configuration", "yml": "YAML Configuration", "sql": "SQL Database", "md": "Markdown Documentation",
}
PATTERN_EXAMPLES = {
    "single-file-technical-change": ("Replace console.warn with logger.warn calls", "Add LoggerServices import for centralized logging", "Update error handling to use structured logging"),
    "multiple-themes-or-business-feature": ("Enable Secure User Authentication", "Streamline Customer Onboarding Process", "Improve Error Resolution Workflow"),
    "simple-context-pattern": ("Replace console.warn with structured logging", "Add import statement for logger service", "Update logging call to use centralized system"),
    "moderate-complexity-default": ("Implement Structured Logging for Error Diagnosis", "Add OAuth2 Integration for User Security", "Enhance API Validation for Data Integrity"),
}
#: path class: domain, confidence
FALLBACK_DOMAIN = {"test": ("Development Workflow Optimization", 0.4), "auth": ("User Account Management", 0.5), "log": ("Development Workflow Optimization", 0.5), "config": ("Development Workflow Optimization", 0.4), "ui": ("User Experience Enhancement", 0.4), "": ("User Experience Enhancement", 0.3)}
SEMANTIC_DEFAULTS = {"change_type": ("refactoring", ("new-feature", "bug-fix", "refactoring", "breaking-change", "enhancement")), "impact": ("internal", ("breaking", "enhancement", "fix", "internal"))}


def word_limit(text: Column, n: int) -> Column:
    """First ``n`` words; a text within the limit keeps its white space."""
    words = F.split(F.trim(text), r"\s+")
    return F.when(F.size(words) <= n, text).otherwise(F.concat_ws(" ", F.slice(words, 1, n)))


def truncated(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def multiple_aspects(name: Column, description: Column) -> Column:
    t = F.lower(F.concat_ws(" ", name, description))
    found = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))
    return (found(ACTIONS) > 1) | holds(t, (" and ", ", ")) | (found(ASPECT_TYPES) > 1)


def change_complexity(changes: Column, path: Column, context: Column | None = None, lowered: Column | None = None) -> Column:
    """Struct (simple, complex, confidence): two independent verdicts. With ``context`` the wider pattern sets apply; ``lowered``: the
    changes in lower case, where they are at hand."""
    t, p = F.lower(F.coalesce(changes, F.lit(""))) if lowered is None else lowered, F.lower(path)
    simple, hard = (SIMPLE_CHANGE, COMPLEX_CHANGE) if context is None else (SIMPLE_CHANGE_WIDE, COMPLEX_CHANGE_WIDE)
    c = None if context is None else F.lower(F.coalesce(context, F.lit("")))
    hit = lambda patterns: led_match(t, patterns) if c is None else led_match(t, patterns) | led_match(c, patterns)
    is_simple = hit(simple) | holds(p, ("test", "spec")) | (F.contains(t, F.lit("import")) & (F.size(F.split(t, "\n")) < 5))
    is_complex = hit(hard) | (F.size(F.split(t, "file")) > 3) | holds(t, ("new feature", "business requirement"))
    return F.struct(is_simple.alias("simple"), is_complex.alias("complex"), F.when(is_simple | is_complex, 0.9).otherwise(0.6).alias("confidence"))


def naming_strategy(complexity: Column, changes: Column, path: Column) -> Column:
    """Struct (complexity, approach, max_words): simple beats complex beats moderate."""
    found = change_complexity(changes, path)
    row = lambda c, a, n: F.struct(F.lit(c).alias("complexity"), F.lit(a).alias("approach"), F.lit(n).alias("max_words"))
    c = F.coalesce(complexity, F.lit("moderate"))
    return first_of([((c == "simple") | found["simple"], row("simple", "technical-specific", 12)), ((c == "complex") | found["complex"], row("complex", "business-focused", 8))], row("moderate", "hybrid", 10))


def _profile(complexity: str, confidence: float, pattern: str) -> Column:
    return F.struct(F.lit(complexity).alias("complexity"), F.lit(confidence).alias("confidence"), F.lit(pattern).alias("pattern"))


def complexity_profile(n_themes: Column, n_files: Column, name: Column, description: Column, changes: Column, context: Column) -> Column:
    """Struct (complexity, confidence, pattern) by ordered rules. A missing name counts as the text ``undefined`` in the business test only."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    simple = any_match(F.lower(F.concat_ws(" ", blank(name), blank(description), blank(changes), blank(context))), SIMPLE_TECHNICAL_WIDE)
    undefined = lambda c: F.coalesce(c, F.lit("undefined"))
    business = any_match(F.lower(F.concat_ws(" ", undefined(name), undefined(description), blank(changes))), BUSINESS_FEATURE_WIDE)
    rules = [
        ((n_themes == 1) & (n_files <= 2) & simple, _profile("simple", 0.9, "single-file-technical-change")),
        ((n_themes >= 3) | business, _profile("complex", 0.8, "multiple-themes-or-business-feature")),
        (any_match(F.lower(blank(context)), CONTEXT_SIMPLE_WIDE), _profile("simple", 0.95, "simple-context-pattern")),
    ]
    return first_of(rules, _profile("moderate", 0.7, "moderate-complexity-default"))


def themes_complexity(n_themes: Column, n_files: Column, first_text: Column, all_text: Column, context: Column | None = None) -> Column:
    """The same over a group of themes; a simple pattern in the context overrides."""
    rules = [
        ((n_themes == 1) & (n_files <= 2) & any_match(F.lower(first_text), SIMPLE_TECHNICAL), _profile("simple", 0.9, "single-file-technical-change")),
        ((n_themes >= 3) | any_match(F.lower(all_text), BUSINESS_FEATURE), _profile("complex", 0.8, "multiple-themes-or-business-feature")),
    ]
    if context is not None:
        rules.insert(0, (any_match(F.lower(context), CONTEXT_SIMPLE), _profile("simple", 0.95, "simple-context-pattern")))
    return first_of(rules, _profile("moderate", 0.7, "moderate-complexity-default"))


def context_verdict(context: Column) -> Column:
    t = F.lower(context)
    return F.struct(any_match(t, CONTEXT_SIMPLE_WIDE).alias("simple"), any_match(t, CONTEXT_COMPLEX).alias("complex"))


def pattern_examples(patterns: Column) -> Column:
    table = F.create_map(*[x for k, v in PATTERN_EXAMPLES.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    none = F.array().cast("array<string>")
    found = F.flatten(F.transform(patterns, lambda p: F.coalesce(F.try_element_at(table, p), none)))
    return F.when(F.size(found) > 0, found).otherwise(F.try_element_at(table, F.lit("moderate-complexity-default")))


def fallback_domain(path: Column) -> Column:
    """Struct (domain, confidence) from the path alone: test, auth, log, config, UI, else generic."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    row = lambda k: F.struct(F.lit(FALLBACK_DOMAIN[k][0]).alias("domain"), F.lit(FALLBACK_DOMAIN[k][1]).alias("confidence"))
    return first_of(
        [
            (holds(path, ("test", "spec")), row("test")), (holds(path, ("auth", "login")), row("auth")), (holds(path, ("log", "debug")), row("log")),
            (holds(path, ("config",)) | name.endswith(".json"), row("config")), (holds(path, ("component", "ui")), row("ui")),
        ],
        row(""),
    )


def fallback_analysis(path: Column, diff: Column) -> Column:
    """Struct (change_type, impact, confidence): test, config, deletions only, additions only, mixed."""
    p, d = F.lower(path), F.lower(diff)
    plus, minus = F.contains(d, F.lit("+")), F.contains(d, F.lit("-"))
    row = lambda c, i, x: F.struct(F.lit(c).alias("change_type"), F.lit(i).alias("impact"), F.lit(x).alias("confidence"))
    return first_of(
        [
            (holds(p, ("test", "spec")), row("refactoring", "internal", 0.4)), (holds(p, ("config",)) | p.endswith(".json"), row("refactoring", "internal", 0.4)),
            (minus & ~plus, row("refactoring", "internal", 0.3)), (plus & ~minus, row("new-feature", "enhancement", 0.3)),
        ],
        row("refactoring", "internal", 0.2),
    )


def fallback_file_context(path: Column) -> Column:
    """Struct (context_type, purpose, role, user_facing, significance) from the path."""
    ext = F.lower(F.element_at(F.split(F.regexp_extract(path, r"[^/]*$", 0), r"\."), -1))
    test, config, ui = holds(path, ("test", "spec")), holds(path, ("config",)) | ext.isin("json", "yaml", "yml"), holds(path, ("component", "ui"))
    pick = lambda a, b, c: first_of([(test, a), (config, b)], c)
    return F.struct(
        pick("test", "config", "function").alias("context_type"), pick("Test coverage", "Configuration", "System component").alias("purpose"),
        pick("Testing infrastructure", "System configuration", "Application logic").alias("role"), ui.alias("user_facing"), F.when(config, "high").otherwise("medium").alias("significance"),
    )


def validated(value: Column, kind: str) -> Column:
    """The value if it is one of its domain, else the domain's default."""
    default, allowed = SEMANTIC_DEFAULTS[kind]
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def confidence_of(value: Column, default: float = 0.5) -> Column:
    return clamp(F.coalesce(value.cast("double"), F.lit(default)), 0.0, 1.0)


def language_context(extension: Column) -> Column:
    return lookup(extension, LANGUAGE_CONTEXT, "Unknown")


def domain_phrase(response: Column) -> Column:
    """First run of two to five words, in any clause, that begins with a verb of the list, has at most
    30 characters and none of 'the ', 'this ', 'that '; title-cased. Null if there is none."""
    clauses = F.filter(F.transform(F.split(F.lower(response), r"[.,:;!?\n]"), lambda c: F.trim(c)), lambda c: c != "")

    def runs(clause: Column) -> Column:
        words = F.split(clause, r"\s+")
        n = F.size(words)
        starts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        lengths = lambda i: F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(5), n - i + 1)))
        return F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda k: F.concat_ws(" ", F.slice(words, i, k)))))

    verb = "^(?:" + "|".join(DOMAIN_VERBS) + ")"
    good = F.filter(F.flatten(F.transform(clauses, runs)), lambda s: s.rlike(verb) & (F.length(s) <= 30) & ~holds(s, ("the ", "this ", "that ")))
    return F.initcap(F.get(good, F.lit(0)))


def domain_from_response(response: Column, valid) -> Column:
    """First line without quotes if ``valid`` accepts it, else a phrase of the whole, else the default."""
    line = F.regexp_replace(F.trim(F.get(F.split(F.trim(response), "\n"), F.lit(0))), "^[\"']|[\"']$", "")
    return F.coalesce(F.when(valid(line), line), domain_phrase(response), F.lit("General Changes"))


def retryable(message: Column) -> Column:
    """Whether an error may pass by itself (ordered; unknown errors may)."""
    m = F.lower(message)
    return first_of(
        [
            (holds(m, ("network", "connection", "timeout", "econnreset", "enotfound")), True), (holds(m, ("rate limit", "too many requests", "429")), True),
            (holds(m, ("500", "502", "503", "504")), True), (holds(m, ("json", "parse", "syntax")), False),
            (holds(m, ("raw mode is not supported", "israwmodesupported", "configuration error", "ci environment")), False),
            (holds(m, ("auth", "unauthorized", "forbidden", "401", "403")), False),
        ],
        True,
    )


def default_text(value: Column, default: str) -> Column:
    return js_or(value, default)
