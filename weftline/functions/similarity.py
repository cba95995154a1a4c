"""Token and set similarity as Column expressions.

Tokens come from a split without a trim, so leading and trailing blanks give an empty token and ''
gives ['']. ``mode`` is "faithful" (default) or "fixed" where the two differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import first_of
from .predicates import extension, keyword_labels, pattern_labels

# fixed values: words without weight in semantic keys
STOP_WORDS = tuple("the and or but in on at to for of with by is are was were be been have has had do does did will would could should may might this that these those a an".split())


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def word_similarity(a: Column, b: Column, mode: str = "faithful") -> Column:
    """Words of ``a`` found in ``b`` over the distinct union. Faithful counts repeated words of ``a``,
    so it is asymmetric and can exceed 1; fixed is Jaccard."""
    x, y = tokens(a), tokens(b)
    found = F.size(F.filter(x, lambda w: F.array_contains(y, w))) if mode == "faithful" else F.size(F.array_intersect(x, y))
    return found / F.size(F.array_union(x, y))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays' distinct elements; ``empty`` for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared distinct words over the smaller distinct set; NaN if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.size(F.array_intersect(x, y)), least))


def description_score(a: Column, b: Column) -> Column:
    """Common words over the longer text's words, split on one space."""
    x, y = F.split(F.lower(a), " "), F.split(F.lower(b), " ")
    return F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.greatest(F.size(x), F.size(y))


def shares_names(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b))) >= 2


def directory(path: Column) -> Column:
    """Everything before the last slash; '' for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def shares_directory(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.transform(a, directory), F.transform(b, directory))


def disjoint_extensions(a: Column, b: Column) -> Column:
    return ~F.coalesce(F.arrays_overlap(F.transform(a, extension), F.transform(b, extension)), F.lit(False))


def pattern_similarity(a: Column, b: Column) -> Column:
    return jaccard(pattern_labels(a), pattern_labels(b))


def business_similarity(a: Column, b: Column) -> Column:
    return jaccard(keyword_labels(a), keyword_labels(b))


def quick_check(name: Column, overlap: Column, different_types: Column) -> Column:
    """Struct (decided, score): certain cases before any decision is asked for."""
    verdict = lambda s: F.struct(F.lit(True).alias("decided"), F.lit(s).alias("score"))
    return first_of(
        [(name >= 0.95, verdict(0.92)), ((overlap == 0) & different_types, verdict(0.15)), ((name < 0.1) & (overlap == 0), verdict(0.18))],
        F.struct(F.lit(False).alias("decided"), F.lit(None).cast("double").alias("score")),
    )


def pair_score(should_merge: Column, confidence: Column) -> Column:
    """Confidence of a merge, or three tenths of its complement."""
    return F.when(should_merge, confidence).otherwise((1 - confidence) * 0.3)


def semantic_tokens(text: Column) -> Column:
    """Lower-cased ASCII words of over two characters that are no stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def semantic_set(text: Column) -> Column:
    """Distinct semantic tokens, sorted."""
    words = F.array_except(F.split(F.lower(text), r"\W+"), F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.sort_array(F.filter(words, lambda w: F.length(w) > 2))


def file_tokens(path: Column) -> Column:
    """Base name: its first and its last dot part."""
    parts = F.split(F.regexp_extract(path, r"[^/]*$", 0), r"\.")
    return F.array(F.element_at(parts, 1), F.element_at(parts, -1))


def semantic_key(*texts: Column, files: Column | None = None) -> Column:
    """Sorted distinct tokens joined by a pipe."""
    every = [semantic_tokens(F.coalesce(t, F.lit(""))) for t in texts]
    if files is not None:
        every.append(F.flatten(F.transform(files, file_tokens)))
    return F.concat_ws("|", F.array_sort(F.array_distinct(F.filter(F.concat(*every), lambda w: F.length(w) > 2))))


def key_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two pipe-joined keys; an empty key is the one token ''."""
    return jaccard(F.split(a, r"\|"), F.split(b, r"\|"))
