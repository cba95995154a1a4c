"""Whole pipelines composed of the operators: semantic diff, theme consolidation, review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as pred
from ..functions import similarity as sim
from ..functions.jsonx import pair_key
from ..operators import cluster, diff, metrics, relational, review, tree
from ..sources.readers import decided

MERGE_AT = 0.7
ANALYSIS = "struct<functionsChanged: array<string>, classesChanged: array<string>, importsChanged: array<string>, fileType: string, codeComplexity: string, businessDomain: string>"
PAIR = "struct<shouldMerge: boolean, confidence: double, reasoning: string>"


def semantic_diff(files: DataFrame, mode: str = "faithful") -> dict[str, DataFrame]:
    """Line table and everything derived from it for (filename, patch)."""
    d = diff.lines(files)
    imports, exports = diff.import_changes(d), diff.export_changes(d)
    edges = diff.relationships(files, imports, mode)
    return {
        "lines": d, "hunks": diff.hunks(files), "imports": imports, "exports": exports, "relationships": edges, "dependencies": diff.dependencies(imports), "symbols": diff.symbols(d),
        "components": diff.shared_components(exports, edges), "patterns": diff.business_patterns(files), "complexity": diff.total_complexity(files, d, imports, exports),
    }


def code_changes(files: DataFrame, decisions: DataFrame, key) -> DataFrame:
    """Changed files with their recorded analysis, else the minimal row (no symbols, type from the path)."""
    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    fallback = F.struct(none.alias("functionsChanged"), none.alias("classesChanged"), none.alias("importsChanged"), pred.file_type(F.col("filename")).alias("fileType"), nothing.alias("codeComplexity"), nothing.alias("businessDomain"))
    rows = decided(files, decisions, "code-analysis", key, ANALYSIS, ["functionsChanged", "classesChanged", "importsChanged", "fileType"], fallback)
    d = F.col("decision")
    return rows.select(
        "ord", F.col("filename").alias("file"), F.col("patch").alias("diff_hunk"), F.when(F.col("status") == "removed", "deleted").otherwise(F.col("status")).alias("change_type"),
        d["functionsChanged"].alias("functions_changed"), d["classesChanged"].alias("classes_changed"), d["importsChanged"].alias("imports_changed"), d["fileType"].alias("file_type"),
        pred.is_test_file(F.col("filename")).alias("is_test"), pred.is_config_file(F.col("filename")).alias("is_config"), none.alias("architectural_patterns"), d["businessDomain"].alias("business_domain"),
        d["codeComplexity"].alias("code_complexity"), nothing.alias("semantic_description"),
    )


def smart_context(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return metrics.file_metrics(changes), metrics.change_patterns(changes)


def candidate_pairs(themes: DataFrame) -> DataFrame:
    """Pairs of themes (a before b by ord) that share a word of their names or a file. All other pairs
    have neither file overlap nor name similarity, which scores 0."""
    keys = F.concat(F.transform(sim.tokens(F.col("name")), lambda w: F.concat(F.lit("w:"), w)), F.transform("affected_files", lambda f: F.concat(F.lit("f:"), f)))
    entry = themes.select("ord", F.explode(F.array_distinct(keys)).alias("k"))
    return entry.select("k", F.col("ord").alias("a")).join(entry.select("k", F.col("ord").alias("b")), "k").where("a < b").select("a", "b").distinct()


def pair_scores(themes: DataFrame, decisions: DataFrame) -> DataFrame:
    """a, b, score: recorded decision or the fallback (merge at 0.3 if the names are nearly equal)."""
    cols = ["ord", "id", "name", "affected_files"]
    left = themes.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    right = themes.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    both = candidate_pairs(themes).withColumnsRenamed({"a": "a_ord", "b": "b_ord"}).join(left, "a_ord").join(right, "b_ord")
    name = sim.word_similarity(F.col("a_name"), F.col("b_name"))
    fallback = F.struct((name > 0.9).alias("shouldMerge"), F.lit(0.3).alias("confidence"), F.lit(None).cast("string").alias("reasoning"))
    found = decided(both, decisions, "similarity-analysis", pair_key(F.col("a_id"), F.col("b_id")), PAIR, ["shouldMerge", "confidence"], fallback)
    far = (sim.jaccard(F.col("a_affected_files"), F.col("b_affected_files")) == 0) & (name < 0.1)
    score = F.when(far, F.lit(0.0)).otherwise(sim.pair_score(F.col("decision.shouldMerge"), F.col("decision.confidence")))
    return found.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), score.alias("score"))


def merged(themes: DataFrame, leaders: DataFrame) -> DataFrame:
    """One consolidated theme a leader: united files, functions and classes in order, mean confidence, joined texts."""
    rows = themes.join(leaders.select(F.col("item").alias("ord"), "leader"), "ord")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda r: r[c])
    union = lambda c: F.array_distinct(F.flatten(ordered(c)))
    agg = rows.groupBy("leader").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("name", "ord").alias("name"), ordered("id").alias("source_themes"), union("affected_files").alias("affected_files"), F.flatten(ordered("code_snippets")).alias("code_snippets"),
        union("functions").alias("functions"), union("classes").alias("classes"), F.avg("confidence").alias("confidence"), F.array_join(ordered("description"), ". Additionally, ").alias("description"), F.array_join(ordered("context"), "\n").alias("context"),
    )
    return agg.withColumn("method", F.when(F.col("n") > 1, "merge").otherwise("single")).withColumnRenamed("leader", "ord")


def consolidate(themes: DataFrame, decisions: DataFrame, at: float = MERGE_AT) -> DataFrame:
    """Pairs → greedy leader clusters → merged themes → a parent for every domain of two or more.

    Nodes with id, parent_id, level, name, confidence, affected_files."""
    edges = pair_scores(themes, decisions).where(F.col("score") >= at).select("a", "b")
    rows = merged(themes, cluster.leaders(themes, edges, "ord"))
    rows = rows.withColumn("domain", pred.business_domain(F.col("name"), F.col("description"))).withColumn("id", F.concat(F.lit("theme-"), F.col("ord").cast("string")))
    groups = tree.parents_for_groups(rows, "domain", "ord")
    children = rows.join(groups.select("domain", "parent_id", "level"), "domain")
    files = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "affected_files"))), lambda r: r["affected_files"])))
    parents = children.where("parent_id IS NOT NULL").groupBy("parent_id", "domain").agg(F.avg("confidence").alias("confidence"), files.alias("affected_files"), F.min("ord").alias("ord"))
    cols = ["id", "parent_id", "level", "ord", "name", "confidence", "affected_files", "method"]
    tops = parents.select(F.col("parent_id").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), "ord", F.col("domain").alias("name"), "confidence", "affected_files", F.lit("hierarchy").alias("method"))
    return children.select(*cols).unionByName(tops.select(*cols))


def review_result(nodes: DataFrame, issues: DataFrame, mode: str = "faithful") -> dict[str, DataFrame]:
    """Node reviews with counts, the recommendation and the ranked action items.

    nodes: review_id, node_id, ord, risk_level, confidence; issues: node_id, ord, severity. An empty review
    has a NaN mean (faithful) or none (fixed) and is approved."""
    counts = issues.groupBy("node_id").agg(*review.severity_counts(F.col("severity")))
    full = nodes.join(counts, "node_id", "left").fillna(0, ["critical", "major", "minor", "suggestion"])
    summary = full.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"), F.sum("critical").alias("critical"), F.sum("major").alias("major"), F.sum("minor").alias("minor"), F.avg("confidence").alias("mean_confidence"))
    if mode == "faithful":
        summary = summary.withColumn("mean_confidence", F.coalesce("mean_confidence", F.lit(float("nan"))))
    place = nodes.select("node_id", "review_id", F.col("ord").alias("node_ord"))
    ranked = issues.join(place, "node_id").withColumn("place", F.row_number().over(W.partitionBy("review_id").orderBy("node_ord", "ord")))
    return {"nodes": full, "recommendation": review.recommend(full, ["review_id"]), "summary": summary, "action_items": review.action_items(ranked, "review_id", "place")}


def upsert_themes(base: DataFrame, placed: DataFrame) -> DataFrame:
    """Insert or update of themes by name without regard to case (the last placement wins)."""
    named = lambda df: relational.last_wins(df.withColumn("key", F.lower("name")), ["key"], ["ord"])
    return relational.upsert(named(base), named(placed), ["key"])
