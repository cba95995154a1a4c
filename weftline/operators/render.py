"""Review documents as text, assembled from rows by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import first_of, lookup

# ---- fixed values: labels of the documents ----
SEVERITY_SIGN = {"critical": "🚨", "major": "⚠️", "minor": "⚡", "suggestion": "💡"}
RECOMMENDATION_SIGN = {"approve": "✅", "request-changes": "🚫", "needs-discussion": "💬"}
RISK_SIGN = {"low": "🟢", "medium": "🟡", "high": "🟠", "critical": "🔴"}
NODE_SIGN = {"atomic-technical": "⚛️", "business-feature": "🏢", "integration-hybrid": "🔗"}


def confidence_sign(c: Column) -> Column:
    return first_of([(c >= 0.9, "🎯"), (c >= 0.7, "👍"), (c >= 0.5, "⚠️")], "❓")


def severity_sign(s: Column) -> Column:
    return lookup(s, SEVERITY_SIGN, "❓")


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def code_context(class_name: Column, function: Column) -> Column:
    """Class.function, either alone, or null."""
    return F.when(class_name.isNotNull() & function.isNotNull(), F.concat_ws(".", class_name, function)).otherwise(F.coalesce(class_name, function))


def issue(i: Column, number: Column) -> Column:
    """One issue (struct severity, category, description, suggested_fix, location) as a section; parts that are null leave no line."""
    at = i["location"]
    where = F.when(at["file_path"].isNotNull(), F.concat(F.lit("File: "), at["file_path"], F.when(at["line_number"].isNotNull(), F.format_string(" (line %d)", at["line_number"])).otherwise(F.lit(""))))
    context = code_context(at["class_name"], at["function_name"])
    return F.concat_ws(
        "\n", F.concat(F.format_string("#### %d. ", number), severity_sign(i["severity"]), F.lit(" "), F.upper(i["severity"]), F.lit(" - "), i["category"]), where,
        F.concat(F.lit("Context: `"), context, F.lit("()`")), i["description"], F.concat(F.lit("```\n"), at["code_snippet"], F.lit("\n```")), F.concat(F.lit("Suggested fix: "), i["suggested_fix"]),
    )


def inline(i: Column, node: Column) -> Column:
    at = i["location"]
    return F.concat_ws("\n", F.concat(severity_sign(i["severity"]), F.lit(" **"), F.upper(i["severity"]), F.lit("** ("), i["category"], F.lit(")")), F.concat(F.lit("Context: `"), code_context(at["class_name"], at["function_name"]), F.lit("()`")), i["description"], F.concat(F.lit("Suggested fix: "), i["suggested_fix"]), F.concat(F.lit("From: "), node))


def node_summary(number: Column) -> Column:
    """Section of one node row: node_name, node_type, risk_level, confidence, issues."""
    n = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    part = lambda s: F.when(n(s) > 0, F.format_string(f"%d {s}", n(s)))
    counts = F.concat_ws(", ", part("critical"), part("major"), part("minor"))
    head = F.concat(F.format_string("#### %d. ", number), lookup(F.col("node_type"), NODE_SIGN, "📁"), F.lit(" "), F.col("node_name"))
    facts = F.concat(F.lit("**Risk:** "), lookup(F.col("risk_level"), RISK_SIGN, "⚪"), F.lit(" "), F.col("risk_level"), F.format_string(" | **Issues:** %d | **Confidence:** ", F.size("issues")), percent(F.col("confidence")))
    return F.concat_ws("\n", head, facts, F.when(counts != "", F.concat(F.lit("*Issues: "), counts, F.lit("*"))))


def node_detail(nodes: DataFrame) -> DataFrame:
    """node_id, comment for each node: its issues numbered, strengths, test recommendations."""
    found = F.transform("issues", lambda i, k: issue(i, k + 1))
    part = lambda title, body: F.when(F.size(body) > 0, F.concat_ws("\n", F.lit(f"### {title}"), F.concat_ws("\n", body)))
    bullet = lambda col, mark: F.transform(col, lambda s: F.concat(F.lit(mark), s))
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("## Detailed Review: "), F.col("node_name")), F.concat(F.lit("**Risk Level:** "), lookup(F.col("risk_level"), RISK_SIGN, "⚪"), F.lit(" "), F.initcap("risk_level")),
        part("Issues Found", found), part("Strengths", bullet(F.col("strengths"), "- ")), part("Test Recommendations", bullet(F.col("test_recommendations"), "- [ ] ")),
    )
    return nodes.select("node_id", text.alias("comment"))


def main_comment(nodes: DataFrame, recommendation: Column, summary: Column) -> DataFrame:
    """One document a review: nodes has review_id, ord, critical, major and the columns of node_summary."""
    rows = F.array_sort(F.collect_list(F.struct("ord", node_summary(F.col("ord") + 1).alias("s"))))
    agg = nodes.groupBy("review_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n\n").alias("nodes"), F.sum("critical").alias("critical"), F.sum("major").alias("major"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), recommendation.alias("r"), summary.alias("summary"))
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("## Code Review Results "), lookup(F.col("r"), RECOMMENDATION_SIGN, "❓")), F.concat(F.lit("**Recommendation:** "), F.col("r")), F.concat(F.lit("**Summary:** "), F.col("summary")),
        F.concat(F.format_string("- **Nodes Reviewed:** %d\n- **Confidence:** ", "n"), percent(F.col("confidence")), F.lit(" "), confidence_sign(F.col("confidence"))),
        F.when(F.col("critical") > 0, F.format_string("- **%d Critical Issue(s)** - Must be addressed before merge", "critical")), F.when(F.col("major") > 0, F.format_string("- **%d Major Issue(s)** - Should be addressed", "major")), F.col("nodes"),
    )
    return agg.select("review_id", text.alias("comment"))


def action_items_comment(items: DataFrame) -> DataFrame:
    """One document a review from ranked items: review_id, rank, severity, node_name, description, suggested_fix."""
    part = F.concat_ws("\n", F.concat(F.format_string("### %d. ", "rank"), severity_sign(F.col("severity")), F.lit(" "), F.upper("severity")), F.concat(F.lit("**Context:** "), F.col("node_name")), F.col("description"), F.concat(F.lit("Suggested fix: "), F.col("suggested_fix")))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("s"))))
    return items.groupBy("review_id").agg(F.concat(F.lit("## Action Items\n\n"), F.array_join(F.transform(rows, lambda r: r["s"]), "\n\n")).alias("comment"))


def tree_text(forest: DataFrame, files: int = 3) -> DataFrame:
    """One indented document of a forest (depth, path, sort_key, name, affected_files); lines are
    joined by the two characters backslash and n, as the output variable asks for."""
    shown = F.concat_ws(", ", F.slice("affected_files", 1, files))
    more = F.when(F.size("affected_files") > files, F.format_string(" (+%d more)", F.size("affected_files") - files)).otherwise(F.lit(""))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("path"), F.lit(". "), F.col("name"), F.when(F.size("affected_files") > 0, F.concat(F.lit(": "), shown, more)).otherwise(F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("sort_key", line.alias("l"))))
    return forest.agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\\n").alias("text"))


def tree_summary(stats: DataFrame) -> DataFrame:
    return stats.select(F.concat(F.format_string("%d themes, depth %d, %d expanded, %d merged, mean confidence ", "n_nodes", "max_depth", "n_expanded", "n_merged"), percent(F.col("mean_confidence"))).alias("text"))
