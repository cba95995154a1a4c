"""Classifier, regular-expression and parsing queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as pred
from .tables import read


def exclusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "[?#].*$", "")
    pages = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return pages.where(pred.included(p)).select("page_id", "path", pred.file_type(p).alias("file_type"), pred.language(p).alias("language"), pred.is_test_file(p).alias("is_test"), pred.is_config_file(p).alias("is_config"))


def _sql_any(col: str, patterns) -> str:
    """RE2 alternation of Java patterns (same syntax for those used here)."""
    return f"regexp_matches({col}, '{'|'.join('(?:' + p + ')' for p in patterns)}')"


EXCLUSION_SQL = rf"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', '') AS path FROM pages),
e AS (SELECT *, lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '^.+(\.[^.]*)$', 1)) AS ext FROM p)
SELECT page_id, path, CASE WHEN ext = '' THEN 'unknown' ELSE ext END AS file_type,
  CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pred.LANGUAGES.items())} ELSE 'Unknown' END AS language,
  {_sql_any("path", pred.TEST_FILE)} AS is_test, {_sql_any("path", pred.CONFIG_FILE)} AS is_config
FROM e WHERE NOT {_sql_any("path", pred.EXCLUDED)}
"""


def ordered_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", pred.business_domain(F.col("source"), F.col("text")).alias("domain"), "lang")
    return docs.groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


CLASSIFIER_SQL = f"""
WITH t AS (SELECT doc_id, lang, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS t FROM documents),
c AS (SELECT doc_id, lang, CASE {" ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for words, name in pred.DOMAINS)} ELSE '{pred.DEFAULT_DOMAIN}' END AS domain FROM t)
SELECT domain, lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM c GROUP BY ALL
"""


def multi_label_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tags = F.concat(F.transform(pred.pattern_labels(F.col("text")), lambda x: F.concat(F.lit("p:"), x)), F.transform(pred.keyword_labels(F.col("text")), lambda x: F.concat(F.lit("k:"), x)))
    return docs.select("lang", F.explode(tags).alias("tag")).groupBy("tag", "lang").agg(F.count(F.lit(1)).alias("n"))


def _tags_sql() -> str:
    rules = [(f"p:{n}", w) for w, n in pred.PATTERN_LABELS] + [(f"k:{n}", w) for w, n in pred.KEYWORD_LABELS]
    parts = [f"SELECT '{n}' AS tag, lang FROM t WHERE " + " OR ".join(f"contains(t, '{x}')" for x in w) for n, w in rules]
    return "WITH t AS (SELECT lang, lower(text) AS t FROM documents) SELECT tag, lang, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


TAG_PATTERNS = {"paragraphs": "<p>", "links": r"<a\s", "open_tags": "<[a-z][^>]*>", "close_tags": "</[a-z][^>]*>", "entities": "&[a-z]+;"}


def regex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    counts = [F.regexp_count("html", F.lit(p)).cast("long").alias(n) for n, p in TAG_PATTERNS.items()]
    return pages.select("page_id", *counts).withColumn("nesting", F.abs(F.col("open_tags") - F.col("close_tags")))


COUNTS_SQL = (
    "WITH c AS (SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}')) AS {n}" for n, p in TAG_PATTERNS.items()) + " FROM pages) SELECT *, abs(open_tags - close_tags) AS nesting FROM c"
)


def line_state_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document as a patch: a line of one sentence (ends in '.', no other) opens a segment,
    lines before the first are dropped, and lines of a segment are numbered unless they hold a comma."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    lines = lines.withColumn("head", F.col("line").rlike(r"^[^.]*\.$"))
    w = W.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("segment", F.sum(F.col("head").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("segment > 0 AND NOT head")
    kept = (~F.contains("line", F.lit(","))).cast("int")
    number = F.coalesce(F.sum(kept).over(W.partitionBy("doc_id", "segment").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    lines = lines.withColumn("number", F.when(kept == 1, number).otherwise(-1))
    return lines.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("lines"), F.max("number").alias("last_number"), F.sum("number").alias("sum_number"))


LINES_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM s),
h AS (SELECT *, regexp_full_match(line, '[^.]*\.') AS head FROM x WHERE line <> ''),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS segment FROM h),
f AS (SELECT *, (NOT contains(line, ','))::INT AS kept FROM g WHERE segment > 0 AND NOT head),
n AS (SELECT *, CASE WHEN kept = 1 THEN coalesce(sum(kept) OVER (PARTITION BY doc_id, segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 ELSE -1 END AS number FROM f)
SELECT doc_id, segment::BIGINT AS segment, count(*) AS lines, max(number)::BIGINT AS last_number, sum(number)::BIGINT AS sum_number FROM n GROUP BY doc_id, segment
"""


def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    valid = F.try_parse_json("props").isNotNull()
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), valid.alias("valid"), (F.size(F.array_except(F.array(F.lit("k")), keys)) == 0).alias("has_keys"))


JSON_SQL = """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid, coalesce(list_contains(json_keys(props), 'k'), false) AS has_keys FROM events
"""

QUERIES = {f.__name__: f for f in (exclusion_filter, ordered_classifier, multi_label_tags, regex_counts, line_state_parse, json_field_extract)}
ORACLES = dict(zip(QUERIES, (EXCLUSION_SQL, CLASSIFIER_SQL, _tags_sql(), COUNTS_SQL, LINES_SQL, JSON_SQL), strict=True))
