"""The jobs as registered queries: each runs twice into one new folder and returns all of its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import call_ledger, text_intake
from jobs.common import new_folder
from weftline.functions import predicates as pred
from weftline.functions import text as texts


def job1_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = new_folder(spark, "text-intake")
    paths = (f"{sf_dir}/documents.parquet", f"{top}/output", f"{top}/checkpoint")
    text_intake.run(spark, *paths)
    return text_intake.run(spark, *paths)


def job2_call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = new_folder(spark, "call-ledger")
    paths = (f"{sf_dir}/events.parquet", f"{top}/output", f"{top}/state")
    call_ledger.run(spark, *paths)
    return call_ledger.run(spark, *paths)


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _labels(column: str, rules) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(column, words)} THEN '{name}' END" for words, name in rules) + ")"


def _matches(column: str, patterns) -> str:
    return f"regexp_matches({column}, '{'|'.join('(?:' + p + ')' for p in patterns)}')"


INTAKE_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, lower(text) AS t, lower(coalesce(source, '')) AS p, lower(coalesce(source, '') || ' ' || text) AS named, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM d),
c AS (SELECT doc_id, lang, source, substr(sha256('document:' || text), 1, 16) AS content_key,
        {_labels("t", pred.PATTERN_LABELS)} AS patterns, {_labels("t", pred.KEYWORD_LABELS)} AS keywords,
        CASE WHEN text = '' THEN 0 ELSE lines END::BIGINT AS n_lines, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
        {_matches("t", texts.SIMPLE_CHANGE)} OR {_has("p", ("test", "spec"))} OR (contains(t, 'import') AND lines < 5) AS simple,
        {_matches("t", texts.COMPLEX_CHANGE)} OR length(t) - length(replace(t, 'file', '')) > 8 OR {_has("t", ("new feature", "business requirement"))} AS complex,
        CASE {" ".join("WHEN " + _has("named", words) + f" THEN '{name}'" for words, name in pred.DOMAINS)} ELSE '{pred.DEFAULT_DOMAIN}' END AS domain FROM t),
s AS (SELECT domain, count(*) AS documents, count(DISTINCT content_key) AS contents, count(*) - count(DISTINCT content_key) AS copies, (count(*) FILTER (complex))::BIGINT AS complex_documents FROM c GROUP BY domain)
SELECT c.*, documents, contents, copies, complex_documents FROM c JOIN s USING (domain)
"""

LEDGER_SQL = """
WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type AS context, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS ms FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT day, context, count(*) AS calls, sum(ms)::BIGINT AS total_ms, max(ms) AS max_ms, arg_max(event_id, {'a': ms, 'b': -event_id}) AS slowest, count(*) FILTER (ms > 5000) AS slow_calls FROM e GROUP BY ALL),
m AS (SELECT *, sum(CASE WHEN context = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY day, user_id ORDER BY ts, event_id) AS island FROM e),
r AS (SELECT day, count(*) FILTER (length >= 3) AS error_streaks, max(length) AS longest_streak FROM (SELECT day, user_id, island, count(*) AS length FROM m WHERE context = 'error' GROUP BY ALL) GROUP BY day),
s AS (SELECT *, CASE WHEN sum(total_ms) OVER (PARTITION BY day) = 0 THEN 'NaN'::DOUBLE ELSE total_ms / sum(total_ms) OVER (PARTITION BY day) END AS share FROM g)
SELECT context, calls, total_ms, total_ms / calls AS mean_ms, max_ms, slowest, slow_calls, round(share, 9) AS share, share > 0.7::DOUBLE AND NOT isnan(share) AS bottleneck,
       coalesce(error_streaks, 0) AS error_streaks, coalesce(longest_streak, 0) AS longest_streak, s.day FROM s LEFT JOIN r ON r.day = s.day
"""

QUERIES = {"job1_text_intake": job1_text_intake, "job2_call_ledger": job2_call_ledger}
ORACLES = {"job1_text_intake": INTAKE_SQL, "job2_call_ledger": LEDGER_SQL}
