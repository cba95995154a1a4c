"""Theme queries: the incremental fold of analyses into themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import themes
from ..operators.cluster import cut
from .tables import read


def theme_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as analyses in two batches: a part is a theme of its name, described by name, brand and type;
    an even size suggests the widget of the same kind as parent, the others the red thing of the same sort."""
    p = read(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    parent = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 2 == 0, F.upper(F.concat(word[0], F.lit(" widget")))).otherwise(F.concat(F.lit("Red "), word[1]))
    rows = p.select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"), (F.col("p_size") / 50).alias("confidence"),
        parent.alias("parent"), F.col("p_partkey").cast("string").alias("filename"),
    )
    half = rows.agg(F.expr("(min(seq) + max(seq)) div 2").alias("m")).first()["m"] or 0
    state = spark.createDataFrame([], themes.THEMES)
    out = None
    for batch in (rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half)):
        where = cut(themes.placed(state, batch))
        state = cut(themes.grown(state, batch, where))
        found = where.join(batch.select("seq", "filename"), "seq")
        out = found if out is None else out.unionByName(found)
    whole = out.groupBy("theme").agg(F.count(F.lit(1)).alias("members"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    return out.select("seq", "action", "theme").join(whole, "theme")


FOLD_SQL = """
WITH RECURSIVE r AS (SELECT p_partkey AS seq, p_name AS n, string_split(p_name, ' ') AS w, p_size, p_size / 50 AS c, string_split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' ') AS d FROM part),
a AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, lower(n) AS n, c, d, lower(CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN w[1] || ' widget' ELSE 'red ' || w[2] END) AS p FROM r),
f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::BIGINT AS theme, []::VARCHAR[] AS names, []::VARCHAR[][] AS descs, []::BIGINT[] AS ids
  UNION ALL
  SELECT i, seq, CASE WHEN joins THEN 'merge' ELSE 'create' END, CASE WHEN joins THEN ids[spot] ELSE seq END,
         CASE WHEN joins OR list_contains(names, n) THEN names ELSE list_append(names, n) END,
         CASE WHEN joins OR list_contains(names, n) THEN descs ELSE list_append(descs, d) END,
         CASE WHEN joins OR list_contains(names, n) THEN ids ELSE list_append(ids, seq) END
  FROM (SELECT s.*, coalesce(spot > 0 AND c > 0.7::DOUBLE AND len(list_filter(d, lambda x: list_contains(descs[spot], x))) / greatest(len(d), len(descs[spot])) > 0.6::DOUBLE, false) AS joins
        FROM (SELECT a.i, a.seq, a.n, a.c, a.d, f.names, f.descs, f.ids, coalesce(list_position(f.names, a.p), 0) AS spot FROM f JOIN a ON a.i = f.i + 1) s)),
t AS (SELECT theme, count(*) AS members, min(seq) AS first, max(seq) AS last FROM f WHERE i > 0 GROUP BY theme)
SELECT seq, action, theme, members, first, last FROM f JOIN t USING (theme) WHERE i > 0
"""

QUERIES = {"theme_fold": theme_fold}
ORACLES = {"theme_fold": FOLD_SQL}
