"""Text intake: every document that is new or changed is classified once, and the domains are summed up.

The source is a folder (or file) of Parquet with doc_id, text, lang and source, to which files are added.
A file stream takes the files its checkpoint does not know, in batches of ``files_per_batch``, and
ends when there are none. Of a batch

* each row becomes a catalogue row: content key, business domain, pattern and keyword labels, lines,
  words, and whether the change is simple or complex. No text is shuffled or kept;
* rows whose document and content the catalogue has from earlier batches are left out, so a file
  delivered twice adds nothing;
* the rest is written to ``output/catalogue/batch=<n>/domain=<d>``. The partitions of a batch are replaced, so
  a batch that is repeated after a failure leaves the same rows.

Afterwards ``output/digest/domain=<d>`` is written anew from the catalogue, unless it already covers the
last batch: documents, distinct contents, copies and complex documents of each domain. A document's
current row is that of its last batch, the greatest content key of several.

A null text is empty; a row without doc_id is a document of its own for each content. Other columns are ignored.

    python -m jobs.text_intake --config jobs/text_intake.json --source ... --output ... --checkpoint ...
"""

from __future__ import annotations

import logging
import os
import sys

if __package__ in (None, ""):  # started as a file
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, read_or_empty, read_or_none
from weftline.functions import jsonx
from weftline.functions import predicates as pred
from weftline.functions import text as texts
from weftline.operators import relational

LOG = logging.getLogger("text_intake")
WORD = r"[^\x20\x09-\x0D]+"
CATALOGUE = (
    "document string, doc_id long, lang string, source string, content_key string, patterns string, keywords string, "
    "n_lines long, n_words long, simple boolean, complex boolean, batch long, domain string"
)
DIGEST = "documents long, contents long, copies long, complex_documents long, through long, domain string"


def catalogued(docs: DataFrame) -> DataFrame:
    """The catalogue's columns, without the batch, of every document. A text is put in lower case once for all of its labels."""
    docs = docs.select("doc_id", "lang", F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("*", F.lower("text").alias("lowered"), pred.named_text(F.col("source"), F.col("text")).alias("named"))
    text, source, lowered = F.col("text"), F.col("source"), F.col("lowered")
    change = texts.change_complexity(text, source, lowered=lowered)
    key = jsonx.content_key(F.lit("document"), text)
    lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), key)).alias("document"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"), source.alias("source"), key.alias("content_key"),
        F.concat_ws(",", pred.pattern_labels(text, lowered)).alias("patterns"), F.concat_ws(",", pred.keyword_labels(text, lowered)).alias("keywords"),
        lines.cast("long").alias("n_lines"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.coalesce(change["simple"], F.lit(False)).alias("simple"), F.coalesce(change["complex"], F.lit(False)).alias("complex"),
        pred.business_domain(source, text, F.col("named")).alias("domain"),
    )


def take(batch: DataFrame, number: int, output: str) -> None:
    """Write one batch's new rows to its own partitions of the catalogue."""
    spark = batch.sparkSession
    rows = catalogued(batch).dropDuplicates(["document", "content_key"])
    known = read_or_none(spark, f"{output}/catalogue", CATALOGUE)
    if known is not None:
        rows = relational.uncovered(rows, known.where(F.col("batch") < number).select("document", "content_key"), ["document", "content_key"])
    rows = rows.withColumn("batch", F.lit(number).cast("long"))
    # dealt by domain so that a partition has few files; adaptive execution splits the large domains
    rows.hint("rebalance", "domain").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "domain").parquet(f"{output}/catalogue")
    written = spark.read.schema(CATALOGUE).parquet(f"{output}/catalogue").where(F.col("batch") == number).count()
    LOG.info("batch %d: wrote %d rows to %s/catalogue", number, written, output)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The last row of every document."""
    return relational.last_wins(read_or_empty(spark, f"{output}/catalogue", CATALOGUE), ["document"], ["batch", "content_key"])


def summed(rows: DataFrame) -> DataFrame:
    """Documents, distinct contents, copies and complex documents of each domain.

    Contents are summed first, so that neither a common content nor a large domain meets in one task."""
    contents = rows.groupBy("domain", "content_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("complex").alias("c"), F.max("batch").alias("last"))
    return contents.groupBy("domain").agg(
        F.sum("n").alias("documents"), F.count(F.lit(1)).alias("contents"), (F.sum("n") - F.count(F.lit(1))).alias("copies"), F.sum("c").alias("complex_documents"), F.max("last").alias("through")
    )


def digest(spark: SparkSession, output: str) -> None:
    """Bring the digest up to the catalogue's last batch."""
    catalogue = read_or_none(spark, f"{output}/catalogue", CATALOGUE)
    if catalogue is None:
        return
    last = catalogue.agg(F.max("batch")).first()[0]
    known = read_or_none(spark, f"{output}/digest", DIGEST)
    if last is None or (known is not None and known.agg(F.min("through")).first()[0] == last):
        LOG.info("the digest is up to date")
        return
    found = summed(current(spark, output)).withColumn("through", F.lit(last).cast("long"))
    # a domain has one row; one that lost all its documents goes with the old folder
    found.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("domain").parquet(f"{output}/digest")
    LOG.info("wrote the digest up to batch %d to %s/digest", last, output)


def result(spark: SparkSession, output: str) -> DataFrame:
    """Every document's current row beside its domain's digest."""
    sums = read_or_empty(spark, f"{output}/digest", DIGEST).drop("through")
    return current(spark, output).drop("batch", "document").join(relational.small(sums), "domain", "left")


def pattern(path: str) -> str:
    """The path as a pattern of itself: file streams take a folder or a pattern, and a pattern may match one file."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Take what is new in ``source`` and return the whole output."""
    schema = spark.read.parquet(source).select("doc_id", "text", "lang", "source").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern(source))
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("read %d new rows of %s", sum(p["numInputRows"] for p in query.recentProgress), source)
    digest(spark, output)
    return result(spark, output)


if __name__ == "__main__":
    command_line("text intake", run, os.path.join(os.path.dirname(os.path.abspath(__file__)), "text_intake.json"), ["source", "output", "checkpoint"])
