"""Sources: name-status listings, staged API pages, patches, saved analyses, recorded decisions.

Network and process calls are outside the engine: their answers are staged as files, and the readers
turn these into tables. Paths are anything that Spark can open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import change_status, included, valid_file_name
from ..operators.relational import merge_files
from . import schemas


def name_status(spark: SparkSession, path: str, mode: str = "faithful") -> DataFrame:
    """ord, filename, status of ``git diff --name-status`` lines. Faithful: a line must be one letter,
    blanks and a path, so renames (R100) drop out; fixed takes their new path."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    strict = lines.where(F.col("value").rlike(r"^[AMDRT]\s+.+$")).select("ord", F.regexp_extract("value", r"^([AMDRT])\s+(.+)$", 2).alias("filename"), F.substring("value", 1, 1).alias("letter"))
    if mode == "fixed":
        moved = lines.where(F.col("value").rlike(r"^R\d+\t")).select("ord", F.element_at(F.split("value", "\t"), -1).alias("filename"), F.lit("R").alias("letter"))
        strict = strict.unionByName(moved)
    return strict.where(included(F.col("filename"))).select("ord", "filename", change_status(F.col("letter")).alias("status"))


def tab_status(spark: SparkSession, path: str) -> DataFrame:
    """ord, filename, status of tab-separated listings (index or worktree): the first path, renames as modified."""
    parts = F.split("value", "\t")
    letter = F.substring(F.get(parts, F.lit(0)), 1, 1)
    status = F.when(letter == "R", "modified").otherwise(change_status(letter))
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(F.size(parts) >= 2)
    return rows.select("ord", F.get(parts, F.lit(1)).alias("filename"), status.alias("status"))


def untracked(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("value <> ''").withColumn("ord", F.monotonically_increasing_id())
    return rows.select("ord", F.col("value").alias("filename"), F.lit("added").alias("status"))


def whole_diff(spark: SparkSession, path: str) -> DataFrame:
    """filename, status, patch, additions, deletions of every file of whole ``git diff`` outputs.

    The text reader takes the heads of files as the separator of its records, so one large diff is cut between
    files and read by as many tasks as its size asks for. The name is that after the change (before it, if the file was
    removed); files that are excluded elsewhere are here too. The patch starts at the first hunk; binary files have none."""
    raw = spark.read.option("lineSep", "\ndiff --git ").text(path).select(F.concat(F.lit("diff --git "), F.regexp_replace("value", r"^diff --git ", "")).alias("d"))
    head, side = F.substring_index("d", "\n@@ ", 1), lambda p: F.regexp_extract("d", p, 1)
    old, new, named = side(r"(?m)^--- (?:a/)?(.*?)\t?$"), side(r"(?m)^\+\+\+ (?:b/)?(.*?)\t?$"), side(r"^diff --git .* b/(.*)")
    moved = side(r"(?m)^rename to (.*)$")
    name = F.when(~new.isin("", "/dev/null"), new).when(~old.isin("", "/dev/null"), old).when(moved != "", moved).otherwise(named)
    status = F.when(head.rlike(r"(?m)^new file mode"), "added").when(head.rlike(r"(?m)^deleted file mode"), "removed").when(head.rlike(r"(?m)^rename to"), "renamed").otherwise("modified")
    patch = F.when(F.contains("d", F.lit("\n@@ ")), F.regexp_replace(F.substring("d", F.length(head) + 2, 1 << 30), r"\n$", "")).otherwise(F.lit(""))
    rows = raw.where(F.col("d").rlike(r"^diff --git a/")).select(name.alias("filename"), status.alias("status"), patch.alias("patch"))
    count = lambda sign: F.regexp_count("patch", F.lit(rf"(?m)^{sign}")).cast("int")
    return rows.withColumn("additions", count(r"\+")).withColumn("deletions", count("-"))


def with_patches(listing: DataFrame, patches: DataFrame) -> DataFrame:
    """Listing with its patches (filename, patch); a file without one has an empty patch."""
    return listing.join(patches.select("filename", "patch"), "filename", "left").withColumn("patch", F.coalesce("patch", F.lit("")))


def uncommitted(staged: DataFrame, unstaged: DataFrame, new: DataFrame) -> DataFrame:
    """Union of the three listings (ord, filename, status, patch) in that order; a file that occurs
    again keeps its first row and gets all patches."""
    cols = ["filename", "status", "patch"]
    parts = [df.select(F.struct(F.lit(i).alias("part"), "ord").alias("ord"), *cols) for i, df in enumerate((staged, unstaged, new))]
    return merge_files(parts[0].unionByName(parts[1]).unionByName(parts[2]), "filename", "ord", "patch").where(included(F.col("filename")))


def listing_pages(spark: SparkSession, path: str, per_page: int = 100, pages: int = 10) -> DataFrame:
    """Staged pages of a change listing, one JSON array a file named by page number: read up to the
    first short page and at most ``pages`` pages."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int").alias("page"), F.from_json("value", schemas.PAGE).alias("rows"))
    short = raw.where(F.size("rows") < per_page).agg(F.min("page")).first()[0]
    last = min(x for x in (short, pages) if x is not None)
    rows = raw.where(F.col("page") <= last).select("page", F.posexplode("rows").alias("pos", "r"))
    return rows.select((F.col("page") * per_page + F.col("pos")).alias("ord"), "r.*").where(included(F.col("filename")))


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Staged pull requests (JSON lines, as the listing has them): ord, number, title, body, state, branches and commits; a missing body is empty."""
    raw = spark.read.schema(schemas.PULL).json(path).withColumn("ord", F.monotonically_increasing_id())
    return raw.where("number is not null").select(
        "ord", "number", "title", F.coalesce("body", F.lit("")).alias("body"), "state", F.col("base.ref").alias("base_branch"), F.col("head.ref").alias("head_branch"), F.col("base.sha").alias("base_sha"), F.col("head.sha").alias("head_sha")
    )


def review_contexts(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """What each run reviews: run, number, title, body, base_branch, head_branch, base_sha, head_sha; all null but the run where nothing fits.

    runs: run, event, number, base_sha, head_sha, branch. A run with a number and both commits is a manual one: it takes the listed request with
    its own commits, or defaults. A run of a pull_request event takes its request; any other the first open request of its branch."""
    columns = ["number", "title", "body", "base_branch", "head_branch", "base_sha", "head_sha"]
    whole = F.struct(*columns)
    by_number = requests.groupBy(F.col("number").alias("_n")).agg(F.max_by(whole, "ord").alias("own"))
    by_branch = requests.where("state = 'open'").groupBy(F.col("head_branch").alias("_b")).agg(F.min_by(whole, "ord").alias("found"))
    rows = runs.join(by_number, F.col("number") == F.col("_n"), "left").join(by_branch, F.col("branch") == F.col("_b"), "left")
    manual = F.col("number").isNotNull() & (F.coalesce("base_sha", F.lit("")) != "") & (F.coalesce("head_sha", F.lit("")) != "")
    title = F.coalesce("own.title", F.concat(F.lit("PR #"), F.col("number").cast("string")))
    given = F.struct(
        F.col("number"), title.alias("title"), F.coalesce("own.body", F.lit("")).alias("body"), F.coalesce("own.base_branch", F.lit("main")).alias("base_branch"),
        F.coalesce("own.head_branch", F.lit("feature-branch")).alias("head_branch"), "base_sha", "head_sha",
    )
    chosen = F.when(manual, given).when((F.col("event") == "pull_request") & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("found"))
    return rows.withColumn("_c", chosen).select("run", *[F.col(f"_c.{c}").alias(c) for c in columns])


def target_branches(runs: DataFrame, branches: DataFrame, candidates: Sequence[str] = ("main", "master", "develop")) -> DataFrame:
    """run and target: of the upstream's remote (run, upstream such as origin/topic), the first candidate that
    ``branches`` (run, branch) lists; null without one, or for an upstream without a remote."""
    remote = F.when(F.contains("upstream", F.lit("/")), F.substring_index("upstream", "/", 1))
    asked = runs.select("run", F.posexplode(F.transform(F.array(*[F.lit(c) for c in candidates]), lambda c: F.concat_ws("/", remote, c))).alias("rank", "branch"), remote.alias("remote"))
    found = asked.where("remote is not null").join(branches.select("run", "branch").distinct(), ["run", "branch"]).groupBy("run").agg(F.min_by("branch", "rank").alias("target"))
    return runs.select("run").join(found, "run", "left")


def first_nonempty(frames: Sequence[DataFrame]) -> DataFrame:
    """The first source that has rows, else the last."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]


def chunks(files: DataFrame) -> DataFrame:
    """One chunk a file, numbered from 0 in the order of ``ord`` over range-sorted partitions."""
    from ..operators.ordered import running

    ranked = running(files, F.lit(1), [F.col("ord")], F.floor(F.col("ord") / 10_000), name="_n")
    return ranked.select(F.concat(F.lit("chunk-"), (F.col("_n") - 1).cast("string")).alias("id"), F.col("patch").alias("content"), "filename")


def saved_analyses(spark: SparkSession, path: str) -> DataFrame:
    """Saved documents (one JSON a file) with their file name; unreadable ones have null fields."""
    docs = spark.read.schema(schemas.SAVED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return docs.withColumn("file", F.regexp_extract(F.input_file_name(), r"[^/]*$", 0)).where(valid_file_name(F.col("file")))


def latest_themes(saved: DataFrame) -> DataFrame:
    """Themes of the greatest analysis-*.json by name; raises if it has none."""
    own = saved.where(F.col("file").rlike(r"^analysis-.*\.json$"))
    last = own.agg(F.max("file")).first()[0]
    themes = own.where(F.col("file") == last).select("file", F.posexplode("rawAnalysis.themes").alias("ord", "t")).select("file", "ord", "t.*")
    if last is None or themes.isEmpty():
        raise ValueError("no saved analysis with themes")
    return themes


def summaries(saved: DataFrame, k: int = 20) -> DataFrame:
    """Metadata of the newest ``k`` files that could be read (a top-k report)."""
    return saved.where("metadata IS NOT NULL").select("file", "metadata.*").orderBy(F.desc("file")).limit(k)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AI_DECISIONS).json(path)


def decided(rows: DataFrame, answers: DataFrame, context: str, key: Column, schema: str, required: Sequence[str], fallback: Column) -> DataFrame:
    """Rows with ``decision``: the last recorded answer of ``context`` for the row's key if it parses and
    has the required keys, else the fallback (a struct of the same schema)."""
    from ..functions.jsonx import extract_json, has_keys

    own = answers.where(F.col("context") == context).groupBy("key").agg(F.max_by("response", "attempt").alias("response"))
    json = extract_json(F.col("response"))
    parsed = F.when(has_keys(json, list(required)), F.from_json(json, schema))
    found = own.select(F.col("key").alias("_key"), parsed.alias("_answer"))
    return rows.withColumn("_key", key).join(found, "_key", "left").withColumn("decision", F.coalesce("_answer", fallback)).drop("_key", "_answer")
