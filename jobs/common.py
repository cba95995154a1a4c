"""What the jobs share: configuration, logging, and reads of folders that may not exist yet."""

from __future__ import annotations

import argparse
import json
import logging
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Parquet of an explicit schema, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = read_or_none(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def new_folder(spark: SparkSession, label: str) -> str:
    """A uniquely named folder under ``spark.checkpoint.dir``; a local one only under a local master with that unset."""
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "weftline-jobs")
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def command_line(about: str, job: Callable[..., DataFrame], config: str, paths: list[str], argv: list[str] | None = None) -> None:
    """Run ``job`` on a session of its own with the values of a JSON config, which arguments override."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=config, help="JSON file of the job's parameters (%(default)s)")
    for name in paths:
        parser.add_argument(f"--{name}", help=f"path of the {name}")
    given = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    with open(given.pop("config")) as file:
        values = json.load(file) | given
    lacking = [name for name in paths if not values.get(name)]
    if lacking:
        parser.error("no path for " + ", ".join(lacking))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about).getOrCreate()
    try:
        job(spark, **values)
    finally:
        spark.stop()
