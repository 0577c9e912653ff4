"""What the jobs share: configuration files, logging, tables that may not exist yet."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """defaults with the values of a JSON file over them; the file may not name others."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"{path}: unknown settings {unknown}")
    return defaults | given


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, without rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(parser, run) -> None:
    """Parse the arguments, run with a session of its own, and stop it."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    arguments = vars(parser.parse_args())
    spark = SparkSession.builder.appName(parser.prog or "job").getOrCreate()
    try:
        run(spark, arguments)
    finally:
        spark.stop()
