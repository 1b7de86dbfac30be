"""What the jobs share: settings read by Spark, a log of what is read and written, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def read_settings(spark: SparkSession, path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """``defaults`` with what the JSON file says. The path is read by Spark, so it may be remote; a name that is not a setting is an error."""
    given = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if path else {}
    return check_settings(given, defaults)


def check_settings(given: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"no such setting: {', '.join(unknown)}; there are {', '.join(defaults)}")
    return {**defaults, **given}


def stored(spark: SparkSession, path: str, schema: str, partitions: str = "") -> DataFrame:
    """A Parquet table that earlier runs wrote; an empty one of the same columns where there is none yet."""
    full = f"{schema}, {partitions}" if partitions else schema
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def keep_settings(spark: SparkSession, path: str, settings: dict[str, Any]) -> None:
    """Writes the settings that the stored output depends on, or compares them with those of the runs before: one output has one meaning."""
    now = json.dumps(settings, sort_keys=True)
    try:
        was = "".join(r[0] for r in spark.read.text(path).collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        was = ""
    if not was:  # none yet, or a run that ended before it had written them
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif was != now:
        raise ValueError(f"{path} is of runs with other settings: {was}, not {now}")


def arguments(description: str, paths: dict[str, str]) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=description)
    for name, what in paths.items():
        p.add_argument(f"--{name}", required=True, help=what)
    p.add_argument("--config", help="JSON file of settings")
    return p


def command_line(run, description: str, paths: dict[str, str], argv: list[str] | None = None) -> int:
    """Creates a session, runs ``run(spark, *paths, config=...)`` and stops the session."""
    a = vars(arguments(description, paths).parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        print(json.dumps(run(spark, *(a[n.replace("-", "_")] for n in paths), config=a["config"])))
    finally:
        spark.stop()
    return 0
