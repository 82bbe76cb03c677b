"""What the jobs share: settings, the log, and the session of a command line."""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(spark: SparkSession, job_file: str, path: str | None = None) -> dict:
    """The job's own config file, with what another one at `path` (read by Spark, so it may be remote) says instead.
    A name that the own file does not know is an error."""
    known = json.loads(Path(job_file).with_suffix(".json").read_text())
    if path is None:
        return known
    said = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if strange := sorted(set(said) - set(known)):
        raise ValueError(f"{path}: unknown settings {', '.join(strange)}")
    return {**known, **said}


def command_line_session(name: str) -> SparkSession:
    """Master and resources are spark-submit's, or the environment's."""
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
