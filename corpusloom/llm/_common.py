"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session (a test's)
    gets a temporary folder of its own; a cluster's executors would not see one, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Staged folders that are still there, by application.
_STAGED: dict[str, set[str]] = {}


def staged(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, and a lost executor loses none of it. Shuffle
    files of the write go with its end, as nothing reads them any more.

    The copy is columnar and compressed (unlike a checkpoint's) and its path hangs on the frame as `staged_at`. Copies
    that no result reads are to be given to `discard`; results are read later, so what they read stays until the
    application ends.
    """
    spark = df.sparkSession
    at, own = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", _STAGED.setdefault(spark.sparkContext.applicationId, set())
    if not own:
        atexit.register(_clear, spark)
    own.add(at)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.staged_at = at
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged copies that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.staged_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _STAGED.get(spark.sparkContext.applicationId, set()).discard(at)


def _clear(spark: SparkSession) -> None:
    """What an application has left goes with it."""
    if spark.sparkContext._jsc is not None:
        for at in list(_STAGED.get(spark.sparkContext.applicationId, ())):
            _delete(spark, at)


#: Groups of more than one row in so many are hot; so there are never more hot groups than this.
HOT_GROUPS = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """`rows` joined with what is known of their group by `key`; `size` is the number of the group's rows, among `rows`
    all together `total`. Both are read more than once. Groups that hold more than one row in HOT_GROUPS can be
    HOT_GROUPS at most, so these are broadcast; no group of the rest is large enough to weigh on the task that gets it."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col(size) * HOT_GROUPS > total))
    known = rows.join(hot, key)
    return known.unionByName(rows.join(hot, key, "left_anti").join(groups.filter(F.col(size) * HOT_GROUPS <= total), key, how))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
