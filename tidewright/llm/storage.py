"""Intermediate tables in the shared folder that the cluster names.

`spark.checkpoint.dir` is read from the session; only where it is unset (tests
on one machine) a temporary folder is taken instead. A step that is written
here survives lost executors, and its lineage ends.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text that reach a Python worker at once.
BATCH_BYTES = "4m"
#: Paths of steps that may be discarded. A step that nobody holds goes from here too, and with it its plan in the driver's JVM.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of this subpackage's jobs: small Arrow batches, and no shuffle files kept after their job."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a folder of this machine, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a step and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.options(**options).mode("overwrite").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete steps that `materialise` returned and that no later plan reads."""
    for df in steps:
        remove(df.sparkSession, _paths.pop(df))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that this run wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Size of the plan's input as the optimiser estimates it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def most_frequent(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows with the greatest counts, `limit` at most: all above a count that is found from a log histogram.

    A sorted limit would send `limit` rows of every partition to the driver; the histogram has under 1,100 rows.
    """
    level = F.floor(F.log2(F.col(column)) * 16)
    least, total = None, 0
    for k, n in df.groupBy(level.alias("k")).count().orderBy(F.desc("k")).collect():
        total += n
        if total > limit:
            break
        least = k
    return df.where(F.lit(False) if least is None else level >= least)
