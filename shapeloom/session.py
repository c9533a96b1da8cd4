"""Session settings, the shared work folder and size-checked small sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of a join is broadcast only below both of these.
SMALL_SIDE_ROWS = 200_000
SMALL_SIDE_BYTES = 64 * 1024 * 1024

_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

_local_root: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Set what the jobs rely on.

    Repeated JSON keys resolve to the last one. How files are cut into splits must not change
    while executors come and go, for jobs that read the same files twice. Many folders are listed
    by a few tasks for each core, not by one for each folder.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    cores = spark.sparkContext.defaultParallelism
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
    if spark.conf.get(_LISTING_TASKS, None) is None:
        spark.conf.set(_LISTING_TASKS, str(4 * cores))
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without one; it gets a temporary folder. Checkpoints go when the
    application ends.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="shapeloom-")
            _gone_at_end(spark, _local_root)
        root = _local_root
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
        _gone_at_end(spark, context.getCheckpointDir())
    return root


def _gone_at_end(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table that several branches read to the shared folder.

    The branches then start from the written rows instead of each repeating the scan, and lost
    executors do not lose it.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame) -> DataFrame:
    """Cut the lineage of a lookup side and broadcast it if it is proven small.

    A side over the bound is returned without a hint: Spark then shuffles both sides and
    adaptive execution splits skewed keys.
    """
    df = cut(df)
    texts = [F.octet_length(c.name) for c in df.schema.fields if isinstance(c.dataType, T.StringType)]
    width = F.lit(8 * len(df.columns))
    for size in texts:
        width = width + F.coalesce(size, F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= SMALL_SIDE_ROWS and size <= SMALL_SIDE_BYTES:
        return F.broadcast(df)
    return df


# Rows that a running total takes in one window at most.
WINDOW_ROWS = 100_000


def earlier_totals(
    totals: DataFrame, by: str, order: list[str], columns: dict[str, str], most: int | None = None
) -> DataFrame:
    """Add, for each of ``columns``, what all earlier rows of the same ``by`` add up to.

    One window if there are ``most`` rows at most (counted). Beyond that rows are dealt out in
    order, summed in each task, the tasks' totals carried on in the same way, and added to those
    inside of a task: a tree of sums in which no window holds more rows than a task got.
    """
    most = WINDOW_ROWS if most is None else most
    totals = cut(totals)
    rows = totals.count()
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def sums(window) -> list:
        return [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(name) for c, name in columns.items()]

    if rows <= most:
        return totals.select("*", *sums(before))
    tasks, task = -(-rows // max(2, most // 4)), f"{order[-1]}__task"
    dealt = cut(totals.repartitionByRange(tasks, by, *order).withColumn(task, F.spark_partition_id()))
    inside = Window.partitionBy(by, task).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = dealt.groupBy(by, task).agg(*(F.sum(c).alias(c) for c in columns))
    carried = earlier_totals(groups, by, [task], {c: f"{name}__earlier" for c, name in columns.items()}, most)
    summed = dealt.select("*", *sums(inside)).join(small_side(carried.drop(*columns)), [by, task])
    for name in columns.values():
        summed = summed.withColumn(name, F.col(name) + F.col(f"{name}__earlier")).drop(f"{name}__earlier")
    return summed.drop(task)
