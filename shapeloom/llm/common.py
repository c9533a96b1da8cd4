"""What several operators share: tables, folds, work tables in the shared folder, joins on copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shapeloom.session import SMALL_SIDE_BYTES, SMALL_SIDE_ROWS, fresh_dir

# White space of the contracts: blank and the controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


# A task that writes a work table holds this much of it.
ROW_GROUP_BYTES = 32 * 1024 * 1024


# Folders of work tables by session, oldest first.
_folders: dict[str, list[str]] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows starts from the written rows, so a lost executor costs no earlier work and
    values such as row numbers never change. The folder goes when it is released, or when the
    application ends.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_folder = path
    return out


def work_mark(spark: SparkSession) -> int:
    """A place in the list of work folders: those written later lie behind it."""
    return len(_folders.get(spark.sparkContext.applicationId, []))


def _deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame | None) -> None:
    """Delete the folders of tables of ``stored`` or ``lookup`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "work_folder", None)
        if path is not None:
            _deleted(table.sparkSession, [path])
            own = _folders.get(table.sparkSession.sparkContext.applicationId, [])
            if path in own:
                own[own.index(path)] = ""


def release_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete the work folders written since a mark, but for those of ``kept``."""
    own = _folders.get(spark.sparkContext.applicationId, [])
    keep = {getattr(t, "work_folder", None) for t in kept}
    gone = [k for k in range(mark, len(own)) if own[k] and own[k] not in keep]
    _deleted(spark, [own[k] for k in gone])
    for k in gone:
        own[k] = ""


def lookup(df: DataFrame, label: str) -> DataFrame:
    """A written lookup side; broadcast only below the bounds on rows and bytes.

    Beyond them Spark shuffles both sides and splits skewed keys. Rows and bytes are observed
    while the side is written; a repeated task can only make them larger.
    """
    size = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.coalesce(F.size(field.name), F.lit(0))
        else:
            size = size + 8
    measures = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")]
    seen = Observation()
    df = stored(df.observe(seen, *measures), label)
    found = seen.get or df.agg(*measures).first().asDict()
    if found["rows"] > SMALL_SIDE_ROWS or found["bytes"] > SMALL_SIDE_BYTES // 4:
        return df
    small = F.broadcast(df)
    small.work_folder = df.work_folder
    return small


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows, written, with a number of their own each: doc_id may be null or repeated."""
    rid = free_name(docs, "row_number_")
    return stored(docs.withColumn(rid, F.monotonically_increasing_id()), label), rid


# Bytes of text that a task works on at once.
AT_ONCE = 2_000_000


def portions(texts: pa.StringArray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


# Bytes that a worker gets at once, unless the session says otherwise.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session keeps the default: bounds a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "64m", "67108864", "67108864b"):
        spark.conf.set(name, BATCH_BYTES)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with Arrow's unused memory given back behind each."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
