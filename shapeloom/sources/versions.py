"""Tables in numbered versions, and work that counts once however often it is repeated.

Data is written under a name of its own and only counts once a small file names it. That file is
put in place by one create-if-absent, so of two writers of the same version, or of the same batch,
one wins and the other learns of it. Nothing that readers may hold is ever overwritten: a reader
is pinned to the version it found, and a writer that dies leaves data no one refers to.

    <root>/data/<unique>/...       rows, as written
    <root>/versions/<number>       names the data of a version
    <root>/batches/<hash of id>    names the data of a batch

What comes to the driver is the names of versions or batches, never rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from shapeloom.sources.tables import csv_options


class Conflict(RuntimeError):
    """Another writer was first."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Put a small file in place, complete, unless there is one; whether this call did."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, conf = _path(spark, path), spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return False
    staged = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(staged, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    # Unlike the file system's own rename, the context's refuses to replace a file.
    keep = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    keep[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(staged, target, keep)
        return True
    except Exception:
        fs.delete(staged, False)
        if fs.exists(target):
            return False
        raise


def _read(spark: SparkSession, path) -> dict:
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _entries(spark: SparkSession, folder: str) -> list:
    """The files put in a folder, by name; those still being staged are left out."""
    place = _path(spark, folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    found = [s.getPath() for s in fs.listStatus(place)]
    return sorted((p for p in found if not p.getName().endswith((".tmp", ".crc"))), key=lambda p: p.getName())


def _new_data(root: str) -> str:
    return f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"


# --- versions -----------------------------------------------------------------------------


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the newest version; 0 if there is none."""
    found = _entries(spark, f"{root.rstrip('/')}/versions")
    return int(found[-1].getName()) if found else 0


def version_path(spark: SparkSession, root: str, version: int) -> str:
    """Where the rows of a version lie."""
    return _read(spark, _path(spark, f"{root.rstrip('/')}/versions/{version:012d}"))["data"]


def write_version(
    df: DataFrame, root: str, based_on: int, format: str = "parquet", partition_by: str | None = None, **options: object
) -> int:
    """Write ``df`` as the version after ``based_on``; raises ``Conflict`` if there is one already.

    It may be made from the version it is based on: nothing is overwritten.
    """
    spark, data = df.sparkSession, _new_data(root)
    writer = df.write.format(format).options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).save(data)
    version = based_on + 1
    if not put_if_absent(spark, f"{root.rstrip('/')}/versions/{version:012d}", json.dumps({"data": data})):
        place = _path(spark, data)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        raise Conflict(f"version {version} of {root} was written by someone else")
    return version


def write_manifest_version(manifest: DataFrame, root: str, based_on: int) -> int:
    return write_version(manifest, root, based_on, "csv", **csv_options())


# --- batches ------------------------------------------------------------------------------


def _batch_file(root: str, batch: str) -> str:
    return f"{root.rstrip('/')}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"


def has_batch(spark: SparkSession, root: str, batch: str) -> bool:
    place = _path(spark, _batch_file(root, batch))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def add_batch(df: DataFrame, root: str, batch: str, format: str = "parquet", **options: object) -> bool:
    """Add the rows under a batch id, once: False, and nothing is done, if the id is there already."""
    spark = df.sparkSession
    if has_batch(spark, root, batch):
        return False
    data = _new_data(root)
    df.write.format(format).options(**options).save(data)
    if put_if_absent(spark, _batch_file(root, batch), json.dumps({"batch": batch, "data": data})):
        return True
    place = _path(spark, data)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return False


def batches(spark: SparkSession, root: str) -> dict[str, str]:
    """Batch id to the place of its rows."""
    found = (_read(spark, p) for p in _entries(spark, f"{root.rstrip('/')}/batches"))
    return {entry["batch"]: entry["data"] for entry in found}
