"""Manifests, run logs, documents and schemas as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeloom.operators.profile import MANIFEST_COLUMNS
from shapeloom.session import cut

LOG_COLUMNS = ["timestamp", "original_file", "model", "status", "message"]
PAIR_COLUMNS = ["json_path", "schema_path"]
# Fixed value: a log message is cut to this many characters.
MESSAGE_LIMIT = 2000


def _texts(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_options() -> dict[str, object]:
    # Quotes inside a value are doubled and blanks kept, unlike in Spark's own default.
    return {
        "header": True,
        "quote": '"',
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }


def scan_manifest(
    spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """A manifest CSV with a header, all columns as text; an empty field is an empty text."""
    reader = spark.read.options(**csv_options()).schema(_texts(columns or MANIFEST_COLUMNS))
    return reader.option("multiLine", multi_line).csv(path).fillna("")


def typed_manifest(manifest: DataFrame) -> DataFrame:
    numbers = ["keys", "depth", "arrays", "array_len", "size_bytes"]
    return manifest.select(
        *[F.col(c).try_cast("long").alias(c) if c in numbers else c for c in manifest.columns]
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Replace the manifest at ``path``.

    The rows are written beside it, so it may be written from its own old content, and a failed
    job leaves the old one. Complete, they take its place by two renames: the old one steps aside,
    and comes back if the new one cannot take its place. For a moment between them there is none,
    and on stores that copy to rename the moment lasts as long as the copy.
    """
    spark = manifest.sparkSession
    staged, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    manifest.write.mode("overwrite").options(**csv_options()).csv(staged)
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = path_class(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path_class(old)):
        fs.delete(path_class(old), True)
    if fs.exists(target):
        fs.rename(target, path_class(old))
    if not fs.rename(path_class(staged), target):
        if fs.exists(path_class(old)):
            fs.rename(path_class(old), target)
        raise OSError(f"could not put {staged} in place of {path}")
    if fs.exists(path_class(old)):
        fs.delete(path_class(old), True)


def log_rows(outcomes: DataFrame) -> DataFrame:
    """``original_file, model, status, message`` as log rows of this moment."""
    message = F.substring(F.replace("message", F.lit("\n"), F.lit(" ")), 1, MESSAGE_LIMIT)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return outcomes.select(
        now.alias("timestamp"),
        "original_file",
        "model",
        "status",
        F.coalesce(message, F.lit("")).alias("message"),
    )


def append_run_log(outcomes: DataFrame, path: str) -> None:
    log_rows(outcomes).write.mode("append").options(**csv_options()).csv(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows; a message may hold carriage returns."""
    return scan_manifest(spark, path, LOG_COLUMNS, multi_line=True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has completed its output at ``path``."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def write_documents(docs: DataFrame, path: str) -> None:
    """``dataset, doc_id, json`` partitioned by dataset; a record per document, not a file."""
    docs.select("dataset", "doc_id", "json").write.mode("overwrite").partitionBy("dataset").parquet(
        path
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    layout = "doc_id string, json string, dataset string"
    return spark.read.schema(layout).parquet(path).select("dataset", "doc_id", "json")


def numbered_documents(docs: DataFrame) -> DataFrame:
    """``doc_no`` to the name a document goes by."""
    return docs.withColumn("doc_id", F.concat(F.lit("document_"), F.col("doc_no").cast("string")))


# Bytes of schema text that one task writes.
PART_BYTES = 64 * 1024 * 1024


def _in_parts(pieces: DataFrame, by: str, part_bytes: int) -> DataFrame:
    pieces = cut(pieces.select(by, "order", "text"))
    size = pieces.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    return pieces.repartitionByRange(parts, by, "order").sortWithinPartitions(by, "order").select(by, "text")


def write_schemas(pieces: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """``dataset, order, text`` of ``render_pieces``: a folder per dataset.

    Pieces are dealt out by ranges of their order, as many as their measured size asks for. The
    parts of a folder, by name, are the schema's text, each piece on a line of its own; a schema
    of usual size is one file. No schema is ever put together in one place.
    """
    _in_parts(pieces, "dataset", part_bytes).write.mode("overwrite").partitionBy("dataset").text(path)


def write_file_schemas(pieces: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """``schema, order, text``: a folder per schema, as ``write_schemas``; schemas written before
    stay unless written anew."""
    parts = _in_parts(pieces, "schema", part_bytes)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema").text(path)


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, schema_json`` of ``write_schemas``: for schemas that fit a cell."""
    layout = "value string, dataset string"
    read = spark.read.schema(layout).text(path, wholetext=True)
    named = read.select("dataset", F.col("_metadata.file_name").alias("part"), F.replace("value", F.lit("\n"), F.lit("")).alias("text"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    return named.groupBy("dataset").agg(F.array_join(parts, "").alias("schema_json"))
