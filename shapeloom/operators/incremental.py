"""Schema inference that goes on where the last run ended.

What inference knows of a collection are counts per path and kind. Counts of two sets of documents
add up, so a collection that grows is never read again from its start: each batch of new documents
is counted by itself, its counts are added to the state under the batch's id, and the schema is
made of the summed counts. A batch that is sent twice, by a run that died or a queue that repeats
itself, counts once.

The state holds one row per batch, dataset and path. ``fold_state`` sums old batches to a numbered
version that names the batches it took in; a reader takes the newest version and the batches it
does not name, so folding may happen at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shapeloom.functions.json_text import strip_bom
from shapeloom.operators.infer import KINDS, path_counts, paths_of_counts
from shapeloom.operators.shred import DEFAULT_LEVELS, parse_documents, shred_documents
from shapeloom.sources import versions

_COUNTS = ["nodes", *(f"n_{kind}" for kind in KINDS)]
_LAYOUT = ", ".join(["dataset string", "path string", *(f"{c} bigint" for c in _COUNTS)])


def count_batch(docs: DataFrame, levels: int = DEFAULT_LEVELS) -> DataFrame:
    """Counts per dataset and path of ``dataset, json``."""
    parsed = parse_documents(docs, strip_bom(F.col("json")))
    return path_counts(shred_documents(parsed, ["dataset"], levels), ["dataset"])


def add_batch(docs: DataFrame, state: str, batch: str, levels: int = DEFAULT_LEVELS) -> bool:
    """Count new documents into the state, once per batch id; False if the id was counted before.

    The documents of a known batch are not read.
    """
    spark = docs.sparkSession
    if batch in _folded(spark, state):
        return False
    return versions.add_batch(count_batch(docs, levels), state, batch)


def _folded(spark: SparkSession, state: str) -> set[str]:
    """Ids of the batches that the newest version has taken in."""
    version = versions.latest_version(spark, state)
    if not version:
        return set()
    rows = spark.read.parquet(f"{versions.version_path(spark, state, version)}/part=batches").select("path")
    return {r.path for r in rows.collect()}


def _parts(spark: SparkSession, state: str) -> tuple[list[str], set[str], dict[str, str]]:
    """Places of all counts to be summed, the folded batch ids, and the batches not yet folded."""
    version = versions.latest_version(spark, state)
    folded = _folded(spark, state)
    fresh = {b: data for b, data in versions.batches(spark, state).items() if b not in folded}
    base = [f"{versions.version_path(spark, state, version)}/part=counts"] if version else []
    return [*base, *fresh.values()], folded, fresh


def _summed(spark: SparkSession, places: list[str]) -> DataFrame:
    rows = spark.read.schema(_LAYOUT).parquet(*places) if places else spark.createDataFrame([], _LAYOUT)
    return rows.groupBy("dataset", "path").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def state_counts(spark: SparkSession, state: str) -> DataFrame:
    """Counts per dataset and path over all batches so far."""
    return _summed(spark, _parts(spark, state)[0])


def infer_incremental(spark: SparkSession, state: str) -> DataFrame:
    """The path table of everything counted so far."""
    return paths_of_counts(state_counts(spark, state), ["dataset"])


def fold_state(spark: SparkSession, state: str) -> int:
    """Sum all batches into a new version; its number. Another folder at work raises ``Conflict``."""
    version = versions.latest_version(spark, state)
    places, folded, fresh = _parts(spark, state)
    if not fresh:
        return version
    counts = _summed(spark, places).withColumn("part", F.lit("counts"))
    ids = spark.createDataFrame([(b,) for b in sorted(folded | set(fresh))], "path string")
    named = ids.select(
        F.lit(None).cast("string").alias("dataset"), "path", *(F.lit(None).cast("bigint").alias(c) for c in _COUNTS), F.lit("batches").alias("part")
    )
    return versions.write_version(counts.unionByName(named).repartition("part", "dataset", "path"), state, version, partition_by="part")


def follow(docs: DataFrame, state: str, checkpoint: str, name: str = "follow", levels: int = DEFAULT_LEVELS) -> StreamingQuery:
    """Count a stream of ``dataset, json`` into the state: what is there now, then stop.

    The checkpoint knows what was read; a micro-batch that is run again after a failure has the
    same number, so it counts once. ``name`` tells the batches of several streams apart.
    """

    def count(batch: DataFrame, number: int) -> None:
        add_batch(batch, state, f"{name}/{number}", levels)

    return docs.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
