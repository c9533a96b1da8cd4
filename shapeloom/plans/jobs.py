"""Whole jobs: from files to files, out of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapeloom.functions.paths import base_name
from shapeloom.operators import compare, fuse, infer, manifest, profile, sampling, vote
from shapeloom.operators import propose as proposing
from shapeloom.operators.render import master_pieces, render_pieces
from shapeloom.operators.shred import DEFAULT_LEVELS
from shapeloom.session import configure, cut, small_side
from shapeloom.sources import tables, texts, versions


def prepare_documents(
    spark: SparkSession, path: str, out: str, size_target: int = sampling.SIZE_TARGET_BYTES
) -> DataFrame:
    """Raw files, arrays or lines, each sampled down to about the target and split to documents.

    Writes ``dataset, doc_id, json`` to ``out`` and returns ``dataset, file, format, documents``
    of every raw file; a file of a known format without documents is empty or not sound. Files
    of one stem are one dataset, numbered on from file to file.
    """
    configure(spark)
    heads = cut(sampling.detect_file_format(texts.file_heads(spark, path, glob=texts.RAW_FILES)))
    usable = sampling.drop_empty_files(heads)
    plan = sampling.sampling_plan(usable.select("file", "size_bytes"), size_target, "file")
    of_format = {f: small_side(usable.filter(F.col("format") == f).select("file")) for f in ("array", "lines")}

    lines = texts.text_lines(spark, path).join(of_format["lines"], "file", "left_semi")
    kept = texts.valid_lines(sampling.sample_lines(lines, plan, "file"))
    numbered = sampling.dense_index(kept.drop("idx"), ["block"], ["pos"], by="file")
    from_lines = numbered.select(
        "dataset", "file", (F.col("idx") + 1).alias("place"), F.col("text").alias("json")
    )

    elements = texts.scan_json_array(spark, path, wanted=of_format["array"])
    step = F.col("k")
    from_arrays = (
        elements.join(small_side(plan.select("file", "k")), "file")
        .filter((F.col("doc_no") - 1) % step == 0)
        .select("dataset", "file", (F.floor((F.col("doc_no") - 1) / step) + 1).alias("place"), "json")
    )
    # Samples are small by the target, whatever the size of the files.
    documents = cut(from_lines.unionByName(from_arrays))
    counts = cut(documents.groupBy("dataset", "file").agg(F.count(F.lit(1)).alias("documents")))
    earlier = Window.partitionBy("dataset").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("file", F.coalesce(F.sum("documents").over(earlier), F.lit(0)).alias("shift"))
    named = documents.join(small_side(shifts), "file").withColumn("doc_no", F.col("shift") + F.col("place"))
    tables.write_documents(tables.numbered_documents(named), out)
    return heads.join(counts.drop("dataset"), "file", "left").select(
        "dataset", "file", "format", F.coalesce("documents", F.lit(0)).alias("documents")
    )


def _named_documents(spark: SparkSession, documents: str) -> DataFrame:
    """Prepared documents under the file names the manifest knows them by."""
    name = F.concat("doc_id", F.lit(".json"))
    file = F.concat_ws("/", F.lit("processed"), "dataset", F.lit("documents"), name)
    return tables.read_documents(spark, documents).select(file.alias("file"), "json")


def profile_documents(
    spark: SparkSession, documents: str, out: str, levels: int = DEFAULT_LEVELS
) -> None:
    """Write the manifest of prepared documents."""
    configure(spark)
    tables.write_manifest(profile.build_manifest(_named_documents(spark, documents), levels), out)


def propose_for_pending(
    spark: SparkSession,
    manifest_path: str,
    documents: str,
    make_generator: Callable[[], proposing.Generator],
    model: str,
    out: str,
    log: str,
    deadline: float | None = None,
) -> None:
    """Ask a generator about every pending document that is not of the low tier.

    Writes ``dataset, object_type, file, text`` of the answers as Parquet, appends the outcomes
    to the log and flags what succeeded in the manifest. Documents whose answers an earlier run
    stored without coming to flag them are flagged now and not asked about again.
    """
    configure(spark)
    listed = tables.scan_manifest(spark, manifest_path)
    wanted = manifest.route_by_complexity(listed).filter(
        (F.col("tier") != "skip") & manifest.dataset_of(F.col("file")).isNotNull()
    )
    if tables.is_written(spark, out):
        stored = spark.read.parquet(out).select("file").distinct()
        wanted = wanted.join(small_side(stored), "file", "left_anti")
    # Settled before answers are appended to what it is made from.
    wanted = cut(wanted)
    named = _named_documents(spark, documents).join(wanted.select("file"), "file", "left_semi")
    # Answers are costly: they are written once and read from there.
    responses = cut(proposing.propose_schemas(proposing.prompts(named), make_generator, deadline=deadline))
    outcomes = proposing.proposal_outcomes(listed, responses, "processed/schema_documents", model)
    tables.append_run_log(outcomes, log)
    answered = proposing.saved_text(
        proposing.extract_json_block(responses.filter(F.col("response").isNotNull()))
    ).join(wanted.select("file", "object_type"), "file")
    answered.select(
        manifest.dataset_of(F.col("file")).alias("dataset"), "object_type", "file", F.col("saved").alias("text")
    ).write.mode("append").partitionBy("dataset").parquet(out)
    existing = spark.read.parquet(out).select(
        F.col("dataset").cast("string"), "object_type", base_name(F.col("file")).alias("base_name")
    )
    tables.write_manifest(manifest.refresh_manifest(listed, existing).drop("updated"), manifest_path)


def stored_answers(spark: SparkSession, answers: str) -> DataFrame:
    """``file, response, error`` of all runs of ``propose_once``."""
    places = list(versions.batches(spark, answers).values())
    layout = "file string, response string, error string"
    return spark.read.schema(layout).parquet(*places) if places else spark.createDataFrame([], layout)


def stored_log(spark: SparkSession, log: str) -> DataFrame:
    """The log rows of all runs of ``propose_once``."""
    places = list(versions.batches(spark, log).values())
    layout = ", ".join(f"{c} string" for c in tables.LOG_COLUMNS)
    return spark.read.schema(layout).parquet(*places) if places else spark.createDataFrame([], layout)


def propose_once(
    spark: SparkSession,
    manifest_root: str,
    documents: str,
    make_generator: Callable[[], proposing.Generator],
    model: str,
    answers: str,
    log: str,
    deadline: float | None = None,
) -> int:
    """As ``propose_for_pending``, over a manifest in versions; returns the version it leaves.

    The run is pinned to the newest version of the manifest and known by it and the model. Its
    answers, its log rows and the next version are each put in place once, under that name: a run
    that dies, wherever that is, and is started again reads the answers it has, asks about none
    of them a second time, logs every document once and goes on. Of two runs at the same time one
    ends with ``Conflict``. There is a manifest at any moment.
    """
    configure(spark)
    version = versions.latest_version(spark, manifest_root)
    if not version:
        raise FileNotFoundError(f"no version of a manifest below {manifest_root}")
    run = f"{model}/{version}"
    listed = cut(tables.scan_manifest(spark, versions.version_path(spark, manifest_root, version)))
    usable = manifest.dataset_of(F.col("file")).isNotNull()
    if not versions.has_batch(spark, answers, run):
        wanted = manifest.route_by_complexity(listed).filter((F.col("tier") != "skip") & usable)
        named = _named_documents(spark, documents).join(wanted.select("file"), "file", "left_semi")
        asked = proposing.propose_schemas(proposing.prompts(named), make_generator, deadline=deadline)
        versions.add_batch(asked, answers, run)
    own = spark.read.schema("file string, response string, error string").parquet(versions.batches(spark, answers)[run])
    if not versions.has_batch(spark, log, run):
        outcomes = proposing.proposal_outcomes(listed, own, "processed/schema_documents", model)
        versions.add_batch(tables.log_rows(outcomes), log, run)
    succeeded = stored_answers(spark, answers).filter(F.col("response").isNotNull()).select("file").distinct()
    existing = listed.join(succeeded, "file", "left_semi").select(
        manifest.dataset_of(F.col("file")).alias("dataset"), "object_type", base_name(F.col("file")).alias("base_name")
    )
    return versions.write_manifest_version(manifest.refresh_manifest(listed, existing).drop("updated"), manifest_root, version)


def traditional_schemas(
    spark: SparkSession,
    manifest_path: str,
    documents: str,
    out: str,
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """Write a schema per dataset inferred from its approved documents; returns the path table."""
    configure(spark)
    approved = manifest.approved_texts(
        tables.scan_manifest(spark, manifest_path), _named_documents(spark, documents)
    )
    paths = cut(infer.infer_schema(approved, levels=levels))
    tables.write_schemas(render_pieces(paths, ["dataset"]), out)
    return paths


def master_schemas(
    spark: SparkSession,
    proposals: DataFrame,
    out: str,
    mode: str = "reference",
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """Write the voted schema per dataset of ``dataset, file, text``; returns the path table."""
    configure(spark)
    paths = cut(vote.merge_schemas(proposals, mode, levels))
    tables.write_schemas(master_pieces(paths, ["dataset"]), out)
    return paths


def raw_file_schemas(
    spark: SparkSession,
    path: str,
    out: str,
    levels: int = DEFAULT_LEVELS,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Write a schema per raw JSON file; returns ``json_path, outcome, schema_path`` of each file.

    A schema is named by its file's place below ``path``, ``<stem>.schema.json``, whatever other
    files share the stem; files that gave no value have none. Files in ``existing`` (``file``) are
    left out and their schemas stay.
    """
    configure(spark)
    keys = ["dataset", "file"]
    paths, outcomes = infer.file_schemas(spark, path, existing=existing, levels=levels, glob="*.json")
    paths = cut(paths)
    schemas = render_pieces(paths, keys).select(_schema_name(path).alias("schema"), "order", "text")
    tables.write_file_schemas(schemas, out)
    written = F.concat(F.lit(out.rstrip("/") + "/schema="), F.replace(_schema_name(path), F.lit("/"), F.lit("%2F")))
    made = paths.select("file").distinct().withColumn("schema_path", written)
    return outcomes.join(made, "file", "left").select(
        F.col("file").alias("json_path"), "outcome", "schema_path"
    )


def fused_schemas(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """The path table per dataset of all schema files ``<path>/<dataset>/**.json``, fused.

    Writes a schema per dataset to ``out``, if given. Files that are no JSON are left out.
    """
    configure(spark)
    paths = cut(fuse.read_paths(texts.scan_schema_corpus(spark, path), ["dataset"], "text"))
    if out is not None:
        tables.write_schemas(render_pieces(paths, ["dataset"]), out)
    return paths


def schema_file_similarity(spark: SparkSession, left: str, right: str) -> DataFrame:
    """How far two folders of schema files agree, per dataset; files of a dataset are fused."""
    return similarity(fused_schemas(spark, left), fused_schemas(spark, right))


def _schema_name(root: str) -> Column:
    """Path of a file below the root, with the extension of a schema."""
    place = F.regexp_replace("file", r"^\Q" + texts.without_scheme(root) + r"\E/*", "")
    return F.concat(F.regexp_replace(place, r"\.json$", ""), F.lit(".schema.json"))


def similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """How far two path tables agree, per dataset."""
    return compare.schema_similarity(compare.schema_diff(left, right, ["dataset"]), ["dataset"])
