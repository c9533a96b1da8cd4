"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.functions.paths import is_member, parent_name
from shapeloom.operators import compare, fuse, incremental, infer, profile, propose, repair, sampling, vote
from shapeloom.operators import manifest as manifests
from shapeloom.operators.render import render_master, render_pieces, render_schema
from shapeloom.operators.shred import parse_documents, shred_documents
from shapeloom.plans import corpora
from shapeloom.session import configure, cut, fresh_dir
from shapeloom.sources import tables, texts

Query = Callable[[SparkSession, str], DataFrame]

SUBSET_BYTES = 10_000
SAMPLE_BYTES = 10_000

_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    _QUERIES[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _types() -> Column:
    return F.array_join("types", "|").alias("types")


def _block() -> Column:
    return F.expr(f"doc_id div {corpora.ORDINAL_BLOCK}").alias("block")


def _nodes(docs: DataFrame, keys: list[str]) -> DataFrame:
    return shred_documents(parse_documents(docs), keys)


# --- scans, sources, sinks ------------------------------------------------------------------


@_query
def scan_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = corpora.write_lines(spark, sf_dir)
    return texts.scan_json_lines(spark, path, "directory", reject="dataset").select("dataset", "json")


@_query
def scan_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = corpora.write_arrays(spark, sf_dir)
    return texts.scan_json_array(spark, path, "directory").select("dataset", "doc_no", "json")


@_query
def detect_file_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = corpora.write_arrays(spark, sf_dir)
    heads = texts.file_heads(spark, path, "directory")
    return sampling.detect_file_format(heads).select("dataset", "format")


@_query
def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "manifest")
    tables.write_manifest(corpora.manifest(spark, sf_dir), path)
    return tables.scan_manifest(spark, path)


@_query
def scan_schema_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = corpora.write_supplier_files(spark, sf_dir, corpora.SUPPLIER_SCHEMA_SQL)
    files = texts.scan_schema_corpus(spark, path, glob="*.txt")
    return files.select(
        "dataset", parent_name(F.col("file")).alias("folder"), F.trim(F.rtrim("text")).alias("text")
    ).withColumn("text", F.regexp_replace("text", r"\n$", ""))


@_query
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = corpora.write_supplier_files(spark, sf_dir, corpora.SUPPLIER_DOC_SQL)
    files = texts.scan_documents(spark, path, glob="*.txt")
    return files.select("dataset", F.regexp_replace("json", r"\n$", "").alias("json"))


@_query
def write_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "documents")
    docs = tables.numbered_documents(
        corpora.events_props(spark, sf_dir).withColumnRenamed("doc_id", "doc_no")
    )
    tables.write_documents(docs, path)
    return tables.read_documents(spark, path)


@_query
def write_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "schemas")
    nodes = _nodes(corpora.events_props(spark, sf_dir, spread=True), ["dataset"])
    paths = infer.infer_paths(nodes, ["dataset"])
    tables.write_schemas(render_pieces(paths, ["dataset"]), path)
    return tables.read_schemas(spark, path)


@_query
def write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest is rewritten in place with refreshed flags."""
    path = fresh_dir(spark, "manifest")
    tables.write_manifest(corpora.manifest(spark, sf_dir), path)
    refreshed = manifests.refresh_manifest(
        tables.scan_manifest(spark, path), corpora.generated_files(spark, sf_dir)
    )
    tables.write_manifest(refreshed.drop("updated"), path)
    return tables.scan_manifest(spark, path).select("file", "schema_generated")


@_query
def append_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "log")
    rows = corpora.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("processed/"), "role", F.lit("/c/"), "conv_id", F.lit("_"), "turn").alias("original_file"),
        F.lit("m").alias("model"),
        F.when(F.col("turn") % 2 == 0, "success").otherwise("failed").alias("status"),
        F.col("text").alias("message"),
    )
    for status in ("success", "failed"):
        tables.append_run_log(rows.filter(F.col("status") == status), path)
    return tables.read_run_log(spark, path).drop("timestamp")


# --- document preparation -------------------------------------------------------------------


@_query
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sampling.collection_sizes(corpora.uneven_props(spark, sf_dir))
    return sampling.sampling_plan(sizes, SAMPLE_BYTES)


@_query
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.uneven_props(spark, sf_dir)
    plan = sampling.sampling_plan(sampling.collection_sizes(docs), SAMPLE_BYTES)
    sample = sampling.systematic_sample(docs.withColumn("block", _block()), plan, ["block"], ["doc_id"])
    return sample.select("dataset", "doc_id", "idx", "json")


@_query
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = corpora.table(spark, sf_dir, "events").selectExpr(
        "event_type as dataset",
        "event_id as source_id",
        """case when event_id % 9 = 0 then props
            else concat('[', props, ',', event_id, ',"x"]') end as json""",
    )
    split = sampling.split_documents(arrays, ["dataset", "source_id"])
    return split.select(
        "dataset", "source_id", F.col("doc_no").cast("long"), "doc_id", F.to_json("v").alias("json")
    )


@_query
def drop_empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = corpora.write_arrays(spark, sf_dir)
    heads = cut(texts.file_heads(spark, path, "directory"))
    kept = sampling.drop_empty_files(heads).select("dataset", F.lit(True).alias("kept"))
    left_out = sampling.detect_file_format(heads).join(kept, "dataset", "left_anti")
    return left_out.groupBy("format").agg(F.count(F.lit(1)).alias("files"))


@_query
def assemble_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.orders_nested(spark, sf_dir)


@_query
def size_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.events_props(spark, sf_dir).withColumn("block", _block())
    return sampling.size_subsets(docs, SUBSET_BYTES, ["block"], ["doc_id"]).select(
        "dataset", "doc_id", "subset"
    )


# --- complexity -----------------------------------------------------------------------------


@_query
def shred_documents_(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(corpora.mixed(spark, sf_dir), ["dataset", "doc_id"])
    return nodes.select("dataset", "doc_id", "path", F.col("depth").cast("long"), "kind")


_QUERIES["shred_documents"] = _QUERIES.pop("shred_documents_")


def _profile(docs: DataFrame) -> DataFrame:
    profiled = profile.document_complexity(docs, ["dataset", "doc_id"])
    return profiled.withColumn("depth", F.col("depth").cast("long"))


@_query
def document_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(corpora.orders_nested(spark, sf_dir))


@_query
def classify_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.complexity_counts(_profile(corpora.mixed(spark, sf_dir)))


@_query
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = profile.build_manifest(corpora.manifest_documents(spark, sf_dir))
    return manifest.withColumn("depth", F.col("depth").cast("long"))


# --- manifest -------------------------------------------------------------------------------


@_query
def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = manifests.pending_documents(corpora.manifest(spark, sf_dir))
    return pending.select("file", F.coalesce("schema_generated", F.lit("-")).alias("flag"))


@_query
def approved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.approved_documents(corpora.manifest(spark, sf_dir)).select("dataset", "file")


@_query
def refresh_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    refreshed = manifests.refresh_manifest(
        corpora.manifest(spark, sf_dir), corpora.generated_files(spark, sf_dir)
    )
    return refreshed.select(
        "file", F.coalesce("schema_generated", F.lit("-")).alias("flag"), "updated"
    )


@_query
def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.refresh_report(
        manifests.refresh_manifest(
            corpora.manifest(spark, sf_dir), corpora.generated_files(spark, sf_dir)
        )
    )


@_query
def schema_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.schema_pairs(
        corpora.raw_file_names(spark, sf_dir), corpora.schema_file_names(spark, sf_dir)
    )


@_query
def unprocessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.unprocessed_files(
        corpora.raw_file_names(spark, sf_dir), corpora.schema_file_names(spark, sf_dir)
    )


@_query
def route_by_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.route_by_complexity(corpora.manifest(spark, sf_dir)).select("file", "tier")


# --- inference ------------------------------------------------------------------------------


@_query
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = manifests.approved_texts(
        corpora.manifest(spark, sf_dir), corpora.manifest_documents(spark, sf_dir)
    )
    return infer.infer_schema(approved).select(
        "dataset", "path", "nodes", _types(), "required"
    )


@_query
def infer_path_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(corpora.orders_nested(spark, sf_dir), ["dataset"])
    return infer.infer_path_types(nodes, ["dataset"]).select("dataset", "path", "nodes", _types())


@_query
def infer_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.infer_required(_nodes(corpora.docs_sparse(spark, sf_dir), ["dataset"]), ["dataset"])


@_query
def infer_array_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.mixed(spark, sf_dir).unionByName(corpora.vectors(spark, sf_dir))
    items = infer.infer_array_items(_nodes(docs, ["dataset"]), ["dataset"])
    return items.withColumn("item_types", F.array_join("item_types", "|"))


@_query
def infer_file_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = corpora.write_arrays(spark, sf_dir)
    paths = infer.infer_file_schemas(spark, path, "directory")
    return paths.select("dataset", "path", "nodes", _types(), "required")


@_query
def infer_document_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["dataset", "doc_id"]
    docs = corpora.mixed(spark, sf_dir)
    paths = infer.infer_document_paths(_nodes(docs, keys), keys, infer.document_tasks(docs))
    return paths.select(*keys, "path", "nodes", _types(), "required")


@_query
def render_schema_(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.docs_nullable(spark, sf_dir)
    return render_schema(infer.infer_paths(_nodes(docs, ["dataset"]), ["dataset"]), ["dataset"])


_QUERIES["render_schema"] = _QUERIES.pop("render_schema_")


@_query
def fuse_inferred_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of the subsets of a collection, as text, read back and fused to the whole's."""
    docs = corpora.mixed(spark, sf_dir).withColumn("block", _block())
    subsets = sampling.size_subsets(docs, SUBSET_BYTES, ["block"], ["doc_id"])
    keys = ["dataset", "subset"]
    schemas = render_schema(infer.infer_paths(_nodes(subsets, keys), keys), keys)
    return fuse.read_paths(schemas, ["dataset"]).select("dataset", "path", _types(), "required")


@_query
def infer_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole collection in four batches, one of them sent twice, folded on the way."""
    state = fresh_dir(spark, "inference-state")
    docs = corpora.events_props(spark, sf_dir)
    for number in (0, 1, 1, 2, 3):
        batch = docs.filter(F.pmod("doc_id", F.lit(4)) == number)
        incremental.add_batch(batch, state, f"events/{number}")
        if number == 2:
            incremental.fold_state(spark, state)
    return incremental.infer_incremental(spark, state).select("dataset", "path", "nodes", _types(), "required")


@_query
def render_pieces_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema per document collection as numbered pieces, through files in many parts."""
    paths = infer.infer_paths(_nodes(corpora.docs_nullable(spark, sf_dir), ["dataset"]), ["dataset"])
    path = fresh_dir(spark, "schema-parts")
    tables.write_schemas(render_pieces(paths, ["dataset"]), path, part_bytes=200)
    return tables.read_schemas(spark, path)


_QUERIES["render_pieces"] = _QUERIES.pop("render_pieces_")


# --- proposals ------------------------------------------------------------------------------


@_query
def propose_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal for every document by the generator that needs no model."""
    proposed = propose.propose_offline(corpora.manifest_documents(spark, sf_dir), ["file"])
    return proposed.select("file", "response")


@_query
def extract_json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = corpora.proposals(spark, sf_dir).withColumnRenamed("text", "response")
    return propose.extract_json_block(responses).select("dataset", "file", "valid", "schema_text")


@_query
def proposal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = corpora.table(spark, sf_dir, "events").selectExpr(
        f"{corpora.FILE_SQL} as file",
        "case when event_id % 6 <> 0 then props end as response",
        "case when event_id % 6 = 0 then concat('Timeout: ', event_id) end as error",
    )
    return propose.proposal_outcomes(
        corpora.manifest(spark, sf_dir), responses, "processed/schema_documents", "large"
    )


# --- repair and merge -----------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_schema_text(corpora.proposals(spark, sf_dir))


@_query
def repair_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("dataset", "file", "status")


@_query
def repair_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_required(_parsed(spark, sf_dir))


@_query
def repair_misplaced_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = repair.repair_misplaced_properties(
        _parsed(spark, sf_dir), ["dataset", "file"]
    )
    return moved.select("dataset", "file", "path", "type_form", _types())


@_query
def repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(corpora.proposals(spark, sf_dir))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.schema_nodes(corpora.proposals(spark, sf_dir))


@_query
def schema_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select(
        "dataset", "file", "path", _types(), "type_form", "is_required"
    )


@_query
def path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.path_stats(_votes(spark, sf_dir))


@_query
def type_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.type_votes(_votes(spark, sf_dir))


@_query
def resolve_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.resolve_types(_votes(spark, sf_dir)).select("dataset", "path", _types())


@_query
def resolve_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.resolve_nullable(_votes(spark, sf_dir)).select(
        "dataset", "path", _types(), "nullable"
    )


@_query
def resolve_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.resolve_required(vote.path_stats(_votes(spark, sf_dir)))


@_query
def merge_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = vote.merge_schemas(corpora.proposals(spark, sf_dir))
    return merged.filter(is_member(F.col("path"))).select("dataset", "path", _types(), "required")


@_query
def render_master_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_master(
        vote.merge_schemas(corpora.proposals(spark, sf_dir)), ["dataset"]
    )


# --- comparison -----------------------------------------------------------------------------


def _both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master schema voted from one proposal per document against the inferred one."""
    docs = corpora.docs_sparse(spark, sf_dir)
    proposals = propose.propose_offline(docs, ["dataset", "doc_id"]).select(
        "dataset", F.col("doc_id").alias("file"), F.col("response").alias("text")
    )
    # Proposals are kept, as a model's answers would be: the merge reads them twice.
    proposals = cut(proposals)
    voted = vote.merge_schemas(proposals)
    return compare.schema_diff(voted, infer.infer_schema(docs), ["dataset"])


@_query
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_ways(spark, sf_dir).select(
        "dataset",
        "path",
        F.array_join("left_types", "|").alias("left_types"),
        F.array_join("right_types", "|").alias("right_types"),
        "left_required",
        "right_required",
        "outcome",
    )


@_query
def schema_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.schema_similarity(_both_ways(spark, sf_dir), ["dataset"])


def _changed(paths: DataFrame) -> DataFrame:
    """The path table with one member renamed and another one moved into a new object."""
    path = F.col("path")
    renamed = F.regexp_replace(path, r"^\.labels(?=\.|$)", ".marks")
    moved = F.when(path == ".n_chars", ".size.n_chars").otherwise(renamed)
    new = paths.filter(path == "").select("dataset", F.lit(".size").alias("path"), F.array(F.lit("object")).alias("types"), F.lit(True).alias("required"))
    return paths.select("dataset", moved.alias("path"), "types", "required").unionByName(new)


@_query
def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = cut(infer.infer_schema(corpora.docs_sparse(spark, sf_dir)).drop("nodes"))
    return compare.schema_changes(paths, _changed(paths), ["dataset"]).withColumn("to_path", F.coalesce("to_path", F.lit("")))
