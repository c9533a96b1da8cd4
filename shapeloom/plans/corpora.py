"""JSON collections derived from the relational tables.

Each is ``dataset, doc_id, json`` (or ``dataset, file, text`` for schema proposals), over all rows
of the table it is made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.operators.assemble import assemble_documents
from shapeloom.session import fresh_dir

ORDINAL_BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on.

    Held in fewer files than there are cores it would keep most of them idle, so its rows are
    dealt out. Larger tables come in enough files and are read as they are.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def events_props(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    events = (spread_table if spread else table)(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("dataset"),
        F.col("event_id").alias("doc_id"),
        F.col("props").alias("json"),
    )


# Same text in both SQL dialects: datasets of very different sizes.
UNEVEN_SQL = "case when event_id % 100 < 70 then 'large' when event_id % 100 < 95 then 'middle' else 'small' end"


def uneven_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{UNEVEN_SQL} as dataset", "event_id as doc_id", "props as json"
    )


def orders_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_documents(
        *[table(spark, sf_dir, name) for name in ("customer", "orders", "lineitem", "part")]
    )


def _labelled(spark: SparkSession, sf_dir: str, with_nulls: bool) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    member = F.struct(
        F.col("doc_id").alias("id"),
        "source",
        "n_chars",
        F.struct("quality", "toxic").alias("labels"),
    )
    options = {"ignoreNullFields": str(not with_nulls).lower()}
    return documents.join(labels, "doc_id", "left").select(
        F.col("lang").alias("dataset"), "doc_id", F.to_json(member, options).alias("json")
    )


def docs_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels are left out."""
    return _labelled(spark, sf_dir, with_nulls=False)


def docs_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels are written as null."""
    return _labelled(spark, sf_dir, with_nulls=True)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("dataset"),
        F.col("vec_id").alias("doc_id"),
        F.to_json(F.struct(F.col("embedding").alias("v"))).alias("json"),
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key, many types."""
    return spread_table(spark, sf_dir, "events").selectExpr(
        "concat('m', event_id % 3) as dataset",
        "event_id as doc_id",
        """case when event_id % 7 = 0 then '{"a":null,"z":true}'
            when event_id % 5 = 0 then concat('{"a":', event_id, '}')
            when event_id % 5 = 1 then concat('{"a":', event_id, '.5}')
            when event_id % 5 = 2 then concat('{"a":"', event_type, '"}')
            when event_id % 5 = 3 then concat('{"a":[', event_id, ',"x",{"q":[]}]}')
            else concat('{"a":{"b":', event_id, '},"l":[]}') end as json""",
    )


# Same text in both SQL dialects: a schema per event, flawed in many ways.
PROPOSAL_SQL = """case
    when event_id % 13 = 0 then '{"type":"object","properties":{"id":{"type":'
    when event_id % 17 = 0 then concat('{"type":"object","id":{"type":"integer"},"value":',
        value_node, ',"note":{"enum":[1]},"required":["id"]}')
    when event_id % 19 = 0 then '{"type":"object","properties":[1]}'
    when event_id % 31 = 0 then '{"type":"object","properties":{"id":{"type":"integer"}},"required":[{"id":1}]}'
    when event_id % 37 = 0 then '[{"type":"object"}]'
    else concat(
        case when event_id % 11 = 0 then 'Here is the schema: ' else '' end,
        '{"type":"object","properties":{"id":{"type":"integer"},"value":', value_node,
        ',"meta":', meta_node, ',"flag":true},"required":',
        case when event_id % 7 = 0 then 'true' when event_id % 3 = 0 then '["id","value"]'
             else '["id"]' end, '}',
        case when event_id % 11 = 0 then ' Done.' else '' end) end"""
VALUE_NODE_SQL = """case
    when event_id % 23 = 0 then '{"type":["integer","null"]}'
    when event_id % 29 = 0 then '{"title":"v"}'
    when event_id % 41 = 0 then '{"type":{}}'
    when event_id % 5 = 0 then '{"type":"number"}' else '{"type":"integer"}' end"""
META_NODE_SQL = """case
    when event_id % 4 = 0 then '{"type":"object","properties":{"k":{"type":"integer"},"deep":{"type":"object","properties":{"x":{"type":"string"}},"required":["x"]}},"required":["k"]}'
    when event_id % 4 = 1 and event_type in ('click', 'view') then '{"type":"array","description":"d","items":{"type":"string"}}'
    when event_type = 'error' then '{"type":"array","items":{"type":"string"}}'
    else '{"type":["object","null"],"properties":{"k":{"type":"string"}}}' end"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spread_table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_type",
        f"{VALUE_NODE_SQL} as value_node",
        f"{META_NODE_SQL} as meta_node",
    )
    return nodes.selectExpr(
        "event_type as dataset", "cast(event_id as string) as file", f"{PROPOSAL_SQL} as text"
    )


FILE_SQL = """case when event_id % 101 = 0 then concat('document_', event_id, '.json')
    else concat('processed/', event_type, '/documents/document_', event_id, '.json') end"""
FLAG_SQL = """case event_id % 8 when 0 then 'True' when 1 then 'true ' when 2 then 'yes'
    when 3 then '1' when 4 then 'False' when 5 then '' when 6 then 'false' end"""
COMPLEXITY_SQL = """case event_id % 5 when 0 then 'low' when 1 then 'LOW' when 2 then 'high'
    when 3 then 'unknown' end"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{FILE_SQL} as file",
        "'documents' as object_type",
        f"{COMPLEXITY_SQL} as complexity",
        "'1' as keys",
        "'2' as depth",
        "'0' as arrays",
        "'0' as array_len",
        "cast(length(props) as string) as size_bytes",
        f"{FLAG_SQL} as schema_generated",
    )


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents the manifest lists."""
    return spread_table(spark, sf_dir, "events").selectExpr(f"{FILE_SQL} as file", "props as json")


def generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema files that exist: ``dataset, object_type, base_name``."""
    return (
        table(spark, sf_dir, "events")
        .filter("event_id % 3 <> 0")
        .selectExpr(
            "event_type as dataset",
            "'documents' as object_type",
            "concat('document_', event_id, '.json') as base_name",
        )
    )


def raw_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('rawJson/order_', o_orderkey, case when o_orderstatus = 'P' then '.txt' else '.json' end) as file"
    )


def schema_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderpriority <> '1-URGENT'")
        .selectExpr("concat('processedSchemas/order_', o_orderkey, '.schema.json') as file")
    )


# --- collections as files -----------------------------------------------------------------

EVENT_CHUNK = 2500
ARRAY_ELEMENT_SQL = """concat('{"id":', event_id, ',"t":"a,]}[{ ', event_type,
    '","v":[', event_id, ',[2,3]],"p":', props, '}')"""


def write_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON Lines per event type, with blank lines; one type has a broken line."""
    path = fresh_dir(spark, "lines")
    lines = table(spark, sf_dir, "events").selectExpr(
        "event_type as collection",
        """explode(case when event_id % 50 = 0 then array('  ', props)
            when event_type = 'error' and event_id % 997 = 0 then array(substr(props, 2))
            else array(props) end) as text""",
    )
    lines.write.partitionBy("collection").text(path)
    return path


def _write_folders(files: DataFrame, path: str, by: list[str]) -> None:
    """A file in a folder of its own for every value of ``by``.

    Making a folder takes longer than filling it, so the rows are dealt out by number, which
    adaptive execution does not undo for their small size, and every task puts its own files in
    place instead of leaving them to the driver.
    """
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = files.repartition(tasks, *by).write.partitionBy(*by)
    dealt.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def write_arrays(spark: SparkSession, sf_dir: str) -> str:
    """A file holding an array for every type and 2,500 events; some files are something else."""
    path = fresh_dir(spark, "arrays")
    element = table(spark, sf_dir, "events").selectExpr(
        "event_type", f"floor(event_id / {EVENT_CHUNK}) as chunk", "event_id", f"{ARRAY_ELEMENT_SQL} as e"
    )
    listed = element.groupBy("event_type", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "e"))).alias("es")
    )
    joined = "array_join(transform(es, x -> x.e), ',\\n ')"
    files = listed.selectExpr(
        "concat(event_type, '-', chunk) as collection",
        f"""case when event_type = 'error' and chunk % 2 = 1 then concat('[', {joined})
            when event_type = 'view' and chunk % 4 = 1 then array_join(transform(es, x -> x.e), '\\n')
            when event_type = 'view' and chunk % 4 = 2 then concat('# ', es[0].e)
            when event_type = 'view' and chunk % 4 = 3 then '   '
            else concat('[', {joined}, ']') end as text""",
    )
    _write_folders(files, path, ["collection"])
    return path


SUPPLIER_DOC_SQL = """case when s_suppkey % 10 = 3 then concat('{"id":', s_suppkey)
    else concat('{"id":', s_suppkey, ',"name":"', s_name, '","nation":{"key":', s_nationkey, '}}') end"""
SUPPLIER_SCHEMA_SQL = """case when s_suppkey % 10 = 3 then 'no schema'
    when s_suppkey % 4 = 0 then '{"type":"object","id":{"type":"integer"}}'
    else '{"type":"object","properties":{"id":{"type":"integer"}},"required":["id"]}' end"""


def write_supplier_files(spark: SparkSession, sf_dir: str, text_sql: str) -> str:
    """A file per supplier, in a folder per nation."""
    path = fresh_dir(spark, "suppliers")
    files = table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey as nation", "s_suppkey as supplier", f"{text_sql} as text"
    )
    _write_folders(files, path, ["nation", "supplier"])
    return path
