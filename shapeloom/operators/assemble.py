"""Relational rows to nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_documents(
    customers: DataFrame, orders: DataFrame, lineitems: DataFrame, parts: DataFrame
) -> DataFrame:
    """One document per order: person, products, transaction and its items.

    Lines meet their parts and fold into one row per order before customers come in; the parts
    and customers sides are broadcast only if Spark measures them as small.
    """
    lines = lineitems.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        F.struct(
            F.col("l_linenumber").alias("id"),
            F.col("l_orderkey").alias("transaction_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
        ).alias("item"),
        F.struct(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_size") > 10).alias("in_stock"),
            F.col("p_brand").alias("brand"),
        ).alias("product"),
    )
    folded = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("item", "product"))).alias("lines")
    )
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    member = F.struct(
        F.struct(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.org"))).alias("email"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_mktsegment").alias("segment"),
        ).alias("person"),
        F.transform("lines", lambda x: x["product"]).alias("products"),
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("person_id"),
            date.alias("date"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("total"),
        ).alias("transaction"),
        F.transform("lines", lambda x: x["item"]).alias("transaction_items"),
    )
    return (
        orders.join(folded, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderpriority").alias("dataset"),
            F.col("o_orderkey").alias("doc_id"),
            F.to_json(member).alias("json"),
        )
    )
