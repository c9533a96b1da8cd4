"""Exact deduplication by recipes of content-defined chunks. DataFrame functions only.

A text is cut where its own characters say so, so that equal texts give equal chunks and an
insertion shifts few of them. Chunks are deduplicated: each distinct chunk gets an identifier,
a 64-bit hash verified against the chunk's SHA-256; where two different chunks share a hash,
an ordinal sets them apart. Texts are then equal exactly when their lists of identifiers are,
so only lists move between machines, never the texts.

Defined cases: a null text counts as empty, an empty text has an empty list and is a copy of
every other empty text. Of equal texts the row with the smallest doc_id stays, a null doc_id
counting as the largest; of rows that repeat id and text, one stays. Other columns, whatever
their names, are ignored. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, lookup, numbered, stored

MIN_CHUNK = 1024
MAX_CHUNK = 16384
# A chunk may end at a blank that follows a sign whose code is 3 modulo 16, say "c" or "s".
CUT = "[" + "".join(chr(c) for c in range(0x23, 0x500, 16)) + r"][.,]?\x20"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, " ")


def chunks(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; joined they are the text again."""
    body = rf"(?s).{{{shortest},{longest - 4}}}?{CUT}|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(body), F.lit(0))


def recipes(docs: DataFrame, rid: str, id_bits: int = 64) -> DataFrame:
    """rid, doc_id, text_sha256 and the text's chunks as hashes and digests; narrow."""
    mask = -1 if id_bits >= 64 else (1 << id_bits) - 1
    cut = docs.select(F.col(rid).alias("rid"), "doc_id", normalised("text").alias("norm"))
    cut = cut.select("rid", "doc_id", "norm", chunks(F.col("norm")).alias("pieces"))
    return cut.select(
        "rid",
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform("pieces", lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask))).alias("hashes"),
        F.transform("pieces", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("digests"),
    )


def chunk_table(made: DataFrame) -> DataFrame:
    """Distinct chunks: hash, digest, copies."""
    each = made.select(F.explode(F.arrays_zip("hashes", "digests")).alias("c"))
    return each.groupBy(F.col("c.hashes").alias("hash"), F.col("c.digests").alias("digest")).agg(F.count(F.lit(1)).alias("copies"))


def identified(made: DataFrame) -> DataFrame:
    """Adds ``recipe``, the list of verified identifiers, and drops the raw lists."""
    shared = chunk_table(made).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.collect_set("digest").alias("all"))
    shared = stored(shared.where("n > 1").select("hash", F.posexplode(F.sort_array("all")).alias("ordinal", "digest")), "chunk-clashes")
    plain = made.withColumn("recipe", F.col("hashes")).withColumn("n_chunks", F.size("hashes"))
    if shared.isEmpty():
        return plain.drop("hashes", "digests")
    each = made.select("rid", F.posexplode(F.arrays_zip("hashes", "digests")).alias("at", "c")).select("rid", "at", F.col("c.hashes").alias("hash"), F.col("c.digests").alias("digest"))
    told = each.join(shared, ["hash", "digest"], "left").groupBy("rid").agg(
        F.max(F.col("ordinal").isNotNull()).alias("clash"), F.sort_array(F.collect_list(F.struct("at", F.coalesce("ordinal", F.lit(0)).cast("long").alias("o")))).alias("os")
    )
    told = told.where("clash").select("rid", F.transform("os", lambda x: x["o"]).alias("ordinals"))
    # A longer list for the same number of chunks cannot be mistaken for a plain one.
    listed = plain.join(told, "rid", "left").withColumn("recipe", F.when(F.col("ordinals").isNull(), F.col("hashes")).otherwise(F.concat("hashes", "ordinals")))
    return listed.drop("hashes", "digests", "ordinals")


def exact_groups(docs: DataFrame, rid: str, id_bits: int = 64) -> DataFrame:
    """A row per row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    listed = stored(identified(stored(recipes(docs, rid, id_bits), "recipes")), "recipe-lists")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("rid"))
    groups = listed.groupBy("n_chunks", "recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
    groups = groups.where("group_size > 1").select("n_chunks", "recipe", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    out = listed.join(lookup(groups, "copy-groups"), ["n_chunks", "recipe"], "left")
    alone = F.col("keep_rid").isNull()
    return out.select(
        "rid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def exact_dedup(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for every row."""
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    return exact_groups(rows, "rid", id_bits).drop("rid")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, rid = numbered(docs, "exact-rows")
    gone = exact_groups(rows, rid).where(~F.col("kept")).select(F.col("rid").alias(rid))
    return rows.join(lookup(gone, "exact-gone"), rid, "left_anti").select(*docs.columns)
