"""Near-duplicates by min-max hashing.

A document is the set of its 5-word shingles. Each permutation of the hash space gives two
values of a signature, the least and the greatest shingle under it; both agree between two sets
with a probability equal to their similarity, so ``PERMUTATIONS`` evaluations give twice as many
values. ``BANDS`` bands of ``ROWS`` values make candidates: at similarity 0.75 a pair shares no
band with a probability below 1e-7. Every link is then confirmed on full sets.

Copies of one set are one node. A set with too few shingles in common with any other candidate is
left alone, and so is a pair that cannot reach the similarity by these counts. Within a band's bucket, no list of all pairs is made: one member
is compared with all others, links join components, and only where a bucket still spans several
components are further members compared with the rest, a few per bucket and round, until every
candidate pair is either compared or joined otherwise. Members that were compared with all
others leave the bucket.

Defined cases: a null, empty or blank text has an empty set and links with nothing; fewer than
five words are one shingle. Rows that repeat a doc_id or a text are rows of their own; of a
component the row with the smallest doc_id (null last) stays, one row of those. Other columns,
whatever their names, are ignored. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lookup, numbered, release, release_since, released, stored, work_mark
from .components import components

WORDS = 5
PERCENT = 75
PERMUTATIONS = 160
BANDS = 64
ROWS = 5
# Longs of a set's bitmap.
MARKS = 16
_SEED = 20240607
# Permutations at once: bounds the working memory for long documents.
_BLOCK_VALUES = 250_000


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


_PLACE = _odd(_SEED, WORDS)
_FACTOR = _odd(_SEED + 1, PERMUTATIONS)
_SHIFT = _odd(_SEED + 2, PERMUTATIONS)
_BAND = _odd(_SEED + 3, BANDS * ROWS).reshape(BANDS, ROWS)
_SALT = _odd(_SEED + 4, BANDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - WORDS + 1
    total = each[:count] * _PLACE[0]
    for k in range(1, WORDS):
        total += each[k : k + count] * _PLACE[k]
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, side by side."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    step = max(1, _BLOCK_VALUES // len(hashes))
    for at in range(0, PERMUTATIONS, step):
        values = hashes[None, :] * _FACTOR[at : at + step, None] + _SHIFT[at : at + step, None]
        out[at : at + step, 0] = values.min(1)
        out[at : at + step, 1] = values.max(1)
    return out.T.reshape(-1)


def bands(values: np.ndarray) -> np.ndarray:
    """A hash for each band of a signature, different between bands."""
    # A band takes values of different permutations, least and greatest ones by turns.
    return _mixed((values.reshape(ROWS, BANDS).T * _BAND).sum(1, dtype=np.uint64) + _SALT).astype(np.int64)


def sketches(docs: DataFrame, rid: str) -> DataFrame:
    """rid, doc_id, text_hash, n_shingles, set_id (null: empty), bands; narrow."""
    out = T.StructType(
        [T.StructField("rid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sizes, sets, keys = [], [], []
            for text in batch.column(3):
                found = shingles(text.as_py())
                sizes.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(bands(signature(found)) if len(found) else None)
            values = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            ends = np.cumsum([0] + [BANDS if k is not None else 0 for k in keys])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), lists], names=out.names)

    return docs.select(F.col(rid).alias("rid"), "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, out)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes, marks of the documents in ``nodes`` (node, doc_id, text_hash).

    Marks are a bitmap: the bit that a hash names is set.
    """
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    texts = keyed.join(lookup(nodes, "candidates"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = [shingles(t.as_py()) for t in some.column(1)]
                bits = np.zeros((len(found), 64 * MARKS), np.uint8)
                for k, hashes in enumerate(found):
                    bits[k, (hashes % np.uint64(64 * MARKS)).astype(np.int64)] = 1
                marks = pa.array(np.packbits(bits, axis=1).view(np.int64).ravel(), pa.int64())
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values) for ends, values in ((np.cumsum([0, *map(len, found)]), pa.array(np.concatenate(found).astype(np.int64), pa.int64())), (np.arange(len(found) + 1) * MARKS, marks))]
                yield pa.RecordBatch.from_arrays([some.column(0), *lists], names=out.names)

    return texts.select("node", "text").mapInArrow(run, out)


def _possible(one: str, two: str) -> Column:
    """Whether two sets can be similar enough, by counts alone.

    In both are at most the shingles that are not one set's alone, and no shingle whose mark the
    other set lacks. 7 times the shingles in both must reach 3 times the sum of sizes.
    """
    n, m = F.col(f"{one}n"), F.col(f"{two}n")
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}m{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}m{k}")))) for k in range(MARKS)), F.lit(0))
    both = F.least(F.col(f"{one}shared"), F.col(f"{two}shared"), n - lacks(one, two), m - lacks(two, one))
    return F.lit(100 + PERCENT) * both >= F.lit(PERCENT) * (n + m)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with whether their full sets are similar enough: a, b, linked.

    Only sets that a pair names are moved.
    """
    named = lookup(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "compared-nodes")
    sets = sets.join(named, "node", "left_semi")
    one = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    both = pairs.select("a", "b").join(one, "b").join(two, "a").select("a", "b", "ha", "hb")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("linked", T.BooleanType())])

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        at = np.searchsorted(a, b)
        shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
        return 100 * shared >= PERCENT * (len(a) + len(b) - shared)

    def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
        values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        return (values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            linked = [similar(x, y) for x, y in zip(arrays(batch.column(2)), arrays(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=out.names)

    return both.mapInArrow(run, out)


def _relabelled(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The components after new links; only links between components are looked at."""
    if labels is None:
        return components(fresh)
    known = lookup(labels, "labels")
    ends = fresh.alias("e").join(known.alias("x"), F.col("e.a") == F.col("x.node"), "left").join(known.alias("y"), F.col("e.b") == F.col("y.node"), "left")
    x, y = F.coalesce(F.col("x.component"), F.col("e.a")), F.coalesce(F.col("y.component"), F.col("e.b"))
    links = stored(ends.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct(), "new-links")
    joined = components(links)
    moved = labels.alias("l").join(lookup(joined, "moved").alias("j"), F.col("l.component") == F.col("j.node"), "left").select("l.node", F.coalesce("j.component", "l.component").alias("component"))
    return stored(moved.unionByName(joined.join(labels, "node", "left_anti")), "labels")


def node_components(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """set_id, node, copies, component for each distinct set; a set's node is its least rid."""
    order = F.struct(F.col("rid"), F.col("doc_id"), F.col("text_hash"))
    nodes = sketched.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(order).alias("of"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("set_id", F.col("of.rid").alias("node"), F.col("of.doc_id").alias("doc_id"), F.col("of.text_hash").alias("text_hash"), "copies", "bands"), "set-nodes")
    each = nodes.select("node", F.explode("bands").alias("key"))
    buckets = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "band-buckets")
    members = banded = stored(each.join(buckets, "key"), "band-members")
    met = members.select("node").distinct()
    sets = stored(_sets(docs, nodes.join(met, "node", "left_semi").select("node", "doc_id", "text_hash")).dropDuplicates(["node"]), "candidate-sets")
    # A shingle that no other candidate has is in no intersection.
    own = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("node", F.size("hashes").cast("long").alias("n"), "marks").join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"), *[F.col("marks")[k].alias(f"m{k}") for k in range(MARKS)])
    sizes = sizes.where(F.lit(100) * F.col("shared") >= F.lit(PERCENT) * F.col("n"))
    sizes = lookup(sizes, "set-sizes")
    facts = ["n", "shared", *[f"m{k}" for k in range(MARKS)]]
    begun = work_mark(docs.sparkSession)
    members = stored(members.join(sizes.select("node"), "node", "left_semi"), "open-members")
    labels = rejected = None
    few = 0
    while True:
        mark = work_mark(docs.sparkSession)
        # Rounds write keys, nodes and labels; a set's facts are joined to where they are asked for.
        labelled = members.withColumn("label", F.col("node")) if labels is None else members.join(lookup(labels, "labels"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
        labelled = stored(labelled, "labelled-members")
        open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "low")
        spread = stored(labelled.join(lookup(open_, "open-buckets"), "key"), "spread-members")
        release(labelled)
        if spread.isEmpty():
            break
        if not few:  # first the smallest member of each bucket
            turn = spread.where("node = low")
        else:
            # The component of the smallest label waits no more; of the other members about
            # ``few`` of a bucket have their turn now, all of them when they are that few.
            waiting = spread.where("label <> low").groupBy("key").agg(F.count(F.lit(1)).alias("waiting"))
            turn = spread.where("label <> low").join(lookup(waiting, "waiting"), "key")
            turn = turn.where((F.col("waiting") <= few) | (F.pmod(F.xxhash64("key", "node", F.lit(few)), F.col("waiting")) < few))
        turn = turn.select("key", "node", "label").join(sizes, "node")
        turn = lookup(turn.select("key", F.col("node").alias("center"), F.col("label").alias("center_label"), *[F.col(c).alias(f"center_{c}") for c in facts]), "turns")
        wide = spread.select("key", "node", "label").join(sizes, "node")
        pairs = wide.join(turn, (wide["key"] == turn["key"]) & (F.col("label") != F.col("center_label")) & _possible("", "center_"))
        pairs = pairs.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
        if rejected is not None:
            pairs = pairs.join(rejected, ["a", "b"], "left_anti")
        checked = stored(_confirmed(stored(pairs, "pairs"), sets), "compared")
        no, fresh = checked.where("not linked").select("a", "b"), checked.where("linked").select("a", "b")
        rejected = stored(no if rejected is None else rejected.unionByName(no), "rejected")
        if not fresh.isEmpty():
            labels = stored(_relabelled(labels, fresh), "components")
        left = spread.select("key", "node").join(turn.select("key", F.col("center").alias("node")), ["key", "node"], "left_anti")
        members = stored(left, "open-members")
        release_since(docs.sparkSession, mark, members, rejected, labels)
        few = max(4, 4 * few)
    found = nodes.select("set_id", "node", "copies", F.col("node").alias("component"))
    if labels is not None:
        found = nodes.join(lookup(labels, "labels"), "node", "left").select("set_id", "node", "copies", F.coalesce("component", "node").alias("component"))
    found = stored(found, "set-components")
    release_since(docs.sparkSession, begun, found)
    release(sizes, sets, members, buckets, banded, nodes)
    return found


def near_groups(docs: DataFrame, rid: str) -> DataFrame:
    """A row per row of ``docs``: rid, doc_id, n_shingles, component_id, kept."""
    sketched = stored(sketches(docs, rid), "sketches")
    found = node_components(docs, sketched)
    shared = found.groupBy("component").agg(F.sum("copies").alias("rows")).where("rows > 1").select("component")
    shared = found.select("set_id", "component").join(lookup(shared, "shared-components"), "component")
    rows = stored(sketched.select("rid", "doc_id", "n_shingles", "set_id").join(lookup(shared, "shared-sets"), "set_id", "left"), "rows-by-component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("rid"))).alias("first")
    firsts = rows.where(F.col("component").isNotNull()).groupBy("component").agg(first).select("component", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"))
    out = rows.join(lookup(firsts, "component-firsts"), "component", "left")
    alone = F.col("first_rid").isNull()
    return out.select("rid", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"), (alone | (F.col("rid") == F.col("first_rid"))).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    return near_groups(rows, "rid").drop("rid")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns."""
    rows, rid = numbered(docs, "near-rows")
    gone = near_groups(rows, rid).where(~F.col("kept")).select(F.col("rid").alias(rid))
    return rows.join(lookup(gone, "near-gone"), rid, "left_anti").select(*docs.columns)
