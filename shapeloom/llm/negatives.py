"""Hard negatives by exact integer products: Strassen multiplication of anchor and candidate tiles.

Vectors are scaled to whole numbers. Anchors (a stated query set) and candidates are dealt into
tiles of bounded size; a task gets one tile of each and multiplies blocks of them by Strassen's
recursion in 64-bit integers, padded with zeros, so that every score is exact. Two passes:

1. anchors against candidates of the same label keep the best positives in a heap per anchor;
2. anchors with their positives against candidates of other labels keep, for each positive, the
   best scores inside its window in a heap per (anchor, positive).

Heaps hold a bounded number of (score, id), best first; heaps of two blocks or of two tasks merge
into one of the same bound, in any order. What is shuffled is one heap per anchor and tile. A hot
label is many tiles; no task holds more than one tile of either side.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part. Vectors of different length are filled up with zeros; an empty one scores 0 with all.
Repeated rows are rows of their own: an anchor's copy is another row and may be its positive.
Equal scores go by the smaller id; rows equal in both are told apart by their place only, which
does not show in the result. A scaled component beyond a long is taken as the nearest long, and
products are those of longs, modulo 2 to the 64th. An anchor without positives, or a positive
without negatives in its window, has no row. Extra columns, whatever their names, are ignored.
A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, stored

# Rows of a tile, and numbers of one at most: long vectors make tiles of fewer rows.
ANCHOR_ROWS = 512
CANDIDATE_ROWS = 4096
TILE_NUMBERS = 4_000_000
# Blocks of candidates that a task multiplies at once.
BLOCK_ROWS = 1024
# Strassen's recursion ends where a side is this small.
LEAF = 16
_LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    anchors_every: int = 50
    moved_every: int = 7  # labels of rows whose id it divides move on by one
    labels: int = 10
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent of the positive's score
    high: int = 95


def _halves(m: np.ndarray) -> tuple[np.ndarray, ...]:
    r, c = m.shape[0] // 2, m.shape[1] // 2
    return m[:r, :c], m[:r, c:], m[r:, :c], m[r:, c:]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if levels == 0:
        return a @ b
    a11, a12, a21, a22 = _halves(a)
    b11, b12, b21, b22 = _halves(b)
    down = levels - 1
    m1 = _strassen(a11 + a22, b11 + b22, down)
    m2 = _strassen(a21 + a22, b11, down)
    m3 = _strassen(a11, b12 - b22, down)
    m4 = _strassen(a22, b21 - b11, down)
    m5 = _strassen(a11 + a12, b22, down)
    m6 = _strassen(a21 - a11, b11 + b12, down)
    m7 = _strassen(a12 - a22, b21 + b22, down)
    return np.block([[m1 + m4 - m5 + m7, m3 + m5], [m2 + m4, m1 - m2 + m3 + m6]])


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of longs, exact modulo 2 to the 64th.

    Sides are filled with zeros up to a multiple of 2 to the number of levels; additions that
    wrap around cancel, so whatever fits a long comes out right.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if not rows or not inner or not columns:
        return np.zeros((rows, columns), np.int64)
    levels = max(0, (min(rows, inner, columns) - 1) // leaf).bit_length()
    unit = 1 << levels

    def padded(m: np.ndarray) -> np.ndarray:
        return np.pad(m, [(0, -side % unit) for side in m.shape])

    with np.errstate(over="ignore"):
        return _strassen(padded(a), padded(b), levels)[:rows, :columns]


class Heaps:
    """Bounded heaps of (score, id, row), one per line: best score first, ties by smaller id."""

    def __init__(self, lines: int, most: int):
        self.most = most
        self.score = np.full((lines, 0), _LEAST)
        self.id = np.zeros((lines, 0), np.int64)
        self.row = np.zeros((lines, 0), np.int64)
        self.real = np.zeros((lines, 0), bool)

    def merge(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, real: np.ndarray) -> None:
        """Take in entries, those of a line in any order; entries that are not real do not count."""
        score, ids, rows, real = (np.concatenate(x, axis=1) for x in ((self.score, score), (self.id, ids), (self.row, rows), (self.real, real)))
        order = np.lexsort((rows, ids, ~score, ~real), axis=1)[:, : self.most]
        self.score, self.id, self.row, self.real = (np.take_along_axis(x, order, 1) for x in (score, ids, rows, real))

    def best_of(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in the best allowed entries of a block whose columns are in rising order of ids."""
        left = allowed.copy()
        lines = np.arange(len(scores))
        for _ in range(min(self.most, scores.shape[1])):
            masked = np.where(left, scores, _LEAST)
            at = masked.argmax(1)
            # A true score may be the least long: the first allowed column is then the best.
            low = ~left[lines, at]
            at[low] = left[low].argmax(1)
            real = left[lines, at]
            if not real.any():
                return
            self.merge(scores[lines, at][:, None], ids[at][:, None], rows[at][:, None], real[:, None])
            left[lines, at] = False


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of longs as lines of a matrix, filled with zeros."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    line = np.repeat(np.arange(len(lists)), sizes)
    out[line, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def prepared(vectors: DataFrame, settings: Settings) -> DataFrame:
    """row, id, label and the scaled vector of the rows that take part, written."""
    ends = (float(_LEAST), float(np.nextafter(2.0**63, 0)))

    def scaled(x: Column) -> Column:
        value = F.least(F.greatest(settings.scale * x.cast("double"), F.lit(ends[0])), F.lit(ends[1]))
        return F.floor(value).cast("long")

    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % settings.moved_every == 0, (label + 1) % settings.labels).otherwise(label)
    rows = vectors.select("vec_id", "label", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    )
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long").alias("id"),
            moved.alias("label"),
            F.transform("embedding", scaled).alias("v"),
        ),
        "vectors",
    )


def _tiles(rows: Column, most: int) -> Column:
    return F.greatest(F.ceil(rows / most), F.lit(1)).cast("int")


def _dealt(count: Column, salt: int) -> Column:
    """A tile number below ``count`` for a row."""
    return F.pmod(F.xxhash64("row", F.lit(salt)), count.cast("long")).cast("int")


def _all_tiles(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


_POSITIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "anchor_id", "row", "id", "score")])
_NEGATIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "anchor_id", "place", "positive_id", "positive_score", "row", "id", "score")])


def _anew(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table may be grouped with itself."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _blocks(candidates: pa.Table) -> Iterator[pa.Table]:
    candidates = candidates.sort_by("id")
    for at in range(0, candidates.num_rows, BLOCK_ROWS):
        yield candidates.slice(at, BLOCK_ROWS)


def _width(*tables: pa.Table) -> int:
    import pyarrow.compute as pc

    return max(pc.max(pc.list_value_length(t["v"])).as_py() or 0 for t in tables)


def _table(columns: list[np.ndarray], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def best_positives(anchors: pa.Table, candidates: pa.Table, most: int) -> pa.Table:
    """The heaps of a tile of anchors over a tile of candidates of the same label."""
    heaps = Heaps(anchors.num_rows, most)
    if anchors.num_rows and candidates.num_rows:
        width = _width(anchors, candidates)
        lines, own = _matrix(anchors["v"], width), _longs(anchors["row"])
        for block in _blocks(candidates):
            rows = _longs(block["row"])
            scores = strassen(lines, np.ascontiguousarray(_matrix(block["v"], width).T))
            heaps.best_of(scores, rows[None, :] != own[:, None], _longs(block["id"]), rows)
    line, place = np.nonzero(heaps.real)
    return _table(
        [
            _longs(anchors["row"])[line] if anchors.num_rows else [],
            _longs(anchors["id"])[line] if anchors.num_rows else [],
            *(x[line, place] for x in (heaps.row, heaps.id, heaps.score)),
        ],
        _POSITIVE,
    )


def best_negatives(anchors: pa.Table, candidates: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """For each positive of each anchor, the heap of its window over a tile of candidates."""
    found: list[tuple] = []
    if anchors.num_rows and candidates.num_rows:
        width = _width(anchors, candidates)
        lines, labels = _matrix(anchors["v"], width), _longs(anchors["label"])
        positives = anchors["positives"].to_pylist()
        blocks = [(b, strassen(lines, np.ascontiguousarray(_matrix(b["v"], width).T)), _longs(b["id"]), _longs(b["row"]), _longs(b["label"])) for b in _blocks(candidates)]
        row, ids = _longs(anchors["row"]), _longs(anchors["id"])
        for place in range(max(map(len, positives))):
            own = [p[place] if place < len(p) else None for p in positives]
            lines_with = np.array([k for k, p in enumerate(own) if p is not None])
            score = [own[k]["score"] for k in lines_with]
            # Whole numbers: low * p <= 100 * n <= high * p.
            least = np.array([max(-(-low * p // 100), _LEAST) for p in score], np.int64)
            greatest = np.array([high * p // 100 for p in score], np.int64)
            heaps = Heaps(len(lines_with), most)
            for _, scores, block_ids, block_rows, block_labels in blocks:
                scores = scores[lines_with]
                allowed = (scores >= least[:, None]) & (scores <= greatest[:, None]) & (block_labels[None, :] != labels[lines_with][:, None])
                heaps.best_of(scores, allowed, block_ids, block_rows)
            line, at = np.nonzero(heaps.real)
            k = lines_with[line]
            found.append(
                (
                    row[k],
                    ids[k],
                    np.full(len(k), place),
                    np.array([own[i]["id"] for i in k], np.int64),
                    np.array([own[i]["score"] for i in k], np.int64),
                    *(x[line, at] for x in (heaps.row, heaps.id, heaps.score)),
                )
            )
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * len(_NEGATIVE)
    return _table(columns, _NEGATIVE)


def _first(rows: DataFrame, keys: list[str], most: int, rank: str) -> DataFrame:
    """Merge the heaps of all tiles: the best ``most`` rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def hard_negatives(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = prepared(vectors, settings)
    is_anchor = F.col("id") % settings.anchors_every == 0
    sizes = lookup(
        rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("width")), "labels"
    )
    total, anchors_total, width = sizes.agg(*(F.coalesce(f, F.lit(0)) for f in (F.sum("rows"), F.sum("anchors"), F.max("width")))).first()
    per_tile = max(1, min(CANDIDATE_ROWS, TILE_NUMBERS // max(width, 1)))
    anchors_per_tile = max(1, min(ANCHOR_ROWS, TILE_NUMBERS // max(width, 1)))

    # Positives: tiles of one label each.
    sized = rows.join(
        sizes.select("label", _tiles(F.col("rows"), per_tile).alias("tiles"), _tiles(F.col("anchors"), anchors_per_tile).alias("anchor_tiles")), "label"
    )
    left = sized.where(is_anchor).select("label", _dealt(F.col("anchor_tiles"), 1).alias("x"), _all_tiles(F.col("tiles")).alias("y"), "row", "id", "v")
    right = sized.select("label", _all_tiles(F.col("anchor_tiles")).alias("x"), _dealt(F.col("tiles"), 2).alias("y"), "row", "id", "v")
    most = settings.positives

    def positives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_positives(a, b, most)

    key = ["label", "x", "y"]
    positives = _first(_anew(left).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(positives_of, _POSITIVE), ["anchor"], most, "place")
    chosen = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    anchors = stored(
        rows.where(is_anchor).join(chosen, F.col("row") == F.col("anchor")).select("row", "id", "label", "v", "positives"), "anchors"
    )

    # Negatives: tiles of all labels.
    tiles, anchor_tiles = (F.lit(max(1, -(-n // m))).cast("int") for n, m in ((total, per_tile), (anchors_total, anchors_per_tile)))
    left = anchors.select(_dealt(anchor_tiles, 1).alias("x"), _all_tiles(tiles).alias("y"), "row", "id", "label", "v", "positives")
    right = rows.select(_all_tiles(anchor_tiles).alias("x"), _dealt(tiles, 2).alias("y"), "row", "id", "label", "v")
    kept, low, high = settings.negatives, settings.low, settings.high

    def negatives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_negatives(a, b, kept, low, high)

    found = _anew(left).groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(negatives_of, _NEGATIVE)
    return _first(found, ["anchor", "place"], kept, "rank").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.r AS br, b.vec_id AS id, b.label AS bl,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
), positives AS (
  SELECT ar, anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) AS place
  FROM scored WHERE al = bl QUALIFY place <= 5
), negatives AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.id, s.br) AS rank
  FROM positives p JOIN scored s ON s.ar = p.ar AND s.al <> s.bl
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives
"""
