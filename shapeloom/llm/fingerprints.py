"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two primes, the polynomial hash of every prefix. From them the
hash of any span follows in one step, so spans are compared at once and the longest common
extension of two places is found by binary search. A fingerprint is the hash of the whole text
and, for the set of its spans of ``SPAN`` code points, one least hash per slot; the share of
equal slots estimates how many spans two texts have in common.

Two texts are as like as the greater of that share and of what their longest common extensions
cover: forward from both starts and, of the rest, backward from both ends, in code points of the
longer text. The first tells texts with parts moved about, the second, exact and without sampling,
texts of which a part was exchanged: a text and its edited form agree forward up to the edit.

Neighbours: documents are dealt by ranges of doc_id, each range sorted in its task and read as a
stream, with the first document of the next range beside it. Texts move once.

Defined cases: a null text counts as empty. An empty text is like an empty one only (1), a text
shorter than a span is one span. Order is by descending doc_id, null last, rows with the same
doc_id by their hashes; a single document is its own next. Other columns, whatever their names,
are ignored. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 16
SLOTS = 64
# Ranges at most: their bounds are held by the driver.
MOST_RANGES = 10_000

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers and inverse powers of the bases, at least ``n``; grown by doubling."""
    if not _powers:
        _powers.extend((np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in PRIMES)
    for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        while len(_powers[k][0]) < n:
            size = len(_powers[k][0])
            _powers[k] = tuple(np.concatenate((t, t * np.uint64(pow(b, size, p)) % np.uint64(p))) for t, b in zip(_powers[k], (base, pow(base, -1, p)), strict=True))
    return _powers


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.tables = _tables(self.n + 1)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * t[0][: self.n] % np.uint64(p)) % np.uint64(p))) for t, p in zip(self.tables, PRIMES, strict=True)]

    def span(self, start: int, stop: int) -> int:
        """The hash of a span, the same wherever the span stands; 62 bits."""
        both = [(int(s[stop]) - int(s[start])) * int(t[1][start]) % p for s, t, p in zip(self.sums, self.tables, PRIMES, strict=True)]
        return both[0] << 31 | both[1]

    def spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of a length."""
        count = self.n - length + 1
        both = [(s[length:] + np.uint64(p) - s[:count]) % np.uint64(p) * t[1][:count] % np.uint64(p) for s, t, p in zip(self.sums, self.tables, PRIMES, strict=True)]
        return both[0] << np.uint64(31) | both[1]


def span_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """How far the texts agree from ``i`` and ``j`` on."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if span_equal(a, i, b, j, middle) else (low, middle - 1)
    return low


def common_ending(a: PrefixHashes, b: PrefixHashes, most: int) -> int:
    """How far the texts agree backward from their ends, ``most`` at most."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if span_equal(a, a.n - middle, b, b.n - middle, middle) else (low, middle - 1)
    return low


def covered(a: PrefixHashes, b: PrefixHashes) -> tuple[int, float]:
    """The common extension from both starts, and the share of the longer text that it and the
    common ending of the rest cover."""
    begin = common_extension(a, 0, b, 0)
    end = common_ending(a, b, min(a.n, b.n) - begin)
    return begin, (begin + end) / max(a.n, b.n) if a.n or b.n else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | PrefixHashes) -> str:
    """16 hex digits for the whole text, then 4 for each slot."""
    hashes = PrefixHashes(text) if isinstance(text, str) else text
    whole = int(_mixed(np.array([hashes.span(0, hashes.n) ^ hashes.n], np.uint64))[0])
    if not hashes.n:
        return f"{whole:016x}"
    spans = _mixed(hashes.spans(min(SPAN, hashes.n)))
    slot = (spans >> np.uint64(58)).astype(np.int64)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, spans << np.uint64(6))
    filled = np.bincount(slot, minlength=SLOTS) > 0
    # An empty slot takes over the next filled one, marked with the distance.
    taken = np.flatnonzero(filled)
    source = taken[np.searchsorted(taken, np.arange(SLOTS)) % len(taken)]
    away = ((source - np.arange(SLOTS)) % SLOTS).astype(np.uint64)
    values = _mixed(least[source] + away) & np.uint64(0xFFFF)
    return f"{whole:016x}" + values.astype(">u2").tobytes().hex()


def slots_alike(a: str, b: str) -> float:
    """The share of equal slots of two fingerprints; 1 if they are equal."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[16:]), ">u2") for f in (a, b))
    return float((x == y).mean()) if len(x) and len(y) else 0.0


class Fingerprinted:
    """A text with its prefix arrays and its fingerprint."""

    def __init__(self, text: str):
        self.text, self.hashes = text, PrefixHashes(text)
        self.print = fingerprint(self.hashes)

    def likeness(self, other: Fingerprinted) -> tuple[int, float]:
        """The common extension from both starts, and 0 to 1: how like the texts are."""
        if self.print == other.print:
            return self.hashes.n, 1.0
        extension, share = covered(self.hashes, other.hashes)
        return extension, max(slots_alike(self.print, other.print), share)


def edited(text: str, other: str) -> str:
    """The last third, rounded down, replaced by as much of the other text's start."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def _range_of(doc_id: Column, bounds: list) -> Column:
    """How many bounds, in falling order, are above the id: binary search in the row."""
    if not bounds:
        return F.lit(0)
    table, n = F.array(*[F.lit(b) for b in bounds]), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.try_element_at(table, at + step) > doc_id), at + step).otherwise(at))
    return F.when(doc_id.isNull(), F.lit(n)).otherwise(found)


def with_neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text in ranges: ``range_``, ``beside`` (true: the first of the next range)."""
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [1 - k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, F.lit(100_000)).alias("cuts")).first()["cuts"] if shares else []
    bounds = sorted(set(cuts or []), reverse=True)
    dealt = rows.withColumn("range_", _range_of(F.col("doc_id"), bounds))
    # A row for each range; a null id only leads a range that has no other.
    heads = dealt.groupBy("range_").agg(F.max("doc_id").alias("head"))
    turn = Window.orderBy("range_")
    last = F.max("range_").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("to", F.coalesce(F.lag("range_").over(turn), last)).select("head", "to")
    beside = dealt.join(lookup(heads, "range-heads"), F.col("doc_id").eqNullSafe(F.col("head")))
    beside = beside.select("doc_id", "text", F.col("to").alias("range_"), F.lit(True).alias("beside"))
    return dealt.withColumn("beside", F.lit(False)).unionByName(beside), len(bounds) + 1


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    edited_extension: how many code points from the start a text and its edited form share."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
        + [T.StructField("edited_extension", T.LongType())]
    )
    arrow = to_arrow_schema(out)

    def compare(row: tuple, after: tuple) -> tuple:
        (doc_id, own), (_, next_) = row, after
        changed = edited(own.text, next_.text)
        other = Fingerprinted(changed) if changed != own.text else own
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        extension, near = own.likeness(other)
        return doc_id, len(own.text), sha, own.print, other.print, near, own.likeness(next_)[1], extension

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, done, rows = None, False, []
        for batch in batches:
            ids, texts, beside = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                aside = beside[k].as_py()
                if done or (aside and before is None):
                    continue
                row = (ids[k].as_py(), Fingerprinted(texts[k].as_py()))
                if before is not None:
                    rows.append(compare(before, row))
                before, done = row, aside
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    dealt, ranges = with_neighbours(docs)
    dealt = dealt.repartitionById(ranges, F.col("range_")).sortWithinPartitions("beside", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.select("doc_id", "text", "beside").mapInArrow(stream, out)
