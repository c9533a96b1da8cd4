"""Byte-level BPE by replaying the merges over all new words of a batch at once.

The different words of a batch are laid out behind one another as bytes. An inverted index leads
from each rank to the places of the pairs that merge into it; ranks are taken in rising order,
all places of a rank at once, and only the two neighbours of a merged pair are looked up again
and entered into the index. A pair that arises with a lower rank than the one at work is next. A
word in which that happens is replayed place by place, since its other places of the higher rank
should have waited. A word that is an entry of the vocabulary is that entry. Words are kept
between batches up to ``KEPT_BYTES``; then the memory starts anew.

Decoding joins the bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to nothing. Texts are encoded whole,
however long; a text without any cut is one word. Null and repeated doc_id are carried as they
are, a row each. Other columns, whatever their names, are ignored. A table without rows gives
none. Ids outside the vocabulary cannot be decoded and raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, portions, released

# Bytes of words and their ids that a worker keeps between batches.
KEPT_BYTES = 48_000_000
# No byte of UTF-8 text: stands between words.
_BETWEEN = b"\xff"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, content.splitlines()))}


class Vocabulary:
    """Ranks of byte strings, and which pairs of them merge into which."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(255) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.none = size  # rank of a pair that does not merge
        self.stride = size + 1
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[(left + 1) * self.stride + right + 1] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.base = np.array([ranks.get(bytes([b]), -1) for b in range(255)] + [-1], np.int32)
        # The bytes of every id, one behind the other.
        self.width = np.full(size, -1, np.int64)
        for word, rank in ranks.items():
            self.width[rank] = len(word)
        known = sorted(ranks, key=ranks.get)
        self.bytes = np.frombuffer(b"".join(known), np.uint8)
        self.begin = np.cumsum(np.maximum(self.width, 0)) - np.maximum(self.width, 0)
        self.decimal = [str(i) for i in range(size)]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank each pair of ids merges into, or ``none``; -1 stands between words."""
        wanted = (left.astype(np.int64) + 1) * self.stride + right + 1
        if not len(self.keys):
            return np.full(len(wanted), self.none, np.int32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], np.int32(self.none))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, as an array."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.width) or self.width[ids].min() < 0):
            raise ValueError("ids outside the vocabulary")
        width = self.width[ids]
        ends = np.cumsum(width)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[ids] - (ends - width), width)]


def _every_other(at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap, one behind the other, the first, the third and so on."""
    chained = np.concatenate(([False], right[:-1] == at[1:]))
    if not chained.any():
        return np.ones(len(at), bool)
    number = np.arange(len(at))
    first = np.maximum.accumulate(np.where(chained, 0, number))
    return (number - first) % 2 == 0


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one behind the other, and how many each word has."""
    raw = np.frombuffer(_BETWEEN + _BETWEEN.join(words) + _BETWEEN, np.uint8)
    ids = vocabulary.base[raw]
    n, none = len(ids), vocabulary.none
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[-1] = n - 1
    rank = np.append(vocabulary.ranks_of(ids[:-1], ids[1:]), np.int32(none)).astype(np.int32)
    # The inverted index: rank -> places, those of the bytes apart from those that arise.
    order = np.argsort(rank, kind="stable")
    order = order[: np.searchsorted(rank[order], none)]
    ranks, starts = np.unique(rank[order], return_index=True)
    first = dict(zip(ranks.tolist(), np.split(order, starts[1:]), strict=True)) if len(ranks) else {}
    index: dict[int, list[int]] = {r: [] for r in first}
    waiting = list(index)
    heapq.heapify(waiting)
    doubtful: list[np.ndarray] = []
    while waiting:
        r = heapq.heappop(waiting)
        at, arisen = first.pop(r, None), index.pop(r)
        if arisen:
            at = np.unique(np.array(arisen if at is None else [*at.tolist(), *arisen]))
        at = at[rank[at] == r]
        if not len(at):
            continue
        right = after[at]
        if len(at) > 1:
            taken = _every_other(at, right)
            at, right = at[taken], right[taken]
        follower = after[right]
        if len(at) > 1:
            # Between two neighbouring pairs a lower rank may have arisen for a moment.
            near = np.flatnonzero(follower[:-1] == at[1:])
            if len(near):
                near = near[vocabulary.ranks_of(np.full(len(near), r), ids[at[near + 1]]) < r]
                doubtful.append(at[near])
        ids[at], ids[right], rank[right] = r, -2, none
        after[at], before[follower] = follower, at
        touched = np.concatenate((before[at], at))
        now = vocabulary.ranks_of(ids[touched], ids[after[touched]])
        rank[touched] = now
        live = now < none
        if live.any():
            for place, new in zip(touched[live].tolist(), now[live].tolist(), strict=True):
                places = index.get(new)
                if places is None:
                    index[new] = [place]
                    heapq.heappush(waiting, new)
                else:
                    places.append(place)
            if len(at) > 1 and (now < r).any():
                doubtful.append(touched[now < r])
    between = raw == _BETWEEN[0]
    word = np.cumsum(between) - 1
    left = ids >= 0
    counts = np.bincount(word[left], minlength=len(words) + 1)[: len(words)]
    flat = ids[left].astype(np.uint32)
    again = {int(k): replay_one(words[k], vocabulary) for k in np.unique(word[np.concatenate(doubtful)])} if doubtful else {}
    for k in np.flatnonzero(counts > 1):
        whole = vocabulary.ranks.get(words[k])
        if whole is not None:
            again[int(k)] = [whole]
    if again:
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for k, own in again.items():
            parts[k], counts[k] = np.array(own, np.uint32), len(own)
        flat = np.concatenate(parts)
    return flat, counts


def replay_one(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one word, place by place: the lowest rank, of equal ones the first place."""
    ids = vocabulary.base[np.frombuffer(word, np.uint8)].tolist()
    n, pairs, stride = len(ids), vocabulary.pairs, vocabulary.stride
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(at: int) -> int | None:
        return pairs.get((ids[at] + 1) * stride + ids[after[at]] + 1) if after[at] < n else None

    heap = [(r, at) for at in range(n) if (r := rank(at)) is not None]
    heapq.heapify(heap)
    while heap:
        r, at = heapq.heappop(heap)
        if ids[at] < 0 or rank(at) != r:
            continue
        gone = after[at]
        ids[at], ids[gone], after[at] = r, -1, after[gone]
        if after[at] < n:
            before[after[at]] = at
        for place in (before[at], at):
            if place >= 0 and (new := rank(place)) is not None:
                heapq.heappush(heap, (new, place))
    return [i for i in ids if i >= 0]


class Encoder:
    """Encodes texts: ``pattern`` cuts them into words, each word is encoded by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.words = regex.compile(pattern)
        self._anew()

    def _anew(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.int64)
        self.held = 0

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        ids, counts = replay(raw, self.vocabulary)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        self.held += sum(map(len, raw)) + 100 * len(raw) + 4 * len(ids)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > KEPT_BYTES:
            self._anew()
        cut = [self.words.findall(t) for t in texts]
        words = [w for c in cut for w in c]
        new = set(words).difference(self.known)
        if new:
            self._learn(list(new))
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        each = self.counts[which]
        ends = np.cumsum(each)
        starts = np.cumsum(self.counts) - self.counts
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - each), each)]
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, cut)])]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """One per worker process, vocabulary and pattern."""
    key = (zlib.crc32(content), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(read_ranks(content)), pattern)
    return _encoders[key]


def _encoded(docs: DataFrame, ranks: str, pattern: str, out: T.StructType, row) -> DataFrame:
    """A row for each of ``docs``: its doc_id and what ``row`` makes of the encoder and the ids."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(ranks, "rb") as file:
        content = file.read()
    shared, arrow = docs.sparkSession.sparkContext.broadcast(content), to_arrow_schema(out)
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for batch in released(batches):
            texts = pc.fill_null(batch.column(1), "")
            for at, stop in portions(texts):
                rows = [row(own.vocabulary, ids) for ids in own.batch(texts[at:stop].to_pylist())]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:stop].cast(arrow[0].type), *columns], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(encode, out)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids array<int> of every row. ``ranks`` is read on the driver; tasks get its content."""
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _encoded(docs, ranks, pattern, out, lambda _, ids: (ids.astype(np.int32),))


def decode_documents(rows: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for; a null list of ids is empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("bytes", T.BinaryType())])
    with open(ranks, "rb") as file:
        shared, arrow = rows.sparkSession.sparkContext.broadcast(file.read()), to_arrow_schema(out)
    bounded_batches(rows.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(shared.value, "").vocabulary
        for batch in released(batches):
            made = [vocabulary.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), pa.array(made, arrow[1].type)], schema=arrow)

    return rows.select("doc_id", "ids").mapInArrow(decode, out)


def round_trips(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids as text and of the bytes they decode to."""
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def row(vocabulary: Vocabulary, ids: np.ndarray) -> tuple:
        said = " ".join([vocabulary.decimal[i] for i in ids.tolist()])
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(vocabulary.decode(ids).tobytes()).hexdigest()

    return _encoded(docs, ranks, pattern, out, row)
