"""Packing by vector bins: examples share sequences under limits on tokens, segments and
loss-bearing tokens at once.

An open sequence is a bin with what is left of the three limits. Of the waiting examples that
fit whole, the one whose needs point most along what is left (largest dot product, each limit
scaled to 1) goes in. When none fits, the largest one is cut so that the tokens come out even;
its rest waits on. Examples of a sequence or more are cut into whole sequences first. What is
left at the end of a task goes into sequences of falling powers of two, which need no padding.

Each task packs the rows of its own partition: nothing is shuffled, a task holds one Arrow batch
and ``WAITING`` rests of less than a sequence each, and a task that is run again gives the same
rows. Numbers of sequences are unique over all tasks.

Defined cases: a null or empty text is a document of one token, the end mark. Null and repeated
doc_id are carried as they are. Other columns, whatever their names, are ignored. A table
without rows gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, portions, released

# Examples that wait for a place at most; more only delay when they are placed.
WAITING = 128
END = 0
# Texts with blanks before blanks, at the end or none at all: words cannot be told by blanks.
_BLANK_RUNS = "^$| [\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]| $"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def _byte_signs() -> dict[str, int]:
    """The signs that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file.

    Such a vocabulary never joins a blank that precedes a word to what stands before it, so a
    text may be cut before each such blank, and a word that a batch repeats is encoded once.
    Where ids follow the order of the merges, words are merged by rank; otherwise the
    vocabulary's own library encodes whole texts. ``with_added`` gives the tokens added to the
    vocabulary their own ids, as the library does by default; otherwise they are text.
    """

    def __init__(self, spec: str, with_added: bool = False):
        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"].get("merges", [])
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        before = model.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not model.get("normalizer")
        self.ranked = self.whole = None
        if byte_level and joined == sorted(joined):
            import tiktoken

            signs = _byte_signs()
            special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
            ranks = {bytes(signs[c] for c in word): i for word, i in vocab.items() if word not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level vocabularies cut words
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            for word, i in ranks.items():
                self.width[i] = len(word)
        # Texts that may hold tokens added to the vocabulary go to its own library.
        added = [re.escape(t["content"]) for t in model.get("added_tokens", []) if with_added]
        self.added = re.compile("|".join(added)) if added else None
        if self.ranked is None or added:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(spec)
            self.whole.encode_special_tokens = not with_added

    def _one(self, text: str) -> np.ndarray:
        if self.ranked is None or (self.added and self.added.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked.encode_ordinary(text), np.uint32)

    def batch(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text; no text may be null."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        odd = pc.match_substring_regex(texts, _BLANK_RUNS).to_numpy(zero_copy_only=False) if self.ranked else np.ones(len(texts), bool)
        if self.ranked and self.added:
            odd = odd | pc.match_substring_regex(texts, self.added.pattern).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(odd):
            out[k] = self._one(texts[k].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            for k, ids in zip(plain, self._by_words(texts.take(pa.array(plain))), strict=True):
                out[k] = ids
        return out

    def _by_words(self, texts: pa.StringArray) -> list[np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        begins = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        known, which = words.dictionary, words.indices.to_numpy().astype(np.int64)
        # All different words at once, each with its blank; ends of words are ends of ids.
        ids = np.array(self.ranked.encode_ordinary(" " + " ".join(known.to_pylist())), np.uint32)
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(pc.binary_length(known).to_numpy().astype(np.int64) + 1)) + 1
        # First words have no blank before them.
        heads = [self._one(w) for w in lists.flatten().take(pa.array(begins[:-1])).to_pylist()]
        which[begins[:-1]] = len(known) + np.arange(len(texts))
        pool = np.concatenate([ids, *heads])
        counts = np.concatenate((np.diff(stops, prepend=0), [len(h) for h in heads])).astype(np.int64)
        starts = np.cumsum(counts) - counts
        each = counts[which]
        ends = np.cumsum(each)
        flat = pool[np.arange(ends[-1]) + np.repeat(starts[which] - (ends - each), each)]
        cuts = np.concatenate(([0], ends))[begins]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One per worker process and vocabulary."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec, with_added=True)
    return _encoders[key]


class Packer:
    """Packs examples as they come; ``add`` and ``finish`` give pieces in closed sequences.

    An example is (key, ids, loss): loss tells for each id whether it bears loss, None: all do.
    A piece is (key, start, ids, sequence, offset, segment, filled).
    """

    def __init__(self, limits: Limits, first: int = 0):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit must be 1 or more")
        self.limits, self.sequence = limits, first
        self.keys: list = []  # (key, ids, running loss, start)
        self.tokens = np.zeros(0)
        self.loss = np.zeros(0)

    def _wait(self, key, ids: np.ndarray, running: np.ndarray, start: int) -> None:
        self.keys.append((key, ids, running, start))
        self.tokens = np.append(self.tokens, len(ids) - start)
        self.loss = np.append(self.loss, running[-1] - running[start])

    def _drop(self, at: int) -> None:
        del self.keys[at]
        self.tokens, self.loss = np.delete(self.tokens, at), np.delete(self.loss, at)

    def _prefix(self, at: int, tokens: int, loss: int) -> int:
        """How long a piece from the example's start may be."""
        _, ids, running, start = self.keys[at]
        stop = min(len(ids), start + tokens)
        return min(stop, int(np.searchsorted(running, running[start] + loss, "right")) - 1) - start

    def _fill(self, room: int) -> list:
        """One sequence of ``room`` tokens at most."""
        most = self.limits
        tokens, segments, loss, placed, offset = room, most.segments, min(most.loss, room), [], 0
        full_loss = loss
        while tokens and segments and self.keys:
            fits = (self.tokens <= tokens) & (self.loss <= loss)
            if fits.any():
                along = self.tokens * (tokens / room**2) + segments / most.segments**2 + self.loss * (loss / full_loss**2)
                at = int(np.where(fits, along, -1).argmax())
                length = int(self.tokens[at])
            else:
                at = int(self.tokens.argmax())
                length = self._prefix(at, tokens, loss)
                if length < 1:
                    break
            key, ids, running, start = self.keys[at]
            placed.append((key, start, ids[start : start + length], self.sequence, offset, len(placed)))
            offset, tokens, segments = offset + length, tokens - length, segments - 1
            loss -= int(running[start + length] - running[start])
            if start + length == len(ids):
                self._drop(at)
            else:
                self.keys[at] = (key, ids, running, start + length)
                self.tokens[at] -= length
                self.loss[at] = running[-1] - running[start + length]
        self.sequence += 1
        return [(*piece, offset) for piece in placed]

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        running = np.arange(len(ids) + 1) if loss is None else np.concatenate(([0], np.cumsum(loss)))
        start, most = 0, self.limits
        while len(ids) - start >= most.tokens:
            self.keys.append((key, ids, running, start))
            length = self._prefix(-1, most.tokens, most.loss)
            self.keys.pop()
            yield key, start, ids[start : start + length], self.sequence, 0, 0, length
            start, self.sequence = start + length, self.sequence + 1
        if start < len(ids):
            self._wait(key, ids[start:], running[start:] - running[start], 0)
            self.keys[-1] = (key, ids, running, start)
        while len(self.keys) > WAITING:
            yield from self._fill(most.tokens)

    def finish(self) -> Iterator[tuple]:
        while self.keys:
            left = int(self.tokens.sum())
            room = self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1)
            yield from self._fill(room)


def _rows(pieces: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = []
    for (doc_id, total), start, ids, sequence, offset, segment, filled in pieces:
        rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, sequence, offset, segment, filled))
        if len(rows) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "sequence_tokens"]


def _schema(docs: DataFrame) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in _PIECE]])
    return out, to_arrow_schema(out)


def _first_sequence() -> int:
    return TaskContext.get().partitionId() << 33


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits()) -> DataFrame:
    """Encode and pack the texts: a row per piece.

    ``vocabulary`` is read on the driver; the tasks get its content.
    """
    out, arrow = _schema(docs)
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            encode, packer = encoder(spec.value), Packer(limits, _first_sequence())
            for batch in released(batches):
                ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
                for at, stop in portions(texts):
                    for doc_id, found in zip(ids[at:stop].to_pylist(), encode.batch(texts[at:stop]), strict=True):
                        yield from packer.add((doc_id, len(found) + 1), np.append(found, np.uint32(END)))
            yield from packer.finish()

        yield from _rows(pieces(), arrow)

    return docs.select("doc_id", "text").mapInArrow(pack, out)


def pack_examples(examples: DataFrame, limits: Limits) -> DataFrame:
    """Pack examples that are ids already: doc_id, ids array<int>, loss array<boolean> (null: all
    ids bear loss). A null list of ids is empty and gives no piece."""
    out, arrow = _schema(examples)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            packer = Packer(limits, _first_sequence())
            for batch in batches:
                for doc_id, ids, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    found = np.array(ids or [], "<u4")
                    bears = None if loss is None else np.array(loss, np.int64)
                    yield from packer.add((doc_id, len(found)), found, bears)
            yield from packer.finish()

        yield from _rows(pieces(), arrow)

    return examples.select("doc_id", "ids", "loss").mapInArrow(pack, out)
