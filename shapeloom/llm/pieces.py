"""SentencePiece encoding and decoding by suffix arrays.

The new words of a batch are joined to one text and its suffixes sorted. Every piece of the
vocabulary is looked up by binary search: the suffixes that start with it are one range of the
array, so all its places are known at once. The places are edges; sorted by where they end, they
are relaxed from left to right, all words in step.

What relaxing means depends on the model. A unigram model keeps the path with the best sum of
scores. A merge model (BPE) keeps the one edge that merging itself would have left: a piece may
follow another only if no merge across their border comes before the merges that made them; such
a piece is unique at every place, and the last ones give the word's pieces.

A word is a run of blanks with the letters behind it. Vocabularies with a piece that goes on
behind a blank are encoded by whole texts.

Defined cases: a null or empty text has no ids. Characters without a piece become bytes where the
vocabulary has bytes, else one unknown per run. Other columns, whatever their names, are ignored;
a table without rows gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import portions

BLANK = "▁"
CACHED_WORDS = 1_000_000
# Longer words are relaxed one by one.
IN_STEP = 256
# Characters of new words that are indexed at once.
INDEXED = 600_000


@dataclass
class Vocabulary:
    """What the driver reads from a model file; it goes to the tasks as it is."""

    model: bytes
    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray  # pieces that match text
    byte_ids: list[int] | None
    unknown: int
    merges: bool


def load(path: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = file.read()
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    kinds = [p.type for p in spec.pieces]
    if 4 in kinds:
        raise ValueError("vocabularies with user-defined pieces are not supported")
    if spec.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    processor = SentencePieceProcessor(model_proto=model)
    pieces = [p.piece for p in spec.pieces]
    by_name = {p: i for i, p in enumerate(pieces) if kinds[i] == 6}
    byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)] if by_name else None
    plain = np.array([k in (1,) for k in kinds])
    return Vocabulary(model, pieces, np.array([p.score for p in spec.pieces]), plain, byte_ids, processor.unk_id(), spec.trainer_spec.model_type == 2)


class Encoder:
    """Tables of one vocabulary in a worker.

    Inside, a symbol's number is its rank: single characters first, then pieces in the order in
    which merging prefers them.
    """

    def __init__(self, vocabulary: Vocabulary):
        from sentencepiece import SentencePieceProcessor

        self.v = vocabulary
        self.normalize = SentencePieceProcessor(model_proto=vocabulary.model).normalize
        ids = np.flatnonzero(vocabulary.plain)
        names = [vocabulary.pieces[i] for i in ids]
        self.longest = max(map(len, names), default=1)
        signs = sorted({c for name in names for c in name})
        if len(signs) > 65_000:
            raise ValueError("too many different characters in the vocabulary")
        self.code = {c: k + 1 for k, c in enumerate(signs)}
        single = {name: int(i) for name, i in zip(names, ids, strict=True) if len(name) == 1}
        many = sorted((int(i) for i, name in zip(ids, names, strict=True) if len(name) > 1), key=lambda i: (-vocabulary.scores[i], i))
        self.symbols = signs + [vocabulary.pieces[i] for i in many]
        self.ids = np.array([single.get(c, -1) for c in signs] + many, np.int64)
        self.score = np.where(self.ids >= 0, vocabulary.scores[np.maximum(self.ids, 0)], -1e9)
        self.base = len(signs)
        self.lengths = np.array([len(s) for s in self.symbols], np.int64)
        self.by_words = not any(BLANK in s.lstrip(BLANK) for s in self.symbols)
        if vocabulary.merges:
            self._merge_tables()
        table = np.zeros((len(self.symbols), self.longest), ">u2")
        for k, s in enumerate(self.symbols):
            table[k, : len(s)] = [self.code[c] for c in s]
        low, high = table, np.where(table == 0, 0xFFFF, table).astype(">u2")
        self.low, self.high = (np.ascontiguousarray(t).view(f"S{2 * self.longest}").ravel() for t in (low, high))
        self.table = np.full(0x110000, 0xFFFE, np.uint16)
        self.table[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.table[0] = 0xFFFE
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.ends = [], [np.zeros(1, np.int64)]  # ids of the known words, one after another

    def _merge_tables(self) -> None:
        rank = {s: k for k, s in enumerate(self.symbols)}
        pairs = {}
        for s, k in rank.items():
            for at in range(1, len(s)):
                left, right = rank.get(s[:at]), rank.get(s[at:])
                if left is not None and right is not None:
                    pairs[left, right] = k
        self.pairs, n = pairs, len(self.symbols)
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.left, self.right, self.whole = np.arange(n), np.arange(n), np.ones(n, bool)
        for k in range(self.base, n):
            parts = [rank[c] for c in self.symbols[k]]
            while len(parts) > 2:
                options = [(pairs.get((a, b), n), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                made, at = min(options)
                if made == n:
                    break
                parts[at : at + 2] = [made]
            if len(parts) == 2 and pairs.get(tuple(parts)) == k:
                self.left[k], self.right[k] = parts
            else:
                self.whole[k] = False  # merging never makes this piece

    def _follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between two pieces alone.

        Both are taken apart again, the one made last first; if at some point a merge across the
        border would have come before, the border does not stand.
        """
        n = len(self.symbols)
        good = np.ones(len(first), bool)
        live = np.flatnonzero((first >= 0) & (second >= 0))
        a, b, limit = first[live].copy(), second[live].copy(), np.full(len(live), n + 1, np.int64)
        while len(live):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = (self.pair_keys[at] == key) & (self.pair_made[at] < limit)
            good[live[across]] = False
            cut_a = a > b
            # The later of the two is cut; a single character cannot be, then the other one is.
            single_a, single_b = self.right[a] == a, self.left[b] == b
            cut_a = np.where(cut_a, ~single_a, single_b & ~single_a)
            done = single_a & single_b
            limit = np.where(cut_a, a, b + 1)
            a, b = np.where(cut_a, self.right[a], a), np.where(cut_a, b, self.left[b])
            going = ~(across | done)
            live, a, b, limit = live[going], a[going], b[going], limit[going]
        return good

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and symbol of every place of every piece in the text's codes."""
        padded = np.concatenate((text, np.zeros(self.longest, np.uint16))).astype(">u2")
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(text)])
        bytes_ = windows.view(np.uint8).reshape(len(text), -1)
        wide = np.zeros((len(text), -(-bytes_.shape[1] // 8) * 8), np.uint8)
        wide[:, : bytes_.shape[1]] = bytes_
        keys = wide.view(">u8").astype(np.uint64)
        suffixes = np.lexsort(keys.T[::-1])
        array = windows.view(f"S{2 * self.longest}").ravel()[suffixes]
        first, last = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        counts = np.maximum(last - first, 0)
        symbol = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        return suffixes[place], symbol

    def _encode(self, words: list[str]) -> None:
        """Adds words to the known ones."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        codes = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.append(self.table[codes], np.uint16(0))
        text[starts + lengths] = 0
        start, symbol = self._edges(text)
        if self.v.merges:
            keep = self.whole[symbol]
            start, symbol = start[keep], symbol[keep]
        owner = np.repeat(np.arange(len(words)), lengths + 1)[start]
        stop = start + self.lengths[symbol]
        n = len(text) + 1
        # The symbol that ends at a place, and where it starts; -1: a character without a piece.
        last, back, best = np.full(n, -1, np.int64), np.arange(n) - 1, np.full(n, -np.inf)
        best[starts] = 0
        unknown_score = float(self.v.scores[self.v.plain].min() if self.v.plain.any() else 0) - 10
        offset = stop - starts[owner]
        # Edges with the same end need no order among them; short keys sort by radix.
        order = np.argsort(offset.astype(np.uint16) if lengths.max() < 1 << 16 else offset, kind="stable")
        start, symbol, stop, owner, offset = (x[order] for x in (start, symbol, stop, owner, offset))
        at_start = np.zeros(n, bool)
        at_start[starts] = True
        in_step = lengths[owner] <= IN_STEP
        if self.v.merges:
            s, y, e, o = (x[in_step] for x in (start, symbol, stop, offset))
            bounds = np.searchsorted(o, np.arange(1, (o.max() if len(o) else 0) + 2))
            for a, b in zip(bounds, bounds[1:], strict=False):
                before = np.where(at_start[s[a:b]], -1, last[s[a:b]])
                good = self._follows(before, y[a:b])
                last[e[a:b][good]], back[e[a:b][good]] = y[a:b][good], s[a:b][good]
            follows = lru_cache(100_000)(lambda x, z: bool(self._follows(np.array([x]), np.array([z]))[0]))
            for a, y, e in zip(start[~in_step].tolist(), symbol[~in_step].tolist(), stop[~in_step].tolist(), strict=True):
                if at_start[a] or last[a] < 0 or follows(int(last[a]), y):
                    last[e], back[e] = y, a
        else:
            self._best_paths(text, starts, lengths, start, symbol, stop, last, back, best, unknown_score)
        self._take(words, codes, starts, lengths, last, back)

    def _best_paths(self, text, starts, lengths, start, symbol, stop, last, back, best, unknown_score) -> None:
        by_stop = np.argsort(stop, kind="stable")
        edges = zip(start[by_stop].tolist(), symbol[by_stop].tolist(), stop[by_stop].tolist(), strict=True)
        edge = next(edges, None)
        for begin, length in zip(starts.tolist(), lengths.tolist(), strict=True):
            for end in range(begin + 1, begin + length + 1):
                best[end], back[end] = best[end - 1] + unknown_score, end - 1
                while edge is not None and edge[2] == end:
                    score = best[edge[0]] + self.score[edge[1]]
                    if score > best[end]:
                        best[end], back[end], last[end] = score, edge[0], edge[1]
                    edge = next(edges, None)

    def _take(self, words, text_codes, starts, lengths, last, back) -> None:
        """Follows the last pieces back and stores the ids."""
        place, floor, found = starts + lengths, starts, []
        live = np.flatnonzero(place > floor)
        while len(live):
            end = place[live]
            found.append((live, last[end], end))
            place[live] = back[end]
            live = live[place[live] > floor[live]]
        if found:
            owner, symbol, end = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((end, owner))
            owner, symbol, end = owner[order], symbol[order], end[order]
        else:
            owner = symbol = end = np.zeros(0, np.int64)
        ids = np.where(symbol >= 0, self.ids[symbol], -1)
        missing = ids < 0
        if self.v.byte_ids:  # a character without a piece becomes its bytes
            codes = text_codes[end[missing] - 1]
            kinds, which = np.unique(codes, return_inverse=True)
            spelt = [[self.v.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
            widths = np.ones(len(ids), np.int64)
            widths[missing] = np.array([len(x) for x in spelt], np.int64)[which]
            first, at = np.cumsum(widths) - widths, np.flatnonzero(missing)
            ids, owner = np.repeat(ids, widths), np.repeat(owner, widths)
            for k, some in enumerate(spelt):
                for n, i in enumerate(some):
                    ids[first[at[which == k]] + n] = i
        else:  # a run of them is one unknown
            again = missing & np.concatenate(([False], missing[:-1] & (owner[1:] == owner[:-1])))
            ids, owner = np.where(missing, self.v.unknown, ids)[~again], owner[~again]
        counts = np.bincount(owner, minlength=len(words))
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.pool.append(ids.astype(np.uint32))
        self.ends.append(self.ends[-1][-1] + np.cumsum(counts))

    def _learn(self, words: list[str]) -> None:
        new, size = [], 0
        for word in words:
            if word not in self.known:
                new.append(word)
                size += len(word) + 1
                if size >= INDEXED:
                    self._encode(new)
                    new, size = [], 0
        if new:
            self._encode(new)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        spelt = pa.array([self.normalize(t) for t in texts], pa.string())
        # Words are told by single blanks before them; other texts are cut by a pattern.
        odd = pc.match_substring_regex(spelt, f"^[^{BLANK}]|^$|{BLANK}{BLANK}|{BLANK}$").to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        plain = pc.utf8_slice_codeunits(spelt.take(pa.array(np.flatnonzero(~odd))), 1)
        lists = pc.split_pattern(plain, BLANK)
        values = lists.flatten().dictionary_encode()
        words = [BLANK + w for w in values.dictionary.to_pylist()]
        others = [re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", s) if self.by_words else [s] * bool(s) for s in spelt.take(pa.array(np.flatnonzero(odd))).to_pylist()]
        self._learn(words)
        self._learn(list(dict.fromkeys(w for some in others for w in some)))
        self.pool, self.ends = [np.concatenate(self.pool or [np.zeros(0, np.uint32)])], [np.concatenate(self.ends)]
        pool, ends = self.pool[0], self.ends[0]
        row = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        which = [row[values.indices.to_numpy()]] + [np.array([self.known[w] for w in some], np.int64) for some in others]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd], sizes[odd] = np.diff(lists.offsets.to_numpy()), [len(some) for some in others]
        which = np.concatenate(which)
        each = ends[which + 1] - ends[which]
        stops = np.cumsum(each)
        flat = pool[np.arange(stops[-1] if len(stops) else 0) + np.repeat(ends[which] - (stops - each), each)]
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        cuts = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(sizes[order])))]
        out = [np.zeros(0, np.uint32)] * len(texts)
        for k, a, b in zip(order, cuts[:-1], cuts[1:], strict=True):
            out[k] = flat[a:b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        out, pending, pieces = [], bytearray(), self.v.pieces
        byte_of = {i: b for b, i in enumerate(self.v.byte_ids or [])}
        for i in ids.tolist():
            if i in byte_of:
                pending.append(byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(" ⁇ " if i == self.v.unknown else pieces[i] if self.v.plain[i] else "")
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        said = "".join(out).replace(BLANK, " ")
        return said[1:] if said.startswith(" ") else said


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One per worker process and model."""
    key = zlib.crc32(vocabulary.model)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int>, text: the ids and what they decode to, for every row of ``docs``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = encoder(vocabulary.value)
        for batch in batches:
            for at, stop in portions(batch.column(1)):
                some = batch.slice(at, stop - at)
                ids = with_ids.batch([t.as_py() or "" for t in some.column(1)])
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids or [[]]).astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of encoded documents (doc_id, ids); null ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(model))
    out = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = encoder(vocabulary.value)
        for batch in batches:
            texts = [with_ids.decode(np.array(ids.as_py() or [], np.int64)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=out.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, out)


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32, round_trip: ids in both directions, for every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_chars", "n_ids", "ids_crc32")] + [T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = encoder(vocabulary.value)
        for batch in batches:
            for at, stop in portions(batch.column(1)):
                some = batch.slice(at, stop - at)
                texts = [t.as_py() or "" for t in some.column(1)]
                ids = with_ids.batch(texts)
                columns = [list(map(len, texts)), list(map(len, ids)), [zlib.crc32(i.tobytes()) for i in ids]]
                same = [with_ids.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(same, pa.bool_())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)
