"""The structure of JSON files of any size, read split by split.

A file is read in splits that begin behind a comma. What a split does to the reader's state is a
function that composes: it ends some containers that were open before it, opens others, and may
begin or end inside a string. Every split is therefore scanned by itself, from an unknown place,
and its nodes are counted by paths relative to the container it began in, or to one of those
around that. Composed from split to split, the states then say what that container is, and the
counts get their full paths. One value of any size is worked on by as many tasks as it has splits,
and what is shuffled is one state and a few counts per split.

Whether a split begins inside a string is told beforehand by the quotes before it.

A value is checked while it is scanned; a file counts only if all its splits fit together to
exactly one JSON value. Names that an object repeats are counted each time. Depth is not limited.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeloom.session import cut, earlier_totals, small_side

# --- quotes and brackets of pieces --------------------------------------------------------


def _net(texts: pa.Array) -> np.ndarray:
    """Brackets opened less brackets closed."""
    opened, closed = (pc.add(pc.count_substring(texts, a), pc.count_substring(texts, b)) for a, b in ("[{", "]}"))
    return pc.subtract(opened, closed).to_numpy(zero_copy_only=False).astype(np.int64)


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its quotes, and its net depth if it begins outside or inside of a string."""
    if pc.any(pc.match_substring(texts, "\\")).as_py():
        texts = pc.replace_substring_regex(texts, r"(?s)\\.", "")
    quotes = pc.count_substring(texts, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    total = _net(texts)
    plain = _net(pc.replace_substring_regex(texts, r'"[^"]*(?:"|$)', "")) if quotes.any() else total
    return quotes, plain, total - plain


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Stretches of rows of one split: file, block, first row, row behind the last."""
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield files.dictionary[int(codes[a])].as_py(), int(blocks[a]), int(a), int(b)


def split_starts(pieces: DataFrame) -> DataFrame:
    """``file, block, starts_in_string, start_depth`` of every split of ``text_lines(separator=",")``."""

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parity: dict[tuple[str, int], int] = {}
        for batch in batches:
            quotes, plain, quoted = measures(pc.fill_null(batch.column(2), ""))
            rows = []
            for file, block, a, b in runs(batch):
                before = (np.cumsum(quotes[a:b]) - quotes[a:b] + parity.get((file, block), 0)) % 2 == 1
                net0, net1 = (int(np.where(before, x[a:b], y[a:b]).sum()) for x, y in ((quoted, plain), (plain, quoted)))
                parity = {(file, block): int(parity.get((file, block), 0) + quotes[a:b].sum()) % 2}
                rows.append((file, block, int(quotes[a:b].sum()), net0, net1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "block", "quotes", "net0", "net1"]) if rows else _none(_MOVES)

    moved = pieces.select("file", "block", "text").mapInArrow(transitions, _MOVES)
    totals = moved.groupBy("file", "block").agg(*(F.sum(c).alias(c) for c in ("quotes", "net0", "net1")))
    told = earlier_totals(totals, "file", ["block"], {"quotes": "quotes_before"})
    inside = F.col("quotes_before") % 2 == 1
    told = told.select("file", "block", inside.alias("starts_in_string"), F.when(inside, F.col("net1")).otherwise(F.col("net0")).alias("net"))
    return earlier_totals(told, "file", ["block"], {"net": "start_depth"}).drop("net")


_MOVES = T.StructType([T.StructField("file", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("block", "quotes", "net0", "net1")]])


def _none(schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist([], schema=to_arrow_schema(schema))


def with_start(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Bring a split's start to its pieces. Splits are cut the same way each time files are read
    (``configure`` pins what decides it); should they not meet, no row may get lost silently."""
    missing = F.raise_error(F.lit("the splits of a file changed between two reads"))
    return pieces.join(small_side(starts), ["file", "block"], "left").withColumn(
        "start_depth", F.coalesce("start_depth", missing.cast("long"))
    )


# --- elements of arrays -------------------------------------------------------------------

_PARTS = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ends", T.BooleanType()), T.StructField("begins", T.BooleanType())]
)


def array_parts(pieces: DataFrame) -> DataFrame:
    """Pieces put together, split by split, at the commas that separate elements of an array.

    ``file, block, place, text, ends, begins``: the parts of a split in order, ``place`` from 0.
    A comma ends the part (``ends``); the part begins with its element (``begins``), unless it is
    the first of a split that began inside of one. Pieces come in order and stay in their task.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None  # the split at work; inside a string, depth, place, begins, open texts

        def rest() -> list[tuple]:
            return [(*at, state[2], ",".join(state[4]), False, state[3])] if state and state[4] else []

        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            quotes, plain, quoted = measures(texts)
            told, inside, depth = texts.to_pylist(), batch.column(3), batch.column(4)
            rows: list[tuple] = []
            for file, block, a, b in runs(batch):
                if (file, block) != at:
                    rows += rest()
                    at = (file, block)
                    starts_inside, starts_at = inside[a].as_py(), depth[a].as_py()
                    state = [int(starts_inside), starts_at, 0, block == 0 or (starts_at == 1 and not starts_inside), []]
                parity = np.cumsum(quotes[a:b]) + state[0]
                before = (parity - quotes[a:b]) % 2 == 1
                depths = np.cumsum(np.where(before, quoted[a:b], plain[a:b])) + state[1]
                ends = np.flatnonzero((parity % 2 == 0) & (depths == 1)) + a + 1
                first = a
                for stop in ends.tolist():
                    rows.append((*at, state[2], ",".join([*state[4], *told[first:stop]]), True, state[3]))
                    state[2:] = [state[2] + 1, True, []]
                    first = stop
                state[0], state[1] = int(parity[-1]) % 2, int(depths[-1])
                state[4].extend(told[first:b])
            yield _rows(rows, _PARTS)
        if at:
            yield _rows(rest(), _PARTS)

    return pieces.select("file", "block", "text", "starts_in_string", "start_depth").mapInArrow(fold, _PARTS)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    if not rows:
        return _none(schema)
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


# --- nodes of any value -------------------------------------------------------------------

_BODY = r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+'
_TOKEN = re.compile(
    rf'[ \t\n\r]*+(?:([{{}}\[\],:])|"({_BODY})(")?|(-?(?:0|[1-9][0-9]*+)(\.[0-9]++)?([eE][+-]?[0-9]++)?)|(true|false|null)|(\Z)|(?s:.))'
)
_REST = re.compile(rf'({_BODY})(")?')
_WORDS = {"true": "boolean", "false": "boolean", "null": "null"}
# Digits of a whole number beyond which it counts as a number, as in the engine's values.
_LONGEST_INTEGER = 38
# Characters of a name's beginning that a split hands on to the next one.
_LONGEST_NAME = 1_000_000
_ANY, _VALUE, _VALUE_OR_END, _KEY, _KEY_OR_END, _COLON, _AFTER, _MAYBE_COLON, _DONE = range(9)


class NotJson(ValueError):
    pass


def _step(raw: str) -> str:
    """The step for a member, from its name as written."""
    name = json.loads(f'"{raw}"') if "\\" in raw else raw
    return "." + name.replace("~", "~0").replace(".", "~1").replace("[", "~2")


class SplitScan:
    """Follows the tokens of one split. Paths are relative to container ``level``: 0 the one the
    split began in, 1 the one around it, and so on."""

    def __init__(self, first: bool, in_string: bool):
        self.first = first
        self.counts: dict[tuple[int, bool, str, str], int] = {}
        self.open: list[tuple[str, int, bool, str]] = []  # sign, level, carried, path of containers begun here
        self.ended = ""  # signs of the containers from before that end here
        self.seen = [""]  # by level: "," entries follow, "{" or "[" what the container is
        self.state = _VALUE if first else _ANY
        self.member: tuple[int, bool, str] | None = None  # place of a member's value
        self.string: list[str] | None = [] if in_string else None
        self.role = "head" if in_string else ""
        self.head, self.head_is = "", "inside" if in_string else ""  # the rest of a string from before
        self.pending = ""

    # places

    def _level(self) -> int:
        return len(self.ended)

    def _container(self) -> tuple[str, int, bool, str]:
        return self.open[-1] if self.open else (self.seen[-1], self._level(), False, "")

    def _told(self, sign: str) -> None:
        """At this place, the container is of a kind."""
        if not self.open:
            if self.seen[-1] in ("{", "[") and self.seen[-1] != sign:
                raise NotJson
            self.seen[-1] = sign

    def _target(self) -> tuple[int, bool, str]:
        if self.member is not None:
            place, self.member = self.member, None
            return place
        if self.first and not self.open:
            return 0, False, ""
        _, level, carried, path = self._container()
        return level, carried, path + "[]"

    def _count(self, place: tuple[int, bool, str], kind: str) -> None:
        key = (*place, kind)
        self.counts[key] = self.counts.get(key, 0) + 1

    def _complete(self) -> None:
        self.state = _DONE if self.first and not self.open else _AFTER

    # tokens

    def _begin_value(self) -> tuple[int, bool, str]:
        if self.state == _ANY:
            self._told("[")
        elif self.state not in (_VALUE, _VALUE_OR_END):
            raise NotJson
        return self._target()

    def _sign(self, sign: str) -> None:
        if sign in "{[":
            place = self._begin_value()
            self._count(place, "object" if sign == "{" else "array")
            self.open.append((sign, *place))
            self.state = _KEY_OR_END if sign == "{" else _VALUE_OR_END
        elif sign == ":":
            if self.state == _MAYBE_COLON:
                self._told("{")
                if self.role == "head":
                    self.head_is, self.role = "name", ""
                    self.member = (self._level(), True, "")
                else:
                    self.member = (self._level(), False, _step(self.pending))
            elif self.state != _COLON:
                raise NotJson
            self.state = _VALUE
        else:
            if self.state == _MAYBE_COLON:
                self._no_name()
            opener = {"}": "{", "]": "["}.get(sign)
            if opener is None:
                self._comma()
            elif self.open:
                if self.open[-1][0] != opener or self.state not in (_AFTER, _KEY_OR_END if sign == "}" else _VALUE_OR_END):
                    raise NotJson
                self.open.pop()
                self._complete()
            else:
                if self.first or self.state != _AFTER:
                    raise NotJson
                self._told(opener)
                self.ended += opener
                self.seen.append("")

    def _comma(self) -> None:
        if self.state != _AFTER:
            raise NotJson
        if not self.open and not self.seen[-1]:
            self.seen[-1] = ","
        self.state = {"{": _KEY, "[": _VALUE}.get(self._container()[0], _ANY)

    def _no_name(self) -> None:
        """The string just read is no name: an entry of an array, or the rest of a value."""
        if self.role == "head":
            self.head_is, self.role = "value", ""
        else:
            self._told("[")
            self._count(self._target(), "string")
        self.state = _AFTER

    def _string(self, raw: str, closed: bool) -> None:
        if self.state in (_KEY, _KEY_OR_END):
            self.role = "name"
        elif self.state == _ANY:
            self.role = "either"
        else:
            self._count(self._begin_value(), "string")
            self.role = "value"
        self.string = [raw]
        if closed:
            self._string_ends()

    def _string_ends(self) -> None:
        raw, self.string = "".join(self.string), None
        if self.role == "name":
            _, level, carried, path = self._container()
            self.member, self.state = (level, carried, path + _step(raw)), _COLON
        elif self.role == "value":
            self._complete()
        else:
            self.pending, self.state = raw, _MAYBE_COLON
            if self.role == "head":
                self.head, self.head_is = raw, "value"

    def feed(self, text: str) -> None:
        """The next piece of text; pieces are joined by commas already."""
        at = 0
        if self.string is not None:
            found = _REST.match(text)
            if self.role != "value":
                self.string.append(found[1])
            if not found[2]:
                if found.end() < len(text):
                    raise NotJson
                return
            at = found.end()
            self._string_ends()
        while at < len(text):
            token = _TOKEN.match(text, at)
            at, kind = token.end(), token.lastindex
            if kind == 1:
                self._sign(token[1])
            elif token[2] is not None:
                if not token[3] and at < len(text):
                    raise NotJson
                self._string(token[2], bool(token[3]))
            elif token[4] is not None:
                whole = token[5] is None and token[6] is None and len(token[4].lstrip("-")) <= _LONGEST_INTEGER
                self._count(self._begin_value(), "integer" if whole else "number")
                self._complete()
            elif token[7] is not None:
                self._count(self._begin_value(), _WORDS[token[7]])
                self._complete()
            elif token[8] is None:
                raise NotJson

    def finish(self) -> dict:
        """The split's state, once all of it was fed."""
        if self.string is None and self.state == _MAYBE_COLON:
            self._no_name()
        if self.string is None and self.state not in (_AFTER, _DONE):
            raise NotJson
        tail = "".join(self.string) if self.string is not None and self.role != "value" else ""
        return {
            "fits": True,
            "ended": self.ended,
            "seen": self.seen,
            "open": [{"sign": s, "level": level, "carried": c, "path": p} for s, level, c, p in self.open],
            "head": self.head if self.head_is == "name" else "",
            "head_is": self.head_is,
            "tail": tail[:_LONGEST_NAME],
            "tail_cut": len(tail) > _LONGEST_NAME,
            "tail_role": self.role if self.string is not None else "",
        }


_STATE = T.StructType(
    [
        T.StructField("fits", T.BooleanType()),
        T.StructField("ended", T.StringType()),
        T.StructField("seen", T.ArrayType(T.StringType())),
        T.StructField("open", T.ArrayType(T.StructType([T.StructField("sign", T.StringType()), T.StructField("level", T.LongType()), T.StructField("carried", T.BooleanType()), T.StructField("path", T.StringType())]))),
        T.StructField("head", T.StringType()),
        T.StructField("head_is", T.StringType()),
        T.StructField("tail", T.StringType()),
        T.StructField("tail_cut", T.BooleanType()),
        T.StructField("tail_role", T.StringType()),
    ]
)
_SCANNED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("state", _STATE),
        T.StructField("level", T.LongType()),
        T.StructField("carried", T.BooleanType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def scan_splits(pieces: DataFrame) -> DataFrame:
    """A row with the ``state`` of each split, and rows with its counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scan = None, None

        def done() -> list[tuple]:
            if at is None:
                return []
            try:
                state = scan.finish() if scan else None
            except NotJson:
                state = None
            if state is None:
                return [(*at, {"fits": False}, None, None, None, None, None)]
            return [(*at, state, None, None, None, None, None), *((*at, None, *key, n) for key, n in scan.counts.items())]

        for batch in batches:
            told, inside = pc.fill_null(batch.column(2), "").to_pylist(), batch.column(3)
            rows: list[tuple] = []
            for file, block, a, b in runs(batch):
                text = ",".join(told[a:b])
                if (file, block) == at:
                    text = "," + text
                else:
                    rows += done()
                    at, scan = (file, block), SplitScan(block == 0, inside[a].as_py())
                if scan is not None:
                    try:
                        scan.feed(text)
                    except NotJson:
                        scan = None
            yield _rows(rows, _SCANNED)
        yield _rows(done(), _SCANNED)

    return pieces.select("file", "block", "text", "starts_in_string").mapInArrow(work, _SCANNED)


_PLACED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("fits", T.BooleanType()),
        T.StructField("bases", T.ArrayType(T.StringType())),
        T.StructField("carried_step", T.StringType()),
        T.StructField("entry", T.StringType()),
    ]
)


def composed(states: list[tuple[int, dict]]) -> list[tuple[int, list[str], str, str | None]] | None:
    """The places the splits of a file began in: block, paths of the containers around its start
    (the innermost first), the step of a name that ends there, and the path of an array's string
    that ends there. None if the splits do not fit together to one value."""
    stack: list[tuple[str, str]] = []  # sign and path of the open containers
    role, name = "", ""
    out = []
    for k, (block, s) in enumerate(states):
        last = k == len(states) - 1
        if not s["fits"] or (role != "") != (s["head_is"] != ""):
            return None
        if k and not role and not stack:
            return None  # a comma behind the value
        kinds, step, entry = s["seen"], "", None
        if role:
            if s["head_is"] == "name":
                if role == "value" or name is None:
                    return None
                try:
                    step = _step(name + "," + s["head"])
                except ValueError:
                    return None
            elif s["head_is"] == "value":
                if role == "name":
                    return None
                if role == "either":
                    if not stack or stack[-1][0] != "[":
                        return None
                    entry = stack[-1][1] + "[]"
        for level, sign in enumerate(kinds):
            if sign and (level >= len(stack) or (sign != "," and stack[-1 - level][0] != sign)):
                return None
        bases = [path for _, path in reversed(stack)][: len(kinds)]
        out.append((block, bases, step, entry))
        stack = stack[: len(stack) - len(s["ended"])]
        stack += [(o["sign"], (bases[o["level"]] if o["level"] < len(bases) else "") + (step if o["carried"] else "") + o["path"]) for o in s["open"]]
        if s["head_is"] == "inside":  # the string goes on
            name = None if name is None or s["tail_cut"] else name + "," + s["tail"]
        else:
            role, name = s["tail_role"], None if s["tail_cut"] else s["tail"]
        if last and (stack or role):
            return None
    return out


def structure_counts(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node counts ``dataset, file, path, kind, n`` of files that are one JSON value each, and
    ``dataset, file, fits`` of every file. ``pieces`` are those of ``text_lines(separator=",")``."""
    starts = split_starts(pieces)
    datasets = cut(pieces.groupBy("file").agg(F.first("dataset").alias("dataset"), F.sum(F.octet_length("text") + 1).alias("bytes"), F.max("size").alias("size")))
    # A comma at a file's very end ends its last piece and shows in the length only.
    datasets = datasets.select("file", "dataset", (F.col("bytes") == F.col("size")).alias("comma_ends"))
    scanned = cut(scan_splits(with_start(pieces, starts)))

    def place(table: pa.Table) -> pa.Table:
        rows = sorted(((r["block"], r["state"]) for r in table.to_pylist()), key=lambda r: r[0])
        file, found = table["file"][0].as_py(), composed(rows)
        if found is None:
            return pa.Table.from_batches([_rows([(file, rows[0][0], False, None, None, None)], _PLACED)])
        return pa.Table.from_batches([_rows([(file, block, True, bases, step, entry) for block, bases, step, entry in found], _PLACED)])

    placed = cut(scanned.filter(F.col("state").isNotNull()).select("file", "block", "state").groupBy("file").applyInArrow(place, _PLACED))
    files = placed.groupBy("file").agg(F.every("fits").alias("fits")).join(small_side(datasets), "file")
    files = cut(files.select("dataset", "file", (F.col("fits") & ~F.col("comma_ends")).alias("fits")))
    sound = small_side(files.filter("fits").select("dataset", "file"))
    base = F.coalesce(F.get("bases", F.col("level").cast("int")), F.lit(""))
    path = F.concat(base, F.when(F.col("carried"), F.col("carried_step")).otherwise(""), F.col("path"))
    counts = scanned.filter(F.col("state").isNull()).join(small_side(placed.filter("fits").drop("fits")), ["file", "block"])
    entries = placed.filter(F.col("entry").isNotNull()).select("file", F.col("entry").alias("path"), F.lit("string").alias("kind"), F.lit(1).cast("long").alias("n"))
    nodes = counts.select("file", path.alias("path"), "kind", "n").unionByName(entries)
    return nodes.join(sound, "file").select("dataset", "file", "path", "kind", "n"), files


def counted(nodes: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Counts per path and kind as ``path_counts`` gives them."""

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    return nodes.groupBy(*keys, "path").agg(F.sum("n").alias("nodes"), *(of(kind).alias(f"n_{kind}") for kind in kinds))
