"""Repair of conversations by weighted interval parsing (CYK) of their turns.

A conversation should read, in initials of roles, ``(s?(ua)+)?``. Its turns are parsed with the
edits keep, change the role, delete and insert. The grammar is in Chomsky normal form: ``X[p,q]``
stands for the output that leads from place p of the pattern to place q (0 the start, 1 behind s,
2 behind u, 3 behind a); ``X[p,q] -> X[p,r] X[r,q]`` joins two neighbouring spans of turns, and
``X[p,q]`` over one turn is one of the edits of that turn. A cell holds, for a span, the least
(cost, audit) of each ``X[p,q]``, the audit being the initials of the edits. Empty spans derive
insertions only; that closure is multiplied to both sides of every single turn, so that insertions
are in all longer spans without further ado. Since the places between two spans are named in the
rule, any one cut of a span gives all its derivations: spans are joined bottom-up by their
length, 1, 2, 4 and so on, each once, and spans of different tasks join in the same way. Of audits
of equal cost none is the beginning of another, so that the least audit of a span is made of the
least ones of its parts.

Conversations are gathered by conv_id, sorted, and parsed as they stream by. Those of more than
``LONG_ROWS`` turns or ``LONG_BYTES`` of text are dealt out by ranges of turns: every task parses
its turns to one cell, cells are joined, and repeated turns are told by an aggregate over hashes.
Only the hash of such a conversation's repaired text is made in one stream, as SHA-256 demands,
with one batch in memory.

Defined cases: a null id, turn, role or text reads as one space in the key of the damage, and a
null role or text is one space from then on; conversations with a null conv_id are one. Rows are
ordered by turn (nulls first), then role, then text, both as damaged; equal rows are repeated
turns. A role's initial is its first character, none for an empty role; roles of other initials
than s, u and a cannot be kept. A conversation without rows after damage has zeros, an empty audit
and the hash of the empty string. Extra columns, whatever their names, are ignored. A table
without rows gives none. An audit is one value: conversations of over a billion turns have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lookup, released, stored

BLANK = r"[^\x20\x09-\x0D]"  # what a turn must hold
UNFINISHED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"  # ends without a closing mark
# Conversations beyond either of these are parsed by ranges of turns.
LONG_ROWS = 2_000
LONG_BYTES = 8_000_000


@dataclass(frozen=True)
class Costs:
    change: int = 1
    delete: int = 2
    insert: int = 5
    unfinished: int = 5  # a truncated turn that is not deleted


# The places of the pattern and the steps between them, by initial.
PLACES = range(4)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}

Cell = dict  # (p, q) -> (cost, audit)


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (cost2, audit2) in right.items():
            if r == r2:
                total = cost + cost2
                known = out.get((p, q))
                if known is None or total < known[0]:
                    out[p, q] = (total, audit + audit2)
                elif total == known[0]:
                    out[p, q] = min(known, (total, audit + audit2))
    return out


class Grammar:
    """The edits of a single turn with the insertions around them."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        empty: Cell = {(p, p): (0, "") for p in PLACES}
        step: Cell = dict(empty)
        for role in "ua":
            step |= {(p, q): (costs.insert, "I") for p, q in STEPS[role].items()}
        # Insertions that lead from any place to any other: closed once nothing changes.
        self.empty = joined(step, step)
        while (more := joined(self.empty, step)) != self.empty:
            self.empty = more
        self._turns: dict[tuple[str, int], Cell] = {}

    def turn(self, initial: str, fault: int) -> Cell:
        """fault: 0 none, 1 blank, 2 repeated, 3 truncated."""
        key = (initial if initial in STEPS else "", fault)
        if key not in self._turns:
            costs = self.costs
            cell: Cell = {(p, p): (costs.delete, "D") for p in PLACES}
            if fault in (0, 3):
                more = costs.unfinished if fault == 3 else 0
                for role in "ua":
                    cell |= {(p, q): (costs.change + more, "R") for p, q in STEPS[role].items()}
                cell |= {(p, q): (more, "K") for p, q in STEPS.get(key[0], {}).items()}
            self._turns[key] = joined(joined(self.empty, cell), self.empty)
        return self._turns[key]

    def parse(self, cells: list[Cell]) -> Cell:
        """The cell of a whole row of spans, by rising length."""
        while len(cells) > 1:
            pairs = [joined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
            cells = pairs + cells[len(pairs) * 2 :]
        return cells[0] if cells else self.empty

    def best(self, cell: Cell) -> tuple[int, str]:
        """The least cost and audit of a whole conversation."""
        return min(cell[0, q] for q in ENDS if (0, q) in cell)


class Rewriter:
    """Applies an audit to turns as they come and hashes the lines of the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.hash, self.lines = hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.place = STEPS[role[0]][self.place]

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(NEXT_ROLE[self.place], "")

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text)
        elif edit == "R":
            self._put(NEXT_ROLE[self.place], text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def damaged(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, there (false: the row is gone) after the stated damage."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat(said(conv), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(lot.isin(0, 1), "").when(lot == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(lot == 4, "user").otherwise(said("role"))
    return rows.select(
        F.col(conv).alias("conv_id"),
        F.explode(F.when(lot == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(lot != 0))).alias("there"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds fault: 1 blank, 3 truncated, else 0; repeated turns are told later."""
    fault = F.when(~F.col("text").rlike(BLANK), 1).when(F.col("text").rlike(UNFINISHED), 3).otherwise(0)
    return rows.withColumn("fault", fault.cast("int"))


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _result(conv: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("conv_id", conv), *[T.StructField(c, T.LongType()) for c in _RESULT], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )


class Tally:
    """What is counted over consecutive turns; two tallies of neighbouring spans can be added."""

    LEGAL = ("su", "ua", "au")

    def __init__(self):
        self.rows = self.distinct = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.first = self.last = None  # initials
        self.least = self.most = None  # turns

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.rows:
            self.illegal += self.last + initial not in self.LEGAL
        else:
            self.first = initial
        self.rows, self.last = self.rows + 1, initial
        self.faults[fault] += 1
        if turn is not None:
            if self.most is None or turn != self.most:
                self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def values(self) -> list[int]:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return [gaps, self.faults[1], self.faults[2], self.faults[3], self.illegal]


def _parsed(conv, rows: list[tuple], grammar: Grammar) -> tuple:
    """The result of a whole conversation; rows are (turn, role, text, fault)."""
    tally, cells, seen = Tally(), [], set()
    for turn, role, text, fault in rows:
        if fault != 1 and (role, text) in seen:
            fault = 2
        seen.add((role, text))
        tally.add(turn, role[:1], fault)
        cells.append(grammar.turn(role[:1], fault))
    cost, audit = grammar.best(grammar.parse(cells))
    rewriter = Rewriter(audit)
    for _, role, text, _ in rows:
        rewriter.turn(role, text)
    return (conv, *tally.values(), cost, audit, rewriter.digest())


_ORDER = ["conv_id", "turn", "role", "text"]  # nulls first


def _short(rows: DataFrame, costs: Costs) -> DataFrame:
    """Conversations that fit a task's memory, streamed in order."""
    out = _result(rows.schema["conv_id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, conv, turns, done, begun = Grammar(costs), None, [], [], False
        for batch in released(batches):
            for key, there, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and key != conv:
                    done.append(_parsed(conv, turns, grammar))
                    turns = []
                conv, begun = key, True
                if there:
                    turns.append(tuple(row))
            yield _batch(done, out)
            done = []
        if begun:
            yield _batch([_parsed(conv, turns, grammar)], out)

    rows = rows.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return rows.select("conv_id", "there", "turn", "role", "text", "fault").mapInArrow(work, out)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


_CELL = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def _span_schema(conv: T.DataType) -> T.StructType:
    longs = ["part", "rows", "blank", "duplicate", "truncated", "illegal"]
    return T.StructType([T.StructField("conv_id", conv), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("cell", _CELL)])


def _spans(rows: DataFrame, costs: Costs) -> DataFrame:
    """One row for each conversation and range of turns: its counts and its cell.

    ``rows`` tells repeats of an earlier turn number; those of the row just before are seen here.
    """
    out = _span_schema(rows.schema["conv_id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, grammar = TaskContext.get().partitionId(), Grammar(costs)
        conv, begun, before, tally = None, False, None, Tally()
        heights: list[tuple[int, Cell]] = []  # spans of 2 to the height turns, falling

        def push(cell: Cell) -> None:
            height = 0
            while heights and heights[-1][0] == height:
                cell, height = joined(heights.pop()[1], cell), height + 1
            heights.append((height, cell))

        def span() -> tuple:
            cell = None
            for _, left in reversed(heights):
                cell = left if cell is None else joined(left, cell)
            told = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]
            return (conv, part, tally.rows, *tally.values()[1:], tally.first, tally.last, told)

        for batch in released(batches):
            done = []
            for key, turn, role, digest, fault, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and key != conv:
                    done.append(span())
                    heights.clear()
                    before, tally = None, Tally()
                conv, begun = key, True
                if fault != 1 and (repeated or (turn, role, digest) == before):
                    fault = 2
                before = (turn, role, digest)
                tally.add(None, role[:1], fault)
                push(grammar.turn(role[:1], fault))
            yield _batch(done, out)
        if begun:
            yield _batch([span()], out)

    return rows.mapInArrow(work, out)


def _long(rows: DataFrame, costs: Costs) -> DataFrame:
    """Conversations of any length, dealt out by ranges of turns."""
    conv = rows.schema["conv_id"].dataType
    rows = stored(rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "long-conversations")
    present = rows.where("there")
    # A turn is repeated if its role and text stand under an earlier turn number.
    firsts = present.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    firsts = lookup(firsts.select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), F.col("first.turn").alias("first_turn")), "first-turns")
    told = present.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")))
    # Ranges follow the order of rows; the beginning of a text is enough to split turns of one number.
    ranges = ["conv_id", "turn", "role", F.substring("text", 1, 100)]
    told = told.select("conv_id", "turn", "role", "text", "digest", "fault", (~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("repeated"))
    dealt = told.repartitionByRange(*ranges).sortWithinPartitions(*_ORDER)
    spans = stored(_spans(dealt.select("conv_id", "turn", "role", "digest", "fault", "repeated"), costs), "spans")
    turns = rows.groupBy("conv_id").agg(
        F.min(F.when(F.col("there"), F.col("turn"))).alias("least"), F.max(F.when(F.col("there"), F.col("turn"))).alias("most")
    )
    distinct = present.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("of")).agg(F.count("one").alias("distinct_turns"))
    turns = turns.join(distinct, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        F.col("conv_id").alias("of"), F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct_turns"), F.lit(0)).alias("gaps")
    )
    whole_schema = T.StructType([T.StructField("conv_id", conv), *[T.StructField(c, T.LongType()) for c in _RESULT[1:]], T.StructField("audit", T.StringType())])

    def whole(table: pa.Table) -> pa.Table:
        """Join the cells of a conversation's spans: a row for each task that had turns of it."""
        grammar = Grammar(costs)
        found = table.sort_by("part").to_pylist()
        cell = grammar.parse([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cell"]} for s in found])
        counts = [sum(s[c] for s in found) for c in ("blank", "duplicate", "truncated", "illegal")]
        counts[3] += sum(a["last"] + b["first"] not in Tally.LEGAL for a, b in zip(found, found[1:], strict=False))
        cost, audit = grammar.best(cell)
        return pa.Table.from_batches([_batch([(found[0]["conv_id"], *counts, cost, audit)], whole_schema)])

    parsed = stored(spans.groupBy("conv_id").applyInArrow(whole, whole_schema), "parsed")

    # The audit goes ahead of the turns it is for, so that one stream has both.
    hash_schema = T.StructType([T.StructField("of2", conv), T.StructField("repaired_sha256", T.StringType())])
    audits = parsed.select("conv_id", F.lit(0).alias("after"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = audits.unionByName(present.select("conv_id", F.lit(1).alias("after"), "turn", "role", "text"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter, conv_id = None, None
        for batch in released(batches):
            done = []
            for key, after, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if after:
                    rewriter.turn(role, text)
                    continue
                if rewriter:
                    done.append((conv_id, rewriter.digest()))
                conv_id, rewriter = key, Rewriter(text)
            yield _batch(done, hash_schema)
        if rewriter:
            yield _batch([(conv_id, rewriter.digest())], hash_schema)

    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "role", "text")
    hashes = ordered.select("conv_id", "after", "role", "text").mapInArrow(rewrite, hash_schema)
    found = turns.join(parsed, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(hashes, F.col("of").eqNullSafe(F.col("of2")), "left")
    return found.select(
        F.col("of").alias("conv_id"),
        "gaps",
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _RESULT[1:]),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def repair_turns(rows: DataFrame, costs: Costs = Costs(), long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Repair conversations: conv_id, there, turn, role and text in, a row per conversation out.

    Rows with ``there`` false only name a conversation. role and text must not be null.
    """
    bounded_batches(rows.sparkSession)
    rows = with_faults(rows)
    size = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    big = lookup(size.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_id")), "long-ids")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _short(rows.join(big, same, "left_anti"), costs)
    if big.isEmpty():
        return short
    return short.unionByName(_long(rows.join(big, same, "left_semi"), costs))


def repaired(conversations: DataFrame, costs: Costs = Costs(), **limits: int) -> DataFrame:
    """The conversations with the stated damage, repaired."""
    return repair_turns(damaged(conversations), costs, **limits)


SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), drawn AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1),
         lambda i: [ascii(substr(k, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384)), 4294967295::BIGINT) % 20 AS lot
  FROM keyed
), hurt AS (
  SELECT conv_id, turn, rid, copy, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(copy)
), placed AS (
  SELECT *, row_number() OVER turns AS i, lag(left(role, 1)) OVER turns AS before, left(role, 1) AS r,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS nth
  FROM hurt WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy)
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
            WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), edits AS (  -- what a turn allows from place p to place q of the pattern
  SELECT conv_id, i, p, q, cost, sign, said FROM (
    SELECT conv_id, i, p, p AS q, 2 AS cost, 'D' AS sign, '' AS said FROM judged, range(4) AS places(p)
    UNION ALL
    SELECT conv_id, i, p, q, 1 + CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'R', CASE WHEN q = 2 THEN 'user:' ELSE 'assistant:' END || text || chr(10)
    FROM judged, (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) AS steps(p, q) WHERE fault IN (0, 3)
    UNION ALL
    SELECT conv_id, i, p, q, CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'K', role || ':' || text || chr(10)
    FROM judged, (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS steps(initial, p, q) WHERE fault IN (0, 3) AND initial = r
  )
), inserts(p, q, cost, sign, said) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'user:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)),
         (3, 2, 5, 'I', 'user:' || chr(10)), (2, 3, 5, 'I', 'assistant:' || chr(10)), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
         (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), turns AS (
  SELECT conv_id, i, a.p, b.q, min({'cost': a.cost + e.cost + b.cost, 'audit': a.sign || e.sign || b.sign, 'said': a.said || e.said || b.said}) AS v
  FROM edits e JOIN inserts a ON a.q = e.p JOIN inserts b ON b.p = e.q GROUP BY ALL
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, q, {'cost': cost, 'audit': sign, 'said': said} AS v FROM counted, inserts WHERE p = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, t.q, min({'cost': w.v.cost + t.v.cost, 'audit': w.v.audit || t.v.audit, 'said': w.v.said || t.v.said})
  FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 AND t.p = w.q GROUP BY w.conv_id, w.i, t.q
), best AS (
  SELECT w.conv_id, min(v) AS v FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
  WHERE q IN (0, 3) GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.cost, 0)::BIGINT AS cost,
       coalesce(v.audit, '') AS audit, sha256(coalesce(left(v.said, length(v.said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
