import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from shapeloom.llm import repairs

SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("there", "fault", "digest", "audit", "cost", "n", "long_id", "of", "part", "cell")]
)
BLANKS = " \t\n\x0b\x0c\r"


def hurt(rows: list[tuple]) -> dict:
    """The damaged rows of each conversation, in order."""
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        lot = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        if lot == 0:
            continue
        body = "" if lot == 1 else re.sub("[.!?]", "", said[3]) if lot == 2 else said[3]
        own += [(turn, "user" if lot == 4 else said[2], body)] * (2 if lot == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def direct(rows: list[tuple]) -> list[tuple]:
    """Dijkstra-like walk from turn to turn, the whole best list of every place kept."""
    out = []
    for conv, own in hurt(rows).items():
        counts, seen, faults = {1: 0, 2: 0, 3: 0, 0: 0}, set(), []
        for _, role, text in own:
            body = text.strip(BLANKS)
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            faults.append(fault)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
        name = {"u": "user", "a": "assistant"}

        def inserted(best: dict) -> dict:
            for _ in range(3):
                for last, (cost, audit, lines) in list(best.items()):
                    for role in "ua":
                        if (last, role) in step:
                            new = (cost + 5, audit + "I", [*lines, f"{name[role]}:"])
                            best[role] = min(best.get(role, new), new)
            return best

        best = inserted({"": (0, "", [])})
        for (_, role, text), fault in zip(own, faults, strict=True):
            now: dict = {}
            for last, (cost, audit, lines) in best.items():
                edits = [(2, "D", last, lines)]
                if fault in (0, 3):
                    more = 5 if fault == 3 else 0
                    if (last, role[:1]) in step:
                        edits.append((more, "K", role[:1], [*lines, f"{role}:{text}"]))
                    edits += [(more + 1, "R", r, [*lines, f"{name[r]}:{text}"]) for r in "ua" if (last, r) in step]
                for price, sign, end, said in edits:
                    new = (cost + price, audit + sign, said)
                    now[end] = min(now.get(end, new), new)
            best = inserted(now)
        cost, audit, lines = min(best[e] for e in ("", "a") if e in best)
        out.append((conv, gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed: int, n: int = 150) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.choice([1, 2, 5, 9])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No", "Why? ", " ", "", "One. two", "\t\n", "é!\n", None, f"t{turn}.", "日本"])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn * 3]), role, text))
    rows += [(None, t, "user", f"{t}.") for t in range(6)] + [(None, None, None, None), rows[0], rows[0]]
    rows += [(900 + conv, 0, "user", "x") for conv in range(60)]  # some lose their only row
    rnd.shuffle(rows)
    return rows


def table(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], SCHEMA).repartition(4)


def result(df) -> list[tuple]:
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_against_a_direct_walk(spark):
    rows = conversations(1)
    want = direct(rows)
    assert result(repairs.repaired(table(spark, rows))) == want
    assert any("R" in w[7] for w in want) and any("D" in w[7] for w in want) and any(w[7] == "" for w in want)


def test_conversations_dealt_out_by_turns_give_the_same(spark):
    rows = conversations(2, 60)
    want = direct(rows)
    assert result(repairs.repaired(table(spark, rows), long_rows=0)) == want
    assert result(repairs.repaired(table(spark, rows), long_rows=4)) == want
    assert result(repairs.repaired(table(spark, rows), long_bytes=12)) == want


def test_one_long_conversation(spark):
    rnd = random.Random(7)
    said = [f"{k} {'word ' * 20}{rnd.choice('.!?,')}" for k in range(1500)]
    rows = [(7, k, rnd.choice(["user", "assistant"]), rnd.choice([said[k], said[k // 2], said[0]])) for k in range(6000 // 4)]
    want = direct(rows)
    assert result(repairs.repaired(table(spark, rows), long_rows=300)) == want
    assert result(repairs.repaired(table(spark, rows))) == want


def test_turns_all_alike(spark):
    rows = [(k % 2, None, "user", "Same.") for k in range(900)]
    assert result(repairs.repaired(table(spark, rows), long_rows=100)) == direct(rows)


def test_cells_join_in_any_way():
    rnd = random.Random(3)
    grammar = repairs.Grammar()
    for _ in range(60):
        cells = [grammar.turn(rnd.choice("suat"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(1, 12))]
        left = cells[0]
        for cell in cells[1:]:
            left = repairs.joined(left, cell)
        cut = rnd.randint(0, len(cells))
        assert left == grammar.parse(list(cells)) == repairs.joined(grammar.parse(cells[:cut]), grammar.parse(cells[cut:]))


@pytest.mark.parametrize("costs", [repairs.Costs(), repairs.Costs(insert=1, delete=3), repairs.Costs(change=4, delete=1, insert=1, unfinished=0)])
def test_cheapest_of_all_edits(costs):
    """Every list of edits of short conversations, tried out."""
    grammar = repairs.Grammar(costs)
    legal = re.compile("(s?(ua)+)?")
    inserted = 0
    for roles in itertools.chain.from_iterable(itertools.product("suat", repeat=n) for n in range(3)):
        for faults in itertools.product((0, 2, 3), repeat=len(roles)):
            best = None
            for signs in itertools.product(*(["D"] if f == 2 else ["D", "K", "Ru", "Ra"] for f in faults)):
                for places in itertools.product(["", "u", "a", "ua", "au"], repeat=len(roles) + 1):
                    out, audit, cost = places[0], "I" * len(places[0]), costs.insert * len(places[0])
                    for role, fault, sign, more in zip(roles, faults, signs, places[1:], strict=True):
                        out += "" if sign == "D" else role if sign == "K" else sign[1]
                        cost += costs.delete if sign == "D" else costs.change * (sign[0] == "R") + costs.unfinished * (fault == 3)
                        out, audit, cost = out + more, audit + sign[0] + "I" * len(more), cost + costs.insert * len(more)
                    if legal.fullmatch(out) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            cell = grammar.parse([grammar.turn(r, f) for r, f in zip(roles, faults, strict=True)])
            assert grammar.best(cell) == best
            inserted += "I" in best[1]
    assert bool(inserted) == (costs.insert <= costs.delete)


def test_empty_table(spark):
    assert result(repairs.repaired(table(spark, []))) == []
