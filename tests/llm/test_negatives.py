import random

import numpy as np
import pytest
from pyspark.sql import types as T

from shapeloom.llm import negatives
from shapeloom.llm.negatives import Settings

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("row", "id", "v", "score", "anchor", "x", "y", "tiles", "positives", "place", "rank", "rows")]
)


def vectors(seed: int, n: int, coarse: bool = False) -> list[tuple]:
    rnd = random.Random(seed)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for k in range(n):
        label = rnd.choice([0, 1, 1, 2, 9])
        v = [(round(2 * (c + rnd.gauss(0, 0.4))) / 2 if coarse else c + rnd.gauss(0, 0.4)) for c in centre[label % 3]]
        rows.append((k * 5, v, label))
    return rows


def direct(rows: list[tuple], settings: Settings = Settings()) -> list[tuple]:
    """All pairs, one after the other, in Python's whole numbers."""
    part = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(256.0 * float(np.float32(x)))) for x in v]
        part.append((vec_id, ints, (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for k, (anchor, a, label) in enumerate(part):
        if anchor % settings.anchors_every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), vec_id, other) for n, (vec_id, b, other) in enumerate(part) if n != k]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(n, i) for n, i, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(anchor, positive, r + 1, i, -p, -n) for r, (n, i) in enumerate(inside[:3])]
    return sorted(out)


def mined(spark, rows: list[tuple]) -> list[tuple]:
    table = spark.createDataFrame([(*r, *["1"] * 12) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(table).collect()))


def test_strassen_is_exact():
    rnd = np.random.default_rng(1)
    for rows, inner, columns in ((1, 1, 1), (33, 64, 100), (5, 200, 3), (70, 130, 65), (128, 128, 128), (0, 3, 2), (2, 0, 3)):
        a, b = rnd.integers(-(10**7), 10**7, (rows, inner)), rnd.integers(-(10**7), 10**7, (inner, columns))
        assert (negatives.strassen(a, b, 8) == a @ b).all()
    # Sums that wrap around inside, while the products fit.
    a, b = np.full((40, 40), 2**62 // 40), np.eye(40, dtype=np.int64)
    assert (negatives.strassen(a, b, 4) == a).all()


def test_heaps_merge_in_any_order():
    rnd = random.Random(4)
    entries = [(rnd.randint(-3, 3), rnd.randint(0, 9), k) for k in range(60)]
    want = sorted(entries, key=lambda e: (-e[0], e[1], e[2]))[:4]
    for _ in range(5):
        rnd.shuffle(entries)
        heap, at = negatives.Heaps(1, 4), 0
        while at < len(entries):
            step = rnd.randint(1, 9)
            some = np.array(entries[at : at + step], np.int64)
            heap.merge(*(some[None, :, c] for c in range(3)), np.ones((1, len(some)), bool))
            at += step
        assert list(zip(heap.score[0], heap.id[0], heap.row[0], strict=True)) == want


def test_against_all_pairs(spark, monkeypatch):
    rows = vectors(1, 300)
    assert mined(spark, rows) == direct(rows) != []
    # Small tiles and blocks: every heap is merged from many.
    monkeypatch.setattr(negatives, "CANDIDATE_ROWS", 17)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 4)
    ties = vectors(2, 250, coarse=True)
    assert mined(spark, ties) == direct(ties) != []


def test_awkward_rows(spark):
    rows = vectors(3, 120, coarse=True)
    odd = [
        (None, [1.0] * 6, 1), (5000, None, 1), (5050, [1.0] * 6, None), (5100, [1.0, None], 1), (5150, [float("nan")] * 6, 1),
        (5200, [float("inf")] * 6, 1), (5250, [], 1), (5300, [1.0, 2.0], 1), (5350, [1.0] * 9, 2), (5400, [0.0] * 6, 1), (-50, [1.0] * 6, 1), (0, [1.0] * 6, 1),
    ]
    rows += odd + rows[:30] + rows[:10]
    assert mined(spark, rows) == direct(rows)


def test_one_label_and_no_rows(spark):
    rows = [(k * 10, [1.0, float(k)], 3) for k in range(30) if k * 10 % 7]
    assert mined(spark, rows) == []
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_huge_components_do_not_fail(spark):
    rows = [(k * 25, [3e38, -3e38, 1.0], k % 2) for k in range(8)]
    assert isinstance(mined(spark, rows), list)


@pytest.mark.parametrize("width", [1, 3000])
def test_width_bounds_the_tile(spark, monkeypatch, width):
    monkeypatch.setattr(negatives, "TILE_NUMBERS", 20_000)
    rnd = random.Random(width)
    rows = [(k * 10, [rnd.uniform(0.5, 1)] * width, k % 3) for k in range(60)]
    assert mined(spark, rows) == direct(rows)
