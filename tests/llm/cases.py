"""Small tables with the awkward cases, and direct computations to compare with."""

import random
import re

from pyspark.sql import types as T

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that the operators use inside
    + [T.StructField(c, T.StringType()) for c in ("rid", "row_number_", "kept", "key", "node", "blob", "spans_", "component", "range_")]
)


def texts() -> list[str | None]:
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    base = prose(60)
    near = [base]
    for _ in range(12):
        some = base.split()
        for _ in range(rnd.randint(1, 4)):
            some[rnd.randrange(len(some))] = rnd.choice(words)
        near.append(" ".join(some))
    long = prose(30_000)
    odd = [None, None, "", "", "   ", "\n\t", "one", "ONE", "two  words", "two\nwords", "ß Ö é 日本語 🙂 ①", "a" * 3000, "x " * 500]
    return odd + near + [base, base.upper(), base.replace(" ", "\n "), long, long, long + " end"] + [prose(rnd.randint(3, 80)) for _ in range(60)]


def documents(spark, made: list[str | None] | None = None, repeat: bool = True):
    made = texts() if made is None else made
    rows = [(k, t, "en" if k % 2 else None, None, None if t is None else len(t), *["x"] * 9) for k, t in enumerate(made)]
    if repeat:
        rows += [rows[len(rows) // 2], (None, "no id here at all", None, None, None, *[None] * 9)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(made: dict[int, str | None]) -> dict[int, int]:
    """The smallest reachable id of each, all pairs compared."""
    sets = {k: shingles(t) for k, t in made.items()}
    root = {k: k for k in made}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(made)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}
