"""Prefix hashes and the neighbours' comparison."""

import hashlib
import random

import cases

from shapeloom.llm import fingerprints as fp


def test_spans_and_extensions():
    rnd = random.Random(4)
    a, b = ("".join(rnd.choices("ab🙂é", k=400)) for _ in range(2))
    b = b[:100] + a[50:250] + b[100:]
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    for _ in range(300):
        i, j, n = rnd.randrange(300), rnd.randrange(300), rnd.randrange(60)
        assert fp.span_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        far = 0
        while i + far < len(a) and j + far < len(b) and a[i + far] == b[j + far]:
            far += 1
        assert fp.common_extension(x, i, y, j) == far
    assert fp.common_extension(x, 50, y, 100) >= 200


def spans(text):
    return {text[k : k + fp.SPAN] for k in range(len(text) - fp.SPAN + 1)} or {text}


def direct_cover(a, b):
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    return begin, (begin + end) / max(len(a), len(b)) if a or b else 1.0


def test_cover_is_that_of_a_direct_comparison():
    rnd = random.Random(8)
    for _ in range(300):
        a = "".join(rnd.choices("ab🙂", k=rnd.randint(0, 60)))
        b = rnd.choice([a, a[: rnd.randint(0, 60)] + "".join(rnd.choices("ab", k=rnd.randint(0, 9))) + a[rnd.randint(0, 60) :]])
        assert fp.covered(fp.PrefixHashes(a), fp.PrefixHashes(b)) == direct_cover(a, b)


def test_slots_estimate_the_spans_in_common():
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        for _ in range(4):
            mine, other = rnd.sample(words, 600), rnd.sample(words, 600)
            a = " ".join(mine)
            b = " ".join(mine[: int(600 * share)] + other[int(600 * share) :])
            true = len(spans(a) & spans(b)) / len(spans(a) | spans(b))
            assert abs(fp.slots_alike(fp.fingerprint(a), fp.fingerprint(b)) - true) < 0.25


def test_likeness():
    like = lambda a, b: fp.Fingerprinted(a).likeness(fp.Fingerprinted(b))[1]
    long = next(t for t in cases.texts() if t and len(t) > 50_000)
    assert like(long, long) == like("", "") == 1.0 and like("", "a") == 0.0
    assert 0.4 < like(long, long[: len(long) // 2] + "zq" * 40_000) < 0.8
    # Parts that moved are told by the slots, an exchanged part by the extensions.
    half = len(long) // 2
    assert like(long, long[half:] + long[:half]) > 0.9
    assert like("abcdefghi", "abcdefxyz") == 6 / 9 and like("abcdefghi", "xyzdefghi") == 6 / 9


def test_neighbours(spark):
    docs = cases.documents(spark, repeat=False)
    made = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    found = {r.doc_id: r for r in fp.fingerprints_with_edits(docs).collect()}
    assert len(found) == len(made)
    for k, (doc_id, text) in enumerate(made):
        after = made[(k + 1) % len(made)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = found[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fp.fingerprint(text) and row.edited_fingerprint == fp.fingerprint(edited)
        begin, share = direct_cover(text, edited)
        assert row.edited_extension == begin >= len(text) - third - max(0, len(text) - third - len(edited))
        assert row.near_edited == (1.0 if text == edited else max(share, fp.slots_alike(row.fingerprint, row.edited_fingerprint)))
        _, share = direct_cover(text, after)
        assert row.near_next == (1.0 if text == after else max(share, fp.slots_alike(row.fingerprint, fp.fingerprint(after))))


def test_repeated_missing_single_and_none(spark):
    docs = cases.documents(spark)
    assert fp.fingerprints_with_edits(docs).count() == docs.count()
    one = cases.documents(spark, ["abcdef"], repeat=False)
    row = fp.fingerprints_with_edits(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fp.fingerprints_with_edits(docs.limit(0)).count() == 0
