"""Secret scans against Python's patterns, the ledger, and masks."""

import hashlib
import re

import cases

from shapeloom.llm import secrets

MADE = [
    None, "", "nothing", "password: hunter2", "password=abcdefgh12 token: ' x", "API_KEY = \"abcd1234\" apikey:zzzzzzzzz", "password: secret: abcdefgh123",
    "AKIA" + "B" * 12, "AKIA" + "B" * 11, "AKIAAKIA" + "C" * 12, "é🙂 " + "a1" * 16 + " é " + "0" * 31, "token=" + "f" * 40, "passwd=passwd=passwd=passwd=12345678",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "secret:\x20\x20=12345678", "x" * 50_000 + " secret=longenough1", "SECRET='ABCDEFGH' " * 300,
]


def spans(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    for at, (kind, pattern, group, least) in enumerate(secrets.RULES):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), at, kind, m.end()))
    return sorted(out)


def joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)


def test_scan(spark):
    docs = cases.documents(spark, MADE)
    found = secrets.secret_scan(docs).collect()
    assert len(found) == docs.count()
    for row in found:
        text = MADE[row.doc_id] if row.doc_id is not None else "no id here at all"
        all_ = spans(text)
        base = [s for s in all_ if s[2] in secrets.BASE_KINDS]
        assert row.spans == joined(all_)
        assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[2] == k for s in base) for k in secrets.BASE_KINDS)


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([("a", 1, "token=12345678"), ("b", 1, "plain")], "path string, version int, text string")
    ledger, findings = secrets.scan(first)
    later = spark.createDataFrame([("a", 2, "plain"), ("c", 1, "token=12345678"), ("d", 1, "secret=abcdefgh"), ("d", 2, None)], "path string, version int, text string")
    fresh = secrets.unseen_blobs(later, ledger)
    assert fresh.count() == 2
    ledger2, findings2 = secrets.scan(later, ledger, findings)
    assert ledger2.count() == 4 and findings2.count() == 2
    told = {(r.path, r.version): r.spans for r in secrets.path_findings(first.unionByName(later), findings2).collect()}
    assert len(told) == 6 and {k for k, v in told.items() if v} == {("a", 1), ("c", 1), ("d", 1)}
    assert secrets.unseen_blobs(later, ledger2, "2").count() == 4  # a new rule version sees all again


def test_a_second_run_scans_nothing_and_gives_the_same(spark, tmp_path):
    docs, root = cases.documents(spark, MADE), str(tmp_path / "ledger")
    versions = secrets._as_versions(docs)
    blobs = len({t or "" for t in MADE} | {"no id here at all"})
    findings, scanned = secrets.scan_with_ledger(versions, root)
    assert scanned == blobs
    want = sorted(map(tuple, secrets.secret_scan(docs, root).collect()), key=str)
    again, scanned = secrets.scan_with_ledger(versions, root)
    assert scanned == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, findings.collect()))
    assert sorted(map(tuple, secrets.secret_scan(docs, root).collect()), key=str) == want
    # One new text is one scan; another version of the rules sees all again.
    more = cases.documents(spark, [*MADE, "secret=brandnew1"])
    found, scanned = secrets.scan_with_ledger(secrets._as_versions(more), root)
    assert scanned == 1 and found.count() == findings.count() + 1
    assert secrets.scan_with_ledger(versions, root, "2")[1] == blobs
    assert sorted(map(tuple, secrets.secret_scan(docs, root).collect()), key=str) == want
    # Two runs that scanned the same at the same time: findings count once.
    import shutil

    other = str(tmp_path / "other")
    secrets.scan_with_ledger(versions, other)
    for kind in ("batches", "data"):
        shutil.copytree(f"{other}/{kind}", f"{root}/{kind}", dirs_exist_ok=True)
    assert sorted(map(tuple, secrets.secret_scan(docs, root).collect()), key=str) == want


def test_masks(spark):
    docs = cases.documents(spark, MADE)
    out = secrets.mask_secrets(docs, length="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    for row in out.collect():
        text = MADE[row.doc_id] if row.doc_id is not None else "no id here at all"
        if not spans(text):
            assert row.text == text
            continue
        want, at = "", 0
        for start, _, _, end in sorted(spans(text), key=lambda s: (s[0], s[3])):
            if start >= at:
                want += text[at:start] + "[secret]"
            at = max(at, end)
        assert row.text == want + text[at:] and row.n_chars == len(row.text)
        assert not [s for s in spans(row.text) if s[2] != "assign"]


def test_empty(spark):
    none = cases.documents(spark).limit(0)
    assert secrets.secret_scan(none).count() == secrets.mask_secrets(none).count() == 0
