import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shapeloom.llm import merges, queries

from .cases import documents, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as file:
        return merges.Encoder(merges.Vocabulary(merges.read_ranks(file.read())), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})


def awkward() -> list[str]:
    rnd = random.Random(2)
    made = ["", " ", "  ", "\n\n \n", "a", "<|endoftext|>", "\x00\x1c\x85  x", "it's we'LL 'd", "é \U0001f642‍\U0001f642 ﻿"]
    made += ["".join(rnd.choices(signs, k=rnd.randint(0, 200))) for signs in ("ab", "abc", "aab ", "the in", "éèa'", "0123 ", "日本語🙂", "\t \n.") for _ in range(150)]
    return made + [t for t in texts() if t]


def test_ids_are_the_librarys(own, library):
    made = awkward()
    assert [ids.tolist() for ids in own.batch(made)] == [library.encode_ordinary(t) for t in made]


def test_every_code_point_is_cut_alike(own, library):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(signs), 20_000):
        text = "".join(f"a{c}a {c}{c}1{c}." for c in signs[at : at + 20_000])
        assert own.batch([text])[0].tolist() == library.encode_ordinary(text)


def test_one_long_word(own, library):
    for text in ("ab" * 5_000 + "a", "a" * 9_999):
        assert own.batch([text])[0].tolist() == library.encode_ordinary(text)
    assert own.vocabulary.decode(own.batch(["xyz" * 400_000])[0]).tobytes() == b"xyz" * 400_000


def naive(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of the lowest rank, the first of equal ones, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[k : k + 1] for k in range(len(word))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_vocabularies_whose_ranks_fall_back():
    """A pair that arises may merge before the rank at work: the words then go place by place."""
    rnd = random.Random(9)
    fallen = 0
    for _ in range(40):
        longer = {bytes(rnd.choices(b"abc", k=rnd.randint(2, 5))) for _ in range(25)}
        words = [bytes([b]) for b in range(256)] + rnd.sample(sorted(longer), len(longer))
        vocabulary = merges.Vocabulary({w: k for k, w in enumerate(words)})
        made = [bytes(rnd.choices(b"abc", k=rnd.randint(1, 30))) for _ in range(200)]
        ids, counts = merges.replay(made, vocabulary)
        got = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [naive(w, vocabulary.ranks) for w in made]
        assert [vocabulary.ranks[w] if w in vocabulary.ranks else None for w in made].count(None) > 0
        fallen += sum(v < max(divmod(k, vocabulary.stride)) - 1 for k, v in vocabulary.pairs.items())
        assert all(merges.replay_one(w, vocabulary) == naive(w, vocabulary.ranks) for w in made if w not in vocabulary.ranks)
    assert fallen


def test_memory_starts_anew(own, monkeypatch):
    made = awkward()
    before = [ids.tolist() for ids in own.batch(made)]
    monkeypatch.setattr(merges, "KEPT_BYTES", 1)
    assert [ids.tolist() for part in (made[:700], made[700:]) for ids in own.batch(part)] == before


def test_query_gives_ids_and_decoded_bytes(spark, library):
    docs = documents(spark)
    rows = merges.round_trips(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc in docs.collect():
        ids = library.encode_ordinary(doc.text or "")
        said = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((doc.doc_id, len(ids), said, hashlib.sha256((doc.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_encode_and_decode_tables(spark, library):
    docs = documents(spark)
    encoded = merges.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(str, (r.ids for r in encoded.collect()))) == sorted(str(library.encode_ordinary(d.text or "")) for d in docs.collect())
    back = merges.decode_documents(encoded.unionByName(spark.createDataFrame([(None, None)], encoded.schema)), RANKS)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted([b"", *((d.text or "").encode() for d in docs.collect())])


def test_empty_table(spark):
    assert merges.round_trips(documents(spark, [], repeat=False), RANKS, public_tokenizers.PATTERN).count() == 0


def test_faulty_vocabularies_and_ids(own, tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n\n")
    with pytest.raises(ValueError, match="lacks 254 single bytes"):
        merges.Vocabulary(merges.read_ranks(path.read_bytes()))
    with pytest.raises(ValueError, match="outside"):
        own.vocabulary.decode(np.array([10**6]))


def test_whole_table(spark):
    rows = queries.op12_byte_bpe(spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
