"""Packing and piece encoding: the libraries' ids, exact round trips, limits."""

import random
import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from shapeloom.llm import packing, pieces

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "  a  b\n\nc  ", "a b \n c", "  x", "x  y", "<|endoftext|> y", "don't   'll", "日本語 ①②🙂", "a" * 700, "<s> foo </s> ▁ a▁b", "tab\tx \ty", "\x1c a \x1c"]


def library():
    known = Tokenizer.from_file(BPE)
    known.encode_special_tokens = True
    return known


def test_ids_are_the_library_s():
    made = ODD + [t for t in cases.texts() if t]
    want = [library().encode(t, add_special_tokens=False).ids for t in made]
    assert [i.tolist() for i in packing.Encoder(open(BPE).read()).batch(pa.array(made))] == want
    other = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(other)
    lib.encode_special_tokens = True
    assert packing.Encoder(open(other).read()).batch(pa.array(["Hello there"]))[0].tolist() == lib.encode("Hello there", add_special_tokens=False).ids


def test_pack_documents(spark):
    docs = cases.documents(spark)
    rows = packing.pack_documents(docs, BPE).collect()
    known, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    made = {r.doc_id: r.text for r in docs.collect()}
    assert set(by_doc) == set(made)
    for doc_id, some in by_doc.items():
        ids = np.array([*known.encode(made[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        copies = sum(r.length for r in some) // len(ids)
        assert sum(r.length for r in some) == copies * len(ids) and {r.doc_tokens for r in some} == {len(ids)}
        for r in some:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered = np.zeros(len(ids), int)
        for r in some:
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()
    padding = total = 0
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and len(some) <= 64 and {r.sequence_tokens for r in some} == {at}
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    assert padding <= 0.01 * total


def test_limits_hold_together():
    rnd = random.Random(1)
    for tokens, segments, loss in ((64, 4, 40), (50, 2, 50), (16, 16, 3)):
        packer, made = packing.Packer(packing.Limits(tokens, segments, loss)), {}
        out = []
        for k in range(700):
            ids = np.arange(rnd.randint(1, 150), dtype=np.uint32)
            made[k] = (ids, np.array([rnd.random() < 0.6 for _ in ids], np.int64))
            out += packer.add(k, *made[k])
        out += packer.finish()
        cover, bins = defaultdict(list), defaultdict(list)
        for key, start, ids, sequence, offset, segment, filled in out:
            cover[key] += range(start, start + len(ids))
            bins[sequence].append((offset, len(ids), int(made[key][1][start : start + len(ids)].sum()), filled))
        assert all(sorted(cover[k]) == list(range(len(ids))) for k, (ids, _) in made.items())
        for some in bins.values():
            assert sum(n for _, n, _, _ in some) <= tokens and len(some) <= segments and sum(x for _, _, x, _ in some) <= loss


def test_pack_examples(spark):
    rows = [(1, [1, 2, 3], [True, False, True]), (2, None, None), (3, list(range(50)), None), (None, [7], [False])]
    data = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>")
    out = packing.pack_examples(data, packing.Limits(16, 4, 8)).collect()
    assert sum(r.length for r in out) == 54 and {r.doc_id for r in out} == {1, 3, None}


def test_pieces_match_and_return(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    made = ODD + [t for t in cases.texts() if t is not None]
    encoder = pieces.Encoder(pieces.load(MODEL))
    ids = encoder.batch(made)
    assert [i.tolist() for i in ids] == [lib.encode(t) for t in made]
    assert [encoder.decode(i) for i in ids] == [lib.decode(i.tolist()) for i in ids]
    docs = cases.documents(spark)
    assert {r.round_trip for r in pieces.round_trips(docs, MODEL).collect()} == {True}
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in docs.collect())


def test_long_words_and_best_paths():
    vocabulary = pieces.load(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    word = "".join(random.Random(2).choices("abcdehnorst", k=900))
    assert pieces.Encoder(vocabulary).batch([word])[0].tolist() == lib.encode(word)
    vocabulary.merges = False  # the same pieces as a unigram model: the best sum of scores
    encoder = pieces.Encoder(vocabulary)
    ids = encoder.batch(["the cat"])[0].tolist()
    assert encoder.decode(np.array(ids)) == "the cat"
    best = {0: 0.0}
    text = "▁the▁cat"
    scores = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.plain, strict=True) if k}
    for end in range(1, len(text) + 1):
        best[end] = max(best[a] + scores[text[a:end]] for a in range(end) if text[a:end] in scores and a in best)
    assert abs(sum(vocabulary.scores[i] for i in ids) - best[len(text)]) < 1e-6


def test_empty(spark):
    none = cases.documents(spark).limit(0)
    assert packing.pack_documents(none, BPE).count() == pieces.round_trips(none, MODEL).count() == 0


def test_added_tokens_are_the_librarys():
    made = ["a <|endoftext|> y", "<|endoftext|>", "plain words here", "a  b<|endoftext|><|endoftext|>\n c", "<|endoftext", ""]
    known = Tokenizer.from_file(BPE)
    found = [i.tolist() for i in packing.encoder(open(BPE).read()).batch(pa.array(made))]
    assert found == [known.encode(t, add_special_tokens=False).ids for t in made] and found[0] == [64, 220, 50256, 331]
