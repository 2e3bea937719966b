"""Operators 1, 4 and 8."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from loomline.llm import bpe, common, sst, token_counts
from loomline.llm.queries import END_ID, PIECES, TOKENIZER, vocabulary


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(vocabulary(TOKENIZER))


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_backtracking_encoder_equals_the_library(library):
    m = bpe.Bpe(open(vocabulary(TOKENIZER), "rb").read())
    r = random.Random(3)
    texts = ["", "aaab" * 200, "é" * 500, "a\x1cb\x85c\xa0d\x0b", "x" * 3000, "ΑΣ ΣΑΣ İ", "<|endoftext|>a<|startoftext|>", "'s't're've'm'll'd", "\0\x01\x7f", "1²½١٢"]
    texts += ["".join(r.choice("aeiouthsrn 'sdmlvé1.#İΣ́ \U0001f600") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        want = ids_of(library, t)
        got = m.encode(t.encode()).tolist()
        assert got == want, t
        assert m.decode(got) == library.decode(want, skip_special_tokens=False)


def test_chunks_of_the_library_equal_whole_texts(library):
    lib = sst.Library(open(vocabulary(TOKENIZER), "rb").read())
    assert lib.in_chunks
    r = random.Random(4)
    texts = ["ÉTÉ, ÉTÉ. e\u0301 ΑΣ Σ. İ. ßẞ ŉ ﬁ Ǆ", "<|ENDOFTEXT|> <|endoftext|>. a<|x", "don't. o'ce x'S", "ab1. 1, a_b ..a a.,b,"]
    texts += ["don'!! x's$$$ é&&& é*** ΑΣ!! 1%% ab1%% a—!! .. a! (b)) ### a<| b<|! 가?!"]
    texts += ["".join(r.choice("aeiouthsrn   'sdmlvé1.,#!$<|İΣÉ́ßA") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(lib.encode(t.encode()), "<u4").tolist() == ids_of(library, t), t
    other = sst.Library(open(vocabulary("byte_bpe_50k.json"), "rb").read())
    assert not other.in_chunks
    assert np.frombuffer(other.encode(b" a  b\n"), "<u4").tolist() == other.lib.encode(" a  b\n", add_special_tokens=False).ids


def test_pair_table_holds_what_merging_gives(library):
    m = bpe.Bpe(open(vocabulary(TOKENIZER), "rb").read())
    assert len(m.size) == len(m.text) - 2  # every token is its own encoding


def test_cache_overflow_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 3)
    m = bpe.Bpe(open(vocabulary(TOKENIZER), "rb").read())
    for t in ("a b c d e f a b c d e f", "g a h b", "a a a", "k l m n o p q"):
        assert m.encode(t.encode()).tolist() == ids_of(library, t)
    lib = sst.Library(open(vocabulary(TOKENIZER), "rb").read())
    for t in ("A b, c. d e f a b c d e f", "g a. h b,,", "<|endoftext|>. <|x Éa., .,"):
        assert np.frombuffer(lib.encode(t.encode()), "<u4").tolist() == ids_of(library, t)


@pytest.mark.parametrize("with_ids", [True, False])
def test_encode_edge_cases(docs, texts, library, with_ids):
    out = bpe.encode(docs, vocabulary(TOKENIZER), with_ids=with_ids)
    assert out.columns[:4] == docs.columns
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()))
    want = []
    for i, t in texts:
        ids = ids_of(library, t)
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    if with_ids:
        assert sorted((r["n_tokens"], len(r["token_ids"])) for r in out.collect()) == sorted((w[1], w[1]) for w in want)


def test_encode_empty_and_clashing(empty, docs):
    assert bpe.encode(empty, vocabulary(TOKENIZER)).count() == 0
    clash = docs.withColumnRenamed("score", "n_tokens").withColumnRenamed("lang", "_utf8")
    assert bpe.encode(clash, vocabulary(TOKENIZER)).columns == ["doc_id", "text", "_utf8", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]


def written(spark, df):
    folder = common.new_path(spark, "ids")
    shards = sst.write(df, vocabulary(TOKENIZER), folder, END_ID)
    return folder, shards, sst.read(spark, folder, shards)


def test_shards_round_trip(spark, docs, texts, library):
    folder, shards, back = written(spark, docs)
    got = back.orderBy("start").collect()
    want = sorted(((i is not None, i or 0, t) for i, t in texts), key=lambda x: (x[0], x[1], x[2].encode()))
    start = 0
    for r, (known, i, t) in zip(got, want, strict=True):
        ids = [*ids_of(library, t), END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["end_id"]) == (i if known else None, start, len(ids), crc, END_ID)
        start += len(ids)
    assert sst.lookup(folder, shards, 9) == [[*ids_of(library, dict(texts)[9]), END_ID]]
    assert len(sst.lookup(folder, shards, 2)) == 2 and len(sst.lookup(folder, shards, None)) == 1
    assert sst.lookup(folder, shards, 777) == []


def test_shards_of_an_empty_table(spark, empty):
    _, shards, back = written(spark, empty)
    assert shards == [] and back.count() == 0


def test_shard_format(tmp_path):
    r = random.Random(1)
    keys = sorted(sst.key_of(k) for k in [None, *(r.randint(-(2**63), 2**63 - 1) for _ in range(3000)), 5, 5, 5])
    values = [r.randbytes(2 * r.randint(0, 300)) for _ in keys]
    path = tmp_path / "s.sst"
    with open(path, "wb") as f:
        w = sst.Writer(f, 2)
        for k, v in zip(keys, values):
            w.add(k, v)
        rows, ids, size = w.close()
    assert (rows, ids, size) == (len(keys), sum(map(len, values)) // 2, path.stat().st_size)
    with open(path, "rb") as f:
        reader = sst.Reader(f)
        assert list(reader) == list(zip(keys, values)) and len(reader.index) > 3
        for k in keys[::97]:
            assert reader.get(k) == [v for a, v in zip(keys, values) if a == k]
        assert sum(bool(reader.get(sst.key_of(r.randint(0, 2**62)))) for _ in range(300)) == 0
    with pytest.raises(ValueError):
        w = sst.Writer(open(os.devnull, "wb"), 2)
        w.add(b"b", b"")
        w.add(b"a", b"")
    assert [sst.id_of(sst.key_of(x)) for x in (None, -(2**63), -1, 0, 2**63 - 1)] == [None, -(2**63), -1, 0, 2**63 - 1]


def brute_count(counter, word):
    """Best segmentation by trying all, one letter at a time."""
    place, logp = counter.vocabulary.place, counter.logp
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = []
        for a in range(end):
            piece = word[a:end]
            if piece in place:
                found.append((best[a][0] + logp[place[piece]], best[a][1] + 1))
            elif end - a == 1:
                n = len(piece.encode())
                found.append((best[a][0] + n * counter.byte, best[a][1] + n))
        best.append(max(found, key=lambda x: x[0]))
    return best[-1]


def test_counts_equal_the_brute_force(real):
    counter = token_counts.Counter(open(vocabulary(PIECES), "rb").read())
    words = sorted({w for r in real.collect() for w in (r["text"] or "").encode().split()})[:4000] + ["😀x".encode(), "ß".encode(), b"a" * 200]
    got = counter.learn(words)
    for w in words:
        score, tokens = brute_count(counter, "▁" + w.decode())
        assert got[w][0] == tokens and abs(got[w][1] - score) < 1e-9


def test_counts_equal_the_library():
    """The same pieces and scores in another unigram tokenizer."""
    from tokenizers import Tokenizer, models

    counter = token_counts.Counter(open(vocabulary(PIECES), "rb").read())
    lib = Tokenizer(models.Unigram([("<unk>", -1e6), *zip(counter.vocabulary.pieces, counter.logp)], unk_id=0))
    words = [b"hello", b"unbelievable", b"thhainwh", b"restouti", b"lichkeit", "été".encode(), b"antidisestablishmentarianism"]
    got = counter.learn(words)
    for w in words:
        assert got[w][0] == len(lib.encode("▁" + w.decode()).ids)


def test_counts_of_documents(docs, texts, empty, monkeypatch):
    out = {}
    for r in token_counts.counted(docs, vocabulary(PIECES)).collect():
        out.setdefault(r["doc_id"], []).append((r["n_pretokens"], r["n_tokens"], round(r["logprob"], 6)))
    assert out[4] == out[5] == out[6] == [(0, 0, 0.0)] and len(out[2]) == 2 and out[1] == out[3]
    counter = token_counts.Counter(open(vocabulary(PIECES), "rb").read())
    monkeypatch.setattr(token_counts, "CACHE", 2)
    for i, t in texts:
        words = t.encode().split()
        if len(t) < 1000:
            each = [brute_count(counter, "▁" + w.decode()) for w in words]
            assert counter.text(t.encode())[:2] == (len(words), sum(e[1] for e in each))
    assert token_counts.counted(empty, vocabulary(PIECES)).count() == 0
