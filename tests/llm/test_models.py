"""Operators 3, 5 and 9: brute force on small inputs, and accuracy on held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.llm import common, language, lm, toxicity
from loomline.llm.pieces import MARK, Vocabulary, load
from loomline.llm.queries import PIECES, TOKENIZER, vocabulary


def prose(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


# --- toxicity -----------------------------------------------------------------------------------------------------------

NICE = [a + b for a in ("ba", "de", "ki", "lo", "mu", "sa", "to", "ri") for b in ("", "n", "ra", "lin", "mot", "shu")]
RUDE = ["scumba", "scumle", "idiota", "idioti", "trashy"]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = prose(r, r.randint(5, 120), NICE).split()
        if bad:
            for _ in range(r.randint(1, 5)):
                t.insert(r.randint(0, len(t)), r.choice(RUDE))
        rows.append((i, " ".join(t)))
        if i % 10 < 8:
            labels.append((i, int(bad)))
    labels += [(5, None), (None, 1), (99_999, 1), (6, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_are_told_apart_on_held_out_rows(labelled):
    docs, labels = labelled
    model, beta = toxicity.fit(docs, labels, common.fold("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, beta).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([got[i]["predicted"] == (i % 6 == 0) for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_edge_cases(spark, docs, empty, labelled):
    model, beta = toxicity.fit(*labelled, F.lit(True))
    out = toxicity.score(docs, model, beta)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"] and out.count() == 13
    blank = {r["score"] for r in out.where("doc_id in (4, 5, 6)").collect()}
    assert len(blank) == 1 and toxicity.score(empty, model, beta).count() == 0
    no_labels = labelled[1].where("doc_id < -5")
    none, constant = toxicity.fit(docs, no_labels, F.lit(True))
    assert none is None and {r["predicted"] for r in toxicity.score(docs, none, constant).collect()} == {0}


def test_labelled_texts_without_words_or_of_one_class(spark, docs):
    """Every score is then the toxic share of the labels."""
    blank = spark.createDataFrame([(i, (None, "", " .,! ")[i % 3]) for i in range(40)], "doc_id long, text string")
    one_class = spark.createDataFrame([(i, "some words stand here" if i % 2 else None) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for table in (blank, one_class):
        model, beta = toxicity.fit(table, labels, F.lit(True))
        assert model is None
        assert {round(r["score"], 6) for r in toxicity.score(docs, model, beta).collect()} == {0.5}


def test_places_find_words_by_hash():
    words = [b"w%d" % i for i in range(5000)]
    places, order = toxicity.Places(toxicity.hashed(words)), np.argsort(toxicity.hashed(words))
    assert places.of(toxicity.hashed(words))[order].tolist() == list(range(1, 5001))
    assert places[b"x"] == places[b""] == 0 and places[words[order[7]]] == 8
    assert toxicity.Places(toxicity.hashed([]))[b"x"] == 0


def test_all_words_and_pairs_of_the_sample_are_kept(spark):
    """As many distinct pairs and words as no bound of the model would hold, most of them seen once."""
    n = 130_000
    rows = spark.range(n).selectExpr("cast(concat('v', id) as binary) v", "cast(concat('w', id) as binary) w", "1L + id % 2 t", "0L o")
    rows = rows.unionByName(rows.selectExpr("w v", "v w", "0L t", "1L o"))
    model = toxicity.build(rows)
    assert len(model.place) == 2 * n and len(model.keys) == len(model.pairs) == 2 * n
    for k in (0, 1, n - 1):  # a pair that was seen once in one class tells for it beyond what its words do
        v, w = b"v%d" % k, b"w%d" % k
        assert model.ratios([v, w])[1] > model.unigram[model.place[w]] + model.context[model.place[v]]


def test_ratios_equal_a_plain_kneser_ney(spark):
    """The ratios of one small corpus, worked out with dictionaries."""
    bad, good = ["a b a c", "a b d"], ["c d c", "a c d d", "b d"]
    grams = [Counter(g for t in texts for g in zip([b"", *t.encode().split()], t.encode().split())) for texts in (bad, good)]
    rows = [(bytearray(v), bytearray(w), grams[0][v, w], grams[1][v, w]) for v, w in grams[0] | grams[1]]
    model = toxicity.build(spark.createDataFrame(rows, "v binary, w binary, t long, o long"), 100, 100)

    def discount(c):
        one, two = (sum(x == n for x in c.values()) for n in (1, 2))
        return min(0.95, max(0.1, one / (one + 2 * two))) if one and two else 0.75

    d = [discount(c) for c in grams]
    kinds = {w for _, w in grams[0] | grams[1]}
    contexts = Counter(w for _, w in set(grams[0]) | set(grams[1]))
    shared = {w: (contexts[w] + 1) / (sum(contexts.values()) + len(kinds) + 1) for w in kinds}
    uni = [Counter() for _ in grams]
    for c, u in zip(grams, uni):
        for (_, w), n in c.items():
            u[w] += n

    def level(w, below, k):  # every word here is its own stem, so each level has the same counts
        return (max(uni[k][w] - d[k], 0) + d[k] * len(uni[k]) * below) / sum(uni[k].values())

    def word(w, k):
        p = shared[w]
        for _ in range(len(toxicity.STEMS) + 1):
            p = level(w, p, k)
        return p

    def pair(v, w, k):
        size = sum(n for (a, _), n in grams[k].items() if a == v)
        if not size:
            return word(w, k)
        left = d[k] * sum(a == v for a, _ in grams[k]) / size
        return max(grams[k][v, w] - d[k], 0) / size + left * word(w, k)

    text = [b"a", b"b", b"d", b"d", b"c", b"a"]
    got = model.ratios(text)
    both = grams[0] + grams[1]
    for v, w, x in zip([b"", *text], text, got):  # the first word follows the start, as it was counted
        if both[v, w] > 1:
            want = math.log(pair(v, w, 0) / pair(v, w, 1))
        else:  # pairs that occur once are not kept: both back off
            left = [d[k] * sum(a == v for a, _ in grams[k]) / s if (s := sum(n for (a, _), n in grams[k].items() if a == v)) else 1.0 for k in (0, 1)]
            want = math.log(left[0] * word(w, 0) / (left[1] * word(w, 1)))
        assert x == pytest.approx(want, abs=1e-6), (v, w)


# --- language -----------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    v = Vocabulary(load(vocabulary(PIECES)))
    r = np.random.default_rng(3)
    p = r.random((2, len(v.pieces)))
    p /= p.sum(1, keepdims=True)
    scorer = language.Scorer(v, p)
    words = ["there", "then", "the", "über", "a", "x😀", "日本"]
    got = scorer.score(words)
    for w in words:
        full = MARK + w
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            parts, a = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(full[a:i])
                    a = i
            parts.append(full[a:])
            prob = np.ones(2)
            for s in parts:
                prob *= p[:, v.place[s]] if s in v.place else (language.UNKNOWN if len(s) == 1 else 0)
            total += prob
        assert np.allclose(got[w], np.log(total)), w
        assert np.allclose(scorer.long(full), np.log(total))
    assert np.isfinite(scorer.score(["z" * 5000])["z" * 5000]).all()


def test_learning_on_a_trie_equals_word_by_word(monkeypatch):
    """Expectation-maximisation over every segmentation of every word, listed."""
    v = Vocabulary(load(vocabulary(PIECES)))
    counts = {"the": 5, "then": 2, "other": 1, "über": 3, "x😀": 1, "thenthe": 2}
    monkeypatch.setattr(language, "ROUNDS", 2)

    def cuts(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in v.place or n == 1:
                yield from ([w[:n], *rest] for rest in cuts(w[n:]))

    expected = np.full(len(v.pieces), language.SMOOTH)
    for w, c in counts.items():
        for a, b, k in v.edges(MARK + w):
            expected[k] += c * (b - a) / len(MARK + w)
    for _ in range(2):
        p = expected / expected.sum()
        expected = np.full(len(v.pieces), language.SMOOTH)
        for w, c in counts.items():
            ways = list(cuts(MARK + w))
            probs = [math.prod(p[v.place[s]] if s in v.place else language.UNKNOWN for s in x) for x in ways]
            for x, q in zip(ways, probs):
                for s in x:
                    if s in v.place:
                        expected[v.place[s]] += c * q / sum(probs)
    assert np.allclose(language.learn(v, counts), expected / expected.sum(), rtol=1e-9)


def test_tries_give_the_edges_of_each_word(real):
    """The pieces that end at the nodes of a word's path are those that stand in the word."""
    v = Vocabulary(load(vocabulary(PIECES)))
    words = sorted({MARK + w for r in real.collect() for w in (r["text"] or "").split()})[::37][:600] + [MARK + "日本" * 40, MARK + "a\0b"]
    assert sorted(i for b in v.blocks(words) for i in b) == list(range(len(words)))
    for block in v.blocks(words):
        some, ends = [words[i] for i in block], np.zeros(len(block), np.int64)
        into, parents, codes = {}, {0: None}, {}
        for x in v.levels(some, ends):
            for at, start, k in x.edges:
                for a, s, q in zip(at.tolist(), start.tolist(), k.tolist()):
                    into.setdefault(x.first + a, []).append((s, q))
            for a, (up, c) in enumerate(zip(x.parent.tolist(), x.codes.tolist())):
                parents[x.first + a], codes[x.first + a] = up, chr(c)
        assert len({(parents[n], c) for n, c in codes.items()}) == len(codes)  # each prefix once
        for w, end in zip(some, ends.tolist()):
            path = [end]
            while parents[path[-1]] is not None:
                path.append(parents[path[-1]])
            path.reverse()
            assert "".join(codes[n] for n in path[1:]) == w
            got = sorted((path.index(s), depth, q) for depth, n in enumerate(path) for s, q in into.get(n, []))
            assert got == sorted(v.edges(w))


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, p = language.fit(docs, vocabulary(PIECES), common.fold("doc_id", 4) != 2)
    assert names == ["de", "en", "es", "fr"] and np.allclose(p.sum(1), 1)
    got = language.predict(docs, vocabulary(PIECES), names, p).where(common.fold("doc_id", 4) == 2).select("lang", "lang_pred", "score").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark, docs, empty, monkeypatch):
    names, p = language.fit(docs, vocabulary(PIECES), F.lit(True))
    assert names == ["en", "xx"]
    out = language.predict(docs, vocabulary(PIECES), names, p)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert got[4] == got[5] == got[6] == ("und", 0.0) and got[1][0] == "en"
    numbers = spark.createDataFrame([(1, "12 34 !?"), (2, "½ ² ①"), (3, "1a")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.predict(numbers, vocabulary(PIECES), names, p).orderBy("doc_id").collect()] == [True, True, False]
    assert language.predict(empty, vocabulary(PIECES), names, p).count() == 0
    names, p = language.fit(empty, vocabulary(PIECES), F.lit(True))
    assert names == [] and {r["lang_pred"] for r in language.predict(docs, vocabulary(PIECES), names, p).collect()} == {"und"}
    monkeypatch.setattr(language, "CACHE", 2)
    s = language.Scorer(Vocabulary(load(vocabulary(PIECES))), np.full((2, 31_741 + 0), 1e-5)[:, : len(Vocabulary(load(vocabulary(PIECES))).pieces)])
    one = s.text(b"aa bb cc dd")
    assert np.allclose(one, s.text(b"dd cc") + s.text(b"aa bb"))


# --- language model -------------------------------------------------------------------------------------------------------


def base_scores(rows, learn):
    words = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    c = Counter(w for i, _ in rows if learn(i) for w in words[i])
    n, v = sum(c.values()), len(c)
    return n, {i: (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in words.items()}


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 40])
def test_counts_and_base_equal_the_brute_force(real, frequent, monkeypatch):
    """With few frequent words nearly all others go through the join."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    n, want = base_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    got = lm.scored(real, vocabulary(TOKENIZER), common.fold("doc_id", 10) != 0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[r["doc_id"]][:2], n)
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_model_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.scored(docs, vocabulary(TOKENIZER), common.fold("doc_id", 10) != 0).where(common.fold("doc_id", 10) == 0).collect()
    assert len(held) > 80 and sum(r["score"] for r in held) > 0.96 * sum(r["base_score"] for r in held)
    assert np.mean([r["score"] > r["base_score"] for r in held]) > 0.95


def test_lm_edge_cases(docs, texts, empty):
    got = lm.scored(docs, vocabulary(TOKENIZER), F.lit(True)).collect()
    assert len(got) == len(texts) and {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert len({round(r["score"], 6) for r in got if r["doc_id"] == 2}) == 1
    assert lm.scored(empty, vocabulary(TOKENIZER), F.lit(True)).count() == 0
    none = lm.scored(docs, vocabulary(TOKENIZER), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)


def small():
    r = np.random.default_rng(1)
    w = {k: v.astype("f8") for k, v in lm.new_weights(r.random(7) + 0.1).items()}
    w["p"] += r.normal(0, 0.3, w["p"].shape)
    texts = [np.array([3, 4, 5] * 9 + [6]), np.array([], int), np.array([5] * 15), np.array([4] * 16)]
    into, target, owner = lm.padded(texts)
    x = r.normal(0, 0.5, (8, lm.WIDTH))[into]
    label = np.where(target >= 0, target % 7, -1)
    return w, x, into, label, target, owner, texts


def test_each_position_once():
    *_, target, owner, texts = small()
    for k, t in enumerate(texts):
        assert target[(owner == k) & (target >= 0)].tolist() == [*t.tolist(), lm.STOP]


def test_samples_are_windows_of_the_whole_sequence():
    words = lm.Words(open(vocabulary(TOKENIZER), "rb").read(), [b"a"], [b"a"], np.zeros(lm.BUCKETS, int))
    for n in (0, 1, 14, 15, 16, 17, 31, 32, 33, 50):
        found = [b"w%d" % i for i in range(n)]
        words.learn([found])
        into, target, _ = lm.padded([words.numbers(found)])
        blocks = n // lm.STRIDE + 1
        assert len(into) == (blocks + 1) * lm.STRIDE
        for b in range(blocks):
            cut = slice(b * lm.STRIDE, (b + 2) * lm.STRIDE)
            i, t = lm.sample(words, found, b)
            assert i.tolist() == into[cut].tolist() and t[lm.STRIDE :].tolist() == target[cut][lm.STRIDE :].tolist()


def test_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(lm, "CACHE", 3)
    words = lm.Words(open(vocabulary(TOKENIZER), "rb").read(), [b"the", b"of"], [b"the"], np.zeros(lm.BUCKETS, int))
    for _ in range(3):
        words.learn([[b"x", b"y", b"the", b"\xc3\xa9t\xc3\xa9,", b"zz"]])
        assert words.full and words.names[words.place[b"zz"]] == b"zz" and len(words.classes) == len(words.names) == len(words.starts) - 1
        assert len(words.pieces(np.array([words.place[b"the"], words.place[b"zz"]]))[1]) == 2
        words.reset()
        assert words.names == [b"", b"", b"", b"the", b"of"] and len(words.flat) == words.starts[-1]


def test_attention_equals_a_position_at_a_time():
    w, x, into, label, *_ = small()
    got = lm.log_classes(w, x, into != lm.PAD, label[lm.STRIDE :])
    for i in range(lm.STRIDE, len(into)):
        if label[i] < 0:
            continue
        first = (i // lm.STRIDE - 1) * lm.STRIDE
        q, r = x[i] @ w["w"][:, : lm.WIDTH], x[i] @ w["w"][:, 3 * lm.WIDTH :]
        at = [j for j in range(first, i + 1) if into[j] != lm.PAD]
        a = np.array([q @ (x[j] @ w["w"][:, lm.WIDTH : 2 * lm.WIDTH]) * lm.SCALE + w["p"][i % lm.STRIDE, j - first] for j in at])
        a = np.exp(a - a.max())
        h = sum(p * (x[j] @ w["w"][:, 2 * lm.WIDTH : 3 * lm.WIDTH]) for p, j in zip(a / a.sum(), at)) + r
        z = h @ w["u"] + w["b"]
        assert got[i - lm.STRIDE] == pytest.approx(z[label[i]] - np.log(np.exp(z).sum()), abs=1e-4)


def test_gradients_are_those_of_the_loss():
    w, x, into, label, *_ = small()
    real, target = into != lm.PAD, label[lm.STRIDE :]
    loss = lambda: -lm.log_classes(w, x, real, target).sum() / (target >= 0).sum()
    grads, dx = lm.gradients(w, x, real, target)
    r = np.random.default_rng(2)
    for name, g, a in [*((k, grads[k], w[k]) for k in ("w", "p", "u", "b")), ("x", dx, x)]:
        for _ in range(6):
            i = tuple(int(r.integers(n)) for n in a.shape)
            if name == "x" and not real[i[0]]:
                continue
            old, step = a[i], 1e-4
            a[i] = old + step
            up = loss()
            a[i] = old - step
            down = loss()
            a[i] = old
            assert g[i] == pytest.approx((up - down) / (2 * step), abs=2e-4), (name, i)


def test_statistics_are_those_of_the_output_layer():
    w, x, into, label, *_ = small()
    real, target = into != lm.PAD, label[lm.STRIDE :]
    sums = lm.curvature(w, x, real, target)
    wide, classes, n = lm.WIDTH + 1, len(w["b"]), int((target >= 0).sum())
    grads, _ = lm.gradients(w, x, real, target)
    g = sums[: wide * classes].reshape(wide, classes)
    assert sums[-1] == n and np.allclose(g[:-1], -grads["u"] * n, atol=1e-4) and np.allclose(g[-1], -grads["b"] * n, atol=1e-4)
    loss = lambda w: -lm.log_classes(w, x, real, target).sum()
    assert loss(lm.stepped(w, lm.newton(w, sums), 0.5)) < loss(w)


def test_scores_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [{r["doc_id"]: r["score"] for r in lm.scored(docs.repartition(n), vocabulary(TOKENIZER), common.fold("doc_id", 10) != 0).collect()} for n in (1, 5)]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k], rel=1e-5) for k in got[0])


def test_weights_are_learned_from_every_position_of_every_learning_row(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, mean = [], lm.mean

    def watched(w, sums):
        seen.append(int(sums[sum(w[k].size for k in lm.SHARED)]))
        return mean(w, sums)

    monkeypatch.setattr(lm, "mean", watched)
    monkeypatch.setattr(lm, "ENOUGH", 1)
    for shard in (lm.SHARD, 100_000):
        monkeypatch.setattr(lm, "SHARD", shard)
        tokens = lm.scored(docs, vocabulary(TOKENIZER), common.fold("doc_id", 10) != 0).first()["train_tokens"]
        assert tokens > 300_000 and seen.pop() == tokens and not seen


def test_scores_of_several_replicas_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    monkeypatch.setattr(lm, "ENOUGH", 1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [{r["doc_id"]: r["score"] for r in lm.scored(docs.repartition(n), vocabulary(TOKENIZER), common.fold("doc_id", 10) != 0).collect()} for n in (1, 5)]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k], rel=1e-5) for k in got[0])


def test_the_mean_of_replicas_weighs_what_they_learned_from():
    w = lm.new_weights(np.ones(5))
    flat, starts, classes = np.array([lm.ROWS, lm.ROWS + 1, lm.ROWS + 2, 7, 8, 9]), np.arange(5), np.array([-1, -1, 0, 1, 2])
    lines = [np.array([3, 4] * 40, "<i4"), np.array([3] * 9, "<i4")]
    replicas = []
    for line in lines:
        x = lm.Learner(w, flat, starts, classes, np.zeros(lm.BUCKETS, int))
        x.learn(*(pa.array([b], pa.binary()) for b in (line.tobytes(), b"", b"", b"")))
        assert x.learned == len(line) + 1 and (x.w["u"] != w["u"]).any()
        replicas.append(x)
    got = lm.mean(w, sum(x.sums().astype(float) for x in replicas))
    assert np.allclose(got["u"], (81 * replicas[0].w["u"] + 10 * replicas[1].w["u"]) / 91, atol=1e-6)
    assert np.allclose(got["e"][8], replicas[0].w["e"][8], atol=1e-6) and not got["e"][20].any()
    assert np.allclose(got["e"][7], (replicas[0].w["e"][7] + replicas[1].w["e"][7]) / 2, atol=1e-6)


def test_pieces_of_frequent_words_are_remembered_for_good():
    words = lm.Words(open(vocabulary(TOKENIZER), "rb").read(), [b"the", b"house"], [b"the"], np.zeros(lm.BUCKETS, int))
    words.library.remember = 2
    for new in ([b"one", b"two", b"three"], [b"four", b"five", b"six"]):
        words.learn([new])
    assert {b"the", b"house"} <= set(words.library.cores) and b"one" not in words.library.cores
    numbers = words.learned([[b"House,", b"the"], [], [b"four"]])
    rows, begin, sizes = words.pieces(numbers)
    assert len(numbers) == 3 and numbers[1] == 3 and [words.names[i] for i in numbers] == [b"House,", b"the", b"four"]
    assert rows[: sizes[0]].tolist()[:1] == words.pieces(np.array([4]))[0].tolist()[:1]


def test_values_in_order_and_cells():
    a = np.random.default_rng(5).integers(0, 70_000, 500) % 90
    found, back, order, begin = lm.runs(a)
    assert (found[back] == a).all() and (order == np.argsort(a, kind="stable")).all() and (a[order][begin] == found).all()
    got = lm.cells(np.arange(6, dtype="<u2"), np.array([0, 2, 2, 6]))
    assert [np.frombuffer(x, "<u2").tolist() for x in got.to_pylist()] == [[0, 1], [], [2, 3, 4, 5]]
    assert lm.cells(np.zeros(0, "<i4"), np.array([0, 0])).to_pylist() == [b""]
