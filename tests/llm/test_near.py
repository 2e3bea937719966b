"""Near copies by similarity."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomline.llm import common, near


def jaccard(a, b):
    a, b = set(near.shingles(a.encode(), 5).tolist()), set(near.shingles(b.encode(), 5).tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def groups(spark):
    r = random.Random(8)
    rows, group = [], 0
    for g in range(120):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([60, 150, 400]))]
        for k in range(r.choice([1, 1, 2, 5])):
            rows.append((len(rows), " ".join(edited(r, base, len(base) // 120) if k else base), g))
        if g % 5 == 0:  # half the same: no copy
            rows.append((len(rows), " ".join(base[: len(base) // 2] + [f"x{r.randrange(10**6)}" for _ in range(len(base) // 2)]), 1000 + g))
    base = [f"h{r.randrange(3000)}" for _ in range(200)]
    rows += [(len(rows) + k, " ".join(edited(r, base, 1)), -1) for k in range(1500)]
    return rows


@pytest.mark.parametrize("chunk", [near.CHUNK, 64])
def test_one_of_each_group_stays(spark, groups, chunk, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", chunk)
    df = spark.createDataFrame(groups, "doc_id long, text string, g int").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near.similar(df).collect()}
    of = {}
    for i, _, g in groups:
        of.setdefault(g, []).append(i)
    assert got == {i: min(of[g]) for i, _, g in groups}
    kept = near.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(m) for m in of.values())


def test_estimate_follows_the_similarity():
    r = random.Random(1)
    for n in (60, 300, 2000):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for share in (0.0, 0.01, 0.02, 0.03, 0.08):
            a, b = " ".join(base), " ".join(edited(r, base, int(n * share)))
            s = [near.shingles(x.encode(), 5) for x in (a, b)]
            fp = [np.frombuffer(near.wide(x), "<u8") for x in s]
            apart = np.bitwise_count(fp[0] ^ fp[1]).sum()
            found = apart <= near.threshold(0.8, np.array([float(len(s[0]))]), np.array([float(len(s[1]))]))[0]
            if not 0.74 < jaccard(a, b) < 0.82:
                assert found == (jaccard(a, b) >= 0.8), (n, share, jaccard(a, b))


def test_bands_find_similar_texts():
    r = random.Random(2)
    hit = []
    for _ in range(150):
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        fp = np.frombuffer(near.wide(near.shingles(" ".join(base).encode(), 5)) + near.wide(near.shingles(" ".join(edited(r, base, 3)).encode(), 5)), np.uint8).reshape(2, -1)
        a, b = near.keys(fp)
        hit.append((a == b).any())
    assert np.mean(hit) > 0.95  # similarity about 0.86


def test_edge_cases(spark, docs, empty):
    got = near.similar(docs).collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[4] == by[5] == by[6] == {4} and by[1] == by[2] == by[3] == by[9] == by[10] == {1} and by[None] == {None}
    kept = near.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [-11, 0, 1, 4, 7, 8]
    assert near.similar(empty).count() == 0 and near.representatives(empty).count() == 0


def test_links_are_linear_in_a_group():
    n = 3000
    key, node = np.zeros(n, "<i8"), np.arange(n)
    check = np.zeros((n, 2), "<u8")
    stay, pairs = near.link(key, check, node)
    assert stay.tolist() == [0] and len(pairs) == n - 1
    r = np.random.default_rng(1)
    stay, pairs = near.link(key[:50], r.integers(0, 2**63, (50, 2), dtype="u8"), node[:50])
    assert len(stay) == 50 and len(pairs) == 0
    assert [len(x) for x in near.link(key[:0], check[:0], node[:0])] == [0, 0]


def planted(r, n, similarity):
    """Two texts of n shingles each whose sets have about that similarity, at the bound or above it."""
    shared = int(np.ceil(2 * n * similarity / (1 + similarity)))
    body = [f"p{r.randrange(10**9)}" for _ in range(shared + 4)]
    return [" ".join([*body, *(f"q{r.randrange(10**9)}" for _ in range(n - shared))]) for _ in range(2)]


def linked(spark, texts, parts=1):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: r["component_id"] for r in near.similar(df).collect()}


def test_pairs_at_the_bound_are_found(spark):
    r = random.Random(5)
    texts = [t for k in range(300) for t in planted(r, r.choice([9, 45, 90, 400]), 0.8)]
    assert all(0.8 <= jaccard(texts[2 * k], texts[2 * k + 1]) < 0.83 for k in range(300))
    got = linked(spark, texts, 3)
    assert [got[2 * k + 1] for k in range(300)] == [2 * k for k in range(300)]
    below = [t for k in range(100) for t in planted(r, 90, 0.77)]
    assert all(jaccard(below[2 * k], below[2 * k + 1]) < 0.8 for k in range(100))
    assert all(i == c for i, c in linked(spark, below).items())


def test_copies_inside_a_family_of_looser_relatives_are_linked(spark):
    r = random.Random(6)
    frame = [f"t{k}" for k in range(166)]
    own = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join([*frame, *own(38)]) for _ in range(600)]
    for k in range(0, 60, 2):  # copies of a member at about 0.87
        texts[k + 301] = " ".join([*texts[k + 300].split()[:-14], *own(14)])
    assert 0.62 < jaccard(texts[0], texts[1]) < 0.75 and 0.85 < jaccard(texts[300], texts[301]) < 0.89
    want = {i: i - 1 if 300 <= i < 360 and i % 2 else i for i in range(600)}
    assert linked(spark, texts) == want and linked(spark, texts, 4) == want


def test_chains_across_a_key_are_one_group(spark):
    r = random.Random(7)
    words = [f"c{r.randrange(10**9)}" for _ in range(260)]
    texts = [" ".join(words[k * 8 : k * 8 + 104]) for k in range(12)]  # only neighbours reach 0.8
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])
    assert set(linked(spark, texts[::-1]).values()) == {0}


def test_rows_that_share_or_lack_an_id_lose_no_group(spark):
    """A group is known by its row, not by its doc_id: one row of each stays."""
    a, b = ("%s one two three four five six seven eight" % w for w in ("alpha", "omega"))
    rows = [(1, a, 1), (1, a, 2), (1, b, 3), (None, a + " nine ten", 4), (None, b[::-1], 5), (None, b[::-1], 6), (2, None, 7), (2, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    kept = near.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(["", a, a + " nine ten", b, b[::-1]])


def test_numbers_are_found_with_and_without_the_bitmap(spark, monkeypatch):
    rows = spark.range(0, 200_000, 1, 7).selectExpr("id * 12345 AS n", "id AS _bucket")
    wanted = rows.where("_bucket % 3 = 0").select(F.col("n").alias("row"))
    for most in (common.BITMAPS, 0):
        monkeypatch.setattr(common, "BITMAPS", most)
        got = common.among(rows, "n", wanted)
        assert got.columns == rows.columns and got.agg(F.count(F.lit(1)), F.sum("_bucket")).first() == (66_667, sum(range(0, 200_000, 3)))


def test_the_trees_over_simhashes_find_near_copies(spark):
    r = random.Random(9)
    base = [[f"v{r.randrange(10**9)}" for _ in range(300)] for _ in range(100)]
    texts = [" ".join(t) for b in base for t in (b, edited(r, b, 1))]
    sets = [near.shingles(t.encode(), 5) for t in texts]
    rows = spark.createDataFrame([(k, len(x), near.simprints(x).tolist()) for k, x in enumerate(sets)], "row long, size long, prints array<long>")
    got = {tuple(sorted((p["a"], p["b"]))) for p in near.by_trees(rows, 0.8).collect()}
    assert sum((2 * k, 2 * k + 1) in got for k in range(100)) >= 98 and len(got) < 120
    codes = [int(c) for c in near._CODES]
    assert all((a ^ b).bit_count() > near.RADIUS for i, a in enumerate(codes) for b in codes[:i])
