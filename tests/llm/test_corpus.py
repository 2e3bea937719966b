"""Operators 2, 6, 7 and 10."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontaminate, exact, html, simhash




# --- decontamination ------------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b | 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(text, items, size=10):
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        if not w:
            continue
        n = min(size, len(w))
        for i in range(len(w) - n + 1):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    ids = sorted(found)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, "The quick, brown fox jumps over the LAZY dog while seven wizards mix"), (2, "quiet rooms"), (10, "quiet-rooms!"), (3, ""), (4, None), (5, "..."), (None, "seven wizards mix"),
    (6, "word word word word word word word word word word"), (7, "你好"), (8, "lazy dog while seven wizards"),
]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_contamination(spark, docs, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = docs.where("doc_id <> 8 or doc_id is null")
    got = decontaminate.contaminate(small, bench, block_bytes=block_bytes).collect()
    assert len(got) == 12
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(r["text"], ITEMS)
        for a, b in [tuple(s) for s in r["spans"]]:
            assert words(r["text"][a:b]) and r["text"][a:b].strip() == r["text"][a:b]


def test_long_text_and_repeats(spark, docs):
    r = decontaminate.contaminate(docs.where("doc_id = 8"), spark.createDataFrame(ITEMS, "item_id long, text string"), keep=["doc_id"]).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (20_001, 20_000, ["6"])


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminate(empty, bench).count() == 0
    assert decontaminate.contaminate(docs, bench.where("item_id = 99")).where("contaminated or n_items > 0 or n_hit > 0").count() == 0
    clash = docs.withColumnRenamed("score", "n_hit").withColumnRenamed("lang", "items")
    assert "n_hit" in decontaminate.contaminate(clash, bench).columns


# --- exact copies -----------------------------------------------------------------------------------------------------


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((i, t))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(key.encode()).hexdigest()) for i, _ in members]
    return out


@pytest.mark.parametrize("capacity", [1, 4096])
def test_exact_copies(docs, texts, capacity):
    got = exact.decisions(docs, capacity=capacity).collect()
    assert sorted(map(str, [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got])) == sorted(map(str, expected(texts)))
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_kept_rows_keep_their_columns(docs, empty):
    for capacity in (1, 4096):
        got = exact.deduplicated(docs, capacity=capacity)
        assert got.columns == docs.columns
        rows = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
        assert [r[0] for r in rows] == [-11, 0, 3, 6, 7, 8, 9, 10]
    assert exact.deduplicated(empty).count() == 0 and exact.decisions(empty).count() == 0


def test_repeated_rows_stay_once(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (1, "ab", 3), (None, "c", 4), (None, "c", 5)], "doc_id long, text string, x int")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in exact.deduplicated(df).collect())
    assert got == [(0, "c"), (1, "a b")]


def test_ids_at_the_ends_of_the_range(spark):
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(low, "a b"), (high, "a b"), (low, "c"), (high, "c"), (None, "c")], "doc_id long, text string")
    for capacity in (1, 2, 4096):
        got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.decisions(df, capacity=capacity).collect()}
        assert got == {(low, low, 2, True), (high, low, 2, False), (low, low, 3, True), (high, low, 3, False), (None, low, 3, False)}
        assert len(exact.deduplicated(df, capacity=capacity).collect()) == 2


def test_misra_gries_keeps_heavy_digests(spark):
    held = {}
    for k in range(4000):
        exact.summary(held, b"hot" if k % 3 == 0 else str(k).encode(), 1, 10)
    assert b"hot" in held and len(held) <= 10
    rows = spark.range(3000).select(F.unhex(F.sha2(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).cast("binary"), 256)).alias("digest"))
    got = {bytes(r["digest"]) for r in exact.frequent(rows, 8).collect()}
    assert hashlib.sha256(b"hot").digest() in got and len(got) <= 16


# --- pages ------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<p>Four&#33;</article><footer>x</footer></body></html>", "A & B One two three. Four!"),
    ("<article><p>Start</p><div class='ad banner'>Buy</div><aside>side</aside><p>End</p><section id=comments><p>Nice</p></section></article><p>outside</p>", "Start End"),
    ("<body><div id=sidebar>" + "menu " * 40 + "</div><p>" + "main text " * 20 + "</p><form>f</form><p>short</p></body>", ("main text " * 20).strip()),
    ("<p>only this", "only this"), ("plain words", "plain words"), ("", ""), (None, ""), ("<!-- never closed <p>x</p>", ""), ("<p>a<!-- c -->b<br>c<script>x", "ab c"), ("<div><p></p></div>", ""),
    ("<article><header><h1>Title</h1></header><p>Body</p></article>", "Title Body"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<article><ul><li>one<li>two</ul><p class=\"lead\">three</article>", "one two three"),
    ("<article><p hidden>no</p><p style='display:none'>no</p><p>yes</p></article>", "yes"), ("<div role=navigation>menu</div><main><p>kept</p></main>", "kept"), ("<p>" + "x" * 100_000 + "</p>", "x" * 100_000),
]


def test_main_text(spark):
    for page, want in PAGES:
        assert html.main_text(page or "") == want, page
    df = spark.createDataFrame([(i, p, "u") for i, (p, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extracted(df).collect()}
    assert got == {i: (w, len(w)) for i, (_, w) in enumerate(PAGES)}
    assert html.extracted(df.where("page_id < 0")).count() == 0


def test_dense_text_outside_an_article_is_kept():
    body = "body text " * 20
    page = f"<nav>menu</nav><article><p>Teaser</p></article><div><h1>Title</h1><p>{body}</p></div><footer>{body}</footer><p>tiny</p>"
    assert html.main_text(page) == f"Teaser Title {body.strip()}"
    assert html.main_text(f"<div><p>{body}</p></div><main><p>Short</p></main>") == f"{body.strip()} Short"


def test_short_text_beside_furniture_in_a_text_is_kept():
    long = "long text " * 20
    want = f"{long.strip()} Short end."
    assert html.main_text(f"<p>{long}</p><div class=ad>x</div><p>Short end.</p>") == want
    assert html.main_text(f"<body><nav>m</nav><p>{long}</p><aside>x</aside><p>Short end.</p><footer>f</footer><p>legal</p></body>") == want
    assert html.main_text(f"<p>Home</p><form>f</form><div><p>{long}</p><form>f</form><p>Short end.</p></div><nav>n</nav><p>legal</p>") == want
    assert html.main_text(f"<div><section><p>{long}</p></section><div class=promo>x</div><h2>Short end.</h2></div>") == want
    assert html.main_text(f"<div><p>{long}</p></div><nav>n</nav><p>Between</p><nav>n</nav><div><p>{long}</p></div>") == f"{long}Between {long.strip()}"


def test_pages_of_the_table(spark):
    import html as entities

    for r in html.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect():
        body = re.sub(r"<!--.*?-->", "", r["html"][r["html"].index("<article>") + 9 :].split("</article>")[0], flags=re.S)
        assert r["text"] == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", body)).split())


# --- near copies --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, n=3):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp, radius):
    label = list(range(len(fp)))
    for _ in fp:
        new = [min(label[j] for j in range(len(fp)) if bin(fp[i] ^ fp[j]).count("1") <= radius) for i in range(len(fp))]
        if new == label:
            break
        label = new
    return label


def test_near_copies(spark, docs, texts, empty):
    got = simhash.grouped(docs).collect()
    fp = [brute_fingerprint(t) for _, t in texts]
    label = brute_components(fp, 2)
    want = []
    for i, (doc, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if label[j] == label[i] and texts[j][0] is not None]
        want.append((doc, f"{fp[i]:016x}", min(ids) if ids else None, label.count(label[i])))
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert simhash.grouped(empty).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted({min(w[2] if w[2] is not None else 0 for w in want if w[2] == c) if c is not None else 0 for c in {w[2] for w in want}})


def test_components_that_share_or_lack_an_id_stay(spark):
    a, b = "one two three four five six seven", "seven wizards mix potions in quiet rooms"
    df = spark.createDataFrame([(1, a, 1), (1, b, 2), (None, b[::-1], 3), (None, a[::-1], 4), (1, a, 5)], "doc_id long, text string, row int")
    assert sorted(r["text"] for r in simhash.representatives(df).collect()) == sorted([a, b, a[::-1], b[::-1]])


def test_trees_find_all_links(spark, monkeypatch):
    """Many shards and small leaves, dense groups of near copies, chains of links."""
    monkeypatch.setattr(simhash, "SHARD", 60)
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 2**63, 250)]
    near = []
    for b in base[:60] + [base[0]] * 150:
        for k in r.integers(0, 64, r.integers(1, 5)):
            b ^= 1 << int(k)
        near.append(b)
    chain = [base[9]]
    for k in range(20):
        chain.append(chain[-1] ^ (1 << k) ^ (1 << (k + 30)))
    fp = sorted(set(base + near + chain))
    signed = [int(x) for x in np.array(fp, "<u8").view("<i8")]
    label = brute_components(fp, 2)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 2)).collect()}
    groups = {}
    for s, c in zip(signed, label):
        groups.setdefault(c, set()).add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    monkeypatch.setattr(simhash, "LEAF", 4)
    own = np.ones(len(fp), bool)
    got = simhash.near(np.array(fp, "<u8"), own, 2)
    assert got.tolist() == label


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 150)] + [(100, 39)] + [(-5, -6), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[-5] == -6 and all(got[x] == 0 for x in [*range(1, 41), *range(100, 150)])
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
