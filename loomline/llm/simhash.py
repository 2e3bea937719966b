"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints that differ in at
most `radius` bits are linked; components of links are groups.

The search works on distinct fingerprints. A vantage-point tree, fitted on a bounded sample (its size only sets how
evenly the shards fill), cuts them into shards by Hamming distance. A fingerprint lives in one shard and is sent as a
query to every later shard that its ball of that radius reaches, by the triangle inequality; so each pair within the
radius meets in exactly one shard. In a shard the same splitting goes on down to small leaves, where distances are
counted. A shard returns a spanning forest of the links it saw, not the pairs, so its output is linear even for a
group of thousands of near copies, and no connection between different texts is lost. Components of the forests come
from large-star and small-star rounds, each written to the shared folder.

Groups by similarity, where the radius would be too large for such a tree, are in loomline.llm.near.

Cases: null and empty texts and texts of white space have the fingerprint zero, linked like any other; texts of fewer
words than a shingle are one shingle. Repeated rows have equal fingerprints. Rows with null doc_id belong to their
component, whose id is the smallest doc_id in it (null if there is none). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SHARD = 16_384  # distinct fingerprints that a shard should hold
SAMPLE = 131_072  # at most so many fingerprints fit the tree
LEAF = 256


def fingerprint(text: bytes, words: int) -> int:
    """Of UTF-8 text: ASCII case folded, words between ASCII white space, shingles of so many words."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    set_ = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        set_ += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fingerprint (a signed 64-bit number) of each row."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.utf8(text).alias("body")).mapInArrow(run, "doc_id long, fp long")


def grow(sample: np.ndarray, shards: int) -> list | int:
    """A tree over the sample with about that many leaves: [vantage point, radius, near, far], or a leaf's number."""
    count = 0

    def split(part: np.ndarray, want: int):
        nonlocal count
        if want > 1 and len(part) > 1:
            d = np.bitwise_count(part ^ part[0])
            mid = int(np.median(d))
            near = d <= mid
            if near.all():
                near, mid = d < mid, mid - 1
            if near.any() and not near.all():
                return [int(part[0]), mid, split(part[near], want // 2), split(part[~near], want - want // 2)]
        count += 1
        return count - 1

    return split(sample, shards)


def route(tree, fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, whether they live there) for the rows whose ball reaches a leaf; only their own leaf and later ones."""

    def down(node, rows: np.ndarray, own: np.ndarray):
        if not len(rows):
            return
        if isinstance(node, int):
            yield node, rows, own
            return
        point, mid, near, far = node
        d = np.bitwise_count(fp[rows] ^ np.uint64(point)).astype(np.int16)
        inside = d <= mid
        # whoever lives in the near part queries the far part, not the other way
        keep = np.where(own, inside, d - radius <= mid)
        yield from down(near, rows[keep], own[keep])
        keep = np.where(own, ~inside | (d + radius > mid), d + radius > mid)
        yield from down(far, rows[keep], (own & ~inside)[keep])

    yield from down(tree, np.arange(len(fp)), np.ones(len(fp), bool))


class Forest:
    """Components over positions 0..n-1, the smallest position as label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            ra, rb = label[a], label[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                return
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def near(fp: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the components that links between own rows, and between own rows and queries, make."""
    forest = Forest(len(fp))
    stack = [(np.nonzero(own)[0], np.arange(len(fp)))]
    while stack:
        home, query = stack.pop()
        if not len(home) or not len(query):
            continue
        if len(home) > LEAF:
            d = np.bitwise_count(fp[home] ^ fp[home[0]]).astype(np.int16)
            mid = int(np.median(d))
            inside = d <= mid
            if inside.all():
                mid -= 1
                inside = d <= mid
            if inside.any():
                e = np.bitwise_count(fp[query] ^ fp[home[0]]).astype(np.int16)
                stack.append((home[inside], query[e - radius <= mid]))
                stack.append((home[~inside], query[e + radius > mid]))
                continue
        for a in range(0, len(home), LEAF):
            some = home[a : a + LEAF]
            for b in range(0, len(query), 16 * LEAF):
                other = query[b : b + 16 * LEAF]
                x, y = np.nonzero(np.bitwise_count(fp[other][:, None] ^ fp[some][None, :]) <= radius)
                x, y = other[x], some[y]
                new = forest.label[x] != forest.label[y]
                forest.unite(x[new], y[new])
    return forest.label


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints that are linked, directly or through others of one shard."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = max(1, min(-(-n // SHARD), SAMPLE // 16))
    sample = [r["fp"] for r in common.least_by_hash(distinct.select("fp"), "fp", n, min(SAMPLE, 64 * shards)).collect()]
    tree = spark.sparkContext.broadcast(grow(np.array(sample, "<i8").view("<u8"), shards))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy().astype("<i8").view("<u8")
            for leaf, rows, own in route(tree.value, fp, radius):
                yield pd.DataFrame({"shard": leaf, "fp": fp[rows].view("<i8"), "own": own})

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy().astype("<i8")
        label = near(fp.view("<u8"), frame["own"].to_numpy().astype(bool), radius)
        joined = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[joined], "b": fp[label[joined]]})

    dealt = distinct.select("fp").mapInPandas(deal, "shard int, fp long, own boolean")
    return dealt.groupBy("shard").applyInPandas(pair, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of the component.

    Large-star and small-star rounds until nothing changes. Minima are taken with partial aggregation, and the joins that
    follow have one row for a node on one side, so adaptive execution can split a hub's edges."""
    edges = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, and group_size, the rows of the component."""
    rows = common.stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    linked = components(links(distinct, radius))
    roots = linked.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = distinct.join(linked.unionByName(roots), distinct.fp == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    sizes = members.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    verdict = members.select("fp", "root").join(sizes, "root").select("fp", "component_id", "group_size")
    return rows.join(verdict, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that stay: for each component the row with the smallest doc_id (nulls last), then the longest text;
    with all columns."""
    row = common.fresh(docs, "_row")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    verdict = grouped(numbered, row, text, words, radius).select("doc_id", "component_id")
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    places = numbered.select(F.col(row).alias("row"), F.col(doc_id).isNull().alias("u"), F.col(doc_id).alias("id"), (-size).alias("n"))
    first = places.join(verdict, places.row == verdict.doc_id).groupBy("component_id").agg(F.min(F.struct("u", "id", "n", "row")).alias("x"))
    return common.among(numbered, row, common.stored(first.select("x.row"), "kept")).select(*docs.columns)
