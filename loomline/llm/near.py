"""Near-duplicates by similarity: all pairs of shingle sets whose Jaccard similarity reaches the bound, by verified links.

Candidates come from SimHash through vantage-point trees: TABLES fingerprints of 32 bits a set, searched within RADIUS bits by the
trees of simhash.links, which prune at that radius. They return a spanning forest, so not every pair of similarity 0.8 comes from
there (a table meets such a pair with a chance of about 0.12, one of 0.9 with 0.34, by calculation). The rest come from MinHash:
rows that share one of HASH_BANDS keys, each of HASH_ROWS minima over the set of shingles; a pair of similarity 0.8 shares none
with a chance of 1.3e-7, whatever the sizes. Every link is checked by the true Jaccard similarity of the two sets, so no pair
below the bound is linked.

Of the rows of a key, all are first compared with one of them, and components are taken of the links found. A key whose rows
are then in one component is done; of the others all pairs across components are compared, first by sizes and by a bitmap of
parities that can only understate how much two sets differ (so drops no pair), then by the sets. Nothing is set aside
but rows with an equal set. A group of near copies of one text is thus linear; a group of texts that share keys
but are no near copies of each other costs its pairs.

Cases: null and empty texts have no shingle and are similar to each other only; texts of fewer words than a shingle are one
shingle. Of a group the row with the smallest doc_id stays (nulls last, then the longest text); rows that repeat a
doc_id within a group count as one document. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import components, links

ROUNDS = 32
WIDE = 64 * ROUNDS
BAND = 20
BANDS = 51
HASH_ROWS, HASH_BANDS = 5, 40
TABLES, RADIUS = 8, 2  # SimHashes of 32 bits of a set, and in how many bits those of near copies may differ in the search
PARITY = 2048  # bits
BLOCK = 512  # rows of a key that are compared at once
CHUNK = 8192  # documents of which a task sends one for each set
_ADD = (np.arange(1, ROUNDS + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15))[None, :]


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the set of shingles of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, "<u8")
    parts = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxh64_intdigest, parts), "<u8", max(1, len(found) - words + 1)))


def wide(hashes: np.ndarray, rounds: int = ROUNDS) -> bytes:
    """SimHash of a set in WIDE bits, or 64 for each of fewer rounds: each hash is mixed so many times."""
    sums = np.zeros(64 * rounds, np.int64)
    for a in range(0, len(hashes), 255):  # so many ones fit a byte
        x = hashes[a : a + 255, None] + _ADD[:, :rounds]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        sums += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * sums > len(hashes)).tobytes()


def keys(fp: np.ndarray) -> np.ndarray:
    """Keys [rows, BANDS] of fingerprints [rows, WIDE / 8]; the band is part of the key."""
    bits = np.unpackbits(fp, axis=1)[:, : BANDS * BAND].reshape(len(fp), BANDS, BAND)
    return (bits @ (1 << np.arange(BAND))).astype("<i8") | np.arange(BANDS, dtype="<i8") << BAND


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, HASH_ROWS * HASH_BANDS + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15))[:, None]


def minima(hashes: np.ndarray) -> np.ndarray:
    """Keys [HASH_BANDS] of a set; the band is part of the key."""
    least = np.full(len(_SEEDS), 2**64 - 1, "<u8")
    for a in range(0, len(hashes), 1024):
        x = (hashes[None, a : a + 1024] ^ _SEEDS) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        least = np.minimum(least, x.min(axis=1))
    key = np.arange(1, HASH_BANDS + 1, dtype="<u8")
    for column in least.reshape(HASH_BANDS, HASH_ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view("<i8")


_CODES = (_mixed(np.arange(1, TABLES + 1, dtype="<u8")) >> np.uint64(32)) << np.uint64(32)


def simprints(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints [TABLES] of a set: 32 bits of SimHash behind a code of the table. Codes differ in more than RADIUS bits, so
    one tree serves all tables and links none across."""
    return (_CODES | np.frombuffer(wide(hashes, TABLES // 2), "<u4")).view("<i8")


def parity(hashes: np.ndarray) -> bytes:
    """PARITY bits: whether an odd number of the set's hashes falls on each. Two sets differ by at least as many hashes as bits."""
    return np.packbits(np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def possible(similarity: float, bits: np.ndarray, size: np.ndarray, other_bits: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Which pairs [rows, others] may have that similarity, by sizes and parities; never False for one that has."""
    a, b = size[:, None].astype(float), other_size[None, :].astype(float)
    out = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
    x, y = np.nonzero(out)
    for at in range(0, len(x), 1 << 16):
        i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        apart = np.bitwise_count(bits[i] ^ other_bits[j]).sum(1, dtype=np.int64)
        out[i, j] = apart <= (size[i] + other_size[j]) * (1 - similarity) / (1 + similarity) + 1e-9
    return out


def across(similarity: float, root: np.ndarray, node: np.ndarray, bits: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of nodes [n, 2] of one key that are in different components and may be similar."""
    for a in range(0, len(node), BLOCK):
        for b in range(a, len(node), BLOCK):
            one, two = slice(a, a + BLOCK), slice(b, b + BLOCK)
            x, y = np.nonzero((root[one, None] != root[None, two]) & possible(similarity, bits[one], size[one], bits[two], size[two]))
            keep = (x + a) < (y + b)
            if keep.any():
                yield np.stack([node[x[keep] + a], node[y[keep] + b]], axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of distinct hashes; of two empty ones 1."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def link(key: np.ndarray, check: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: (positions that stay, pairs of nodes [n, 2] of a row that is set aside and the first of its key
    with an equal check)."""
    if not len(key):
        return np.arange(0), np.zeros((0, 2), "<i8")
    whole = np.column_stack([key.view("<u8"), check])
    _, first, of = np.unique(whole, axis=0, return_index=True, return_inverse=True)
    first = first[of.ravel()]
    aside = first != np.arange(len(key))
    return np.nonzero(~aside)[0], np.stack([node[aside], node[first[aside]]], axis=1)


def threshold(similarity: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most differing bits of two sets of these sizes with that similarity, one standard error allowed for; -1 if sizes alone
    rule it out."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    common_ = similarity * (a + b) / (1 + similarity)
    cosine = np.minimum(1, common_ / np.sqrt(np.maximum(a * b, 1)))
    share = np.arccos(cosine) / np.pi
    return np.where(small >= similarity * large - 1e-9, WIDE * share + np.sqrt(WIDE * share * (1 - share)), -1)


_PAIRS = "a long, b long"


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), "<i8")
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(rows: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows (row, body) whose sets have that similarity; only texts that are in a pair are shuffled."""
    pairs = common.stored(pairs, "candidates")
    texts = common.among(rows.select("row", "body"), "row", pairs.select(F.explode(F.array("a", "b")).alias("row")))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.vacate()
        last = None
        for batch in batches:
            a, keep = batch.column(0).to_pylist(), []
            for k, (one, two) in enumerate(zip(batch.column(2), batch.column(3))):
                if last is None or last[0] != a[k]:
                    last = a[k], shingles(one.as_py(), words)
                keep.append(jaccard(last[1], shingles(two.as_py(), words)) >= similarity - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("row").alias(c), F.col("body").alias(f"body_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "body_a", "body_b").mapInArrow(sure, _PAIRS)


def by_trees(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (row, size, prints) that the vantage-point trees over SimHashes find: of rows with one fingerprint
    each with the first, and the first rows of fingerprints that the trees link; those whose sizes rule it out left out."""
    each = common.stored(rows.select(F.explode("prints").alias("fp"), F.col("row").alias("node"), "size"), "prints")
    first = common.stored(each.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("x")), "first")
    left, right = (first.select(F.col("fp").alias(c), F.col("x").alias(f"x_{c}")) for c in ("a", "b"))
    across_ = links(first.select("fp"), RADIUS).join(left, "a").join(right, "b").select("x_a", "x_b")
    within = each.join(first, "fp").where("node <> x.node").select(F.col("x").alias("x_a"), F.struct("node", "size").alias("x_b"))
    fits = F.least("x_a.size", "x_b.size") >= F.lit(similarity) * F.greatest("x_a.size", "x_b.size") - 1e-9
    return across_.unionByName(within).where(fits).where("x_a.node <> x_b.node").select(F.col("x_a.node").alias("a"), F.col("x_b.node").alias("b"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n (code points of the text) and component_id, the smallest doc_id of the group, of each row; and the row's
    number and its group's (row, root)."""
    row = common.fresh(docs, "_row")
    numbered = common.stored(docs.select(doc_id, text, F.monotonically_increasing_id().alias(row)), "numbered")
    return _similar(numbered, row, doc_id, text, words, similarity)


def _similar(docs: DataFrame, row: str, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """The same for a stored table whose rows are numbered."""
    common.ship(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        common.vacate()
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, max(1, b.num_rows), 1024)):
            found = [shingles(x.as_py(), words) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array([len(f) for f in found], pa.int64()), pa.array([minima(f) for f in found], pa.list_(pa.int64())),
                pa.array([parity(f) for f in found], pa.binary()), pa.array([xxh128_digest(f.tobytes()) for f in found], pa.binary()),
                pa.array([simprints(f) for f in found], pa.list_(pa.int64())),
            ], names=["row", "doc_id", "n", "size", "keys", "bits", "mark", "prints"])

    texts = docs.select(F.col(row).alias("row"), common.utf8(text).alias("body"))
    rows = docs.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"), common.utf8(text).alias("body"))
    rows = common.stored(rows.mapInArrow(prints, "row long, doc_id long, n long, size long, keys array<long>, bits binary, mark binary, prints array<long>"), "sets")

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (keys, node, size) of a task with different sets, and pairs (a, b) of those with equal ones."""
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                mark = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u8").reshape(part.num_rows, 2)
                node = part.column(1).to_numpy()
                stay, pairs = link(np.zeros(len(node), "<i8"), mark, node)
                here, none = part.select([0, 1, 2]).take(pa.array(stay)), pa.nulls(len(pairs), pa.int64())
                more = pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.list_(pa.int64())), none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["keys", "node", "size", "a", "b"])
                blank = pa.nulls(len(stay), pa.int64())
                yield pa.RecordBatch.from_arrays([*here.columns, blank, blank], names=["keys", "node", "size", "a", "b"])
                yield more

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows (key, node, size) those whose key has more than one, with the first of them and its size."""
        held = tuple(np.zeros(0, "<i8") for _ in range(3))

        def out(key, node, size) -> pa.RecordBatch:
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            k = np.nonzero(~new | ~np.concatenate([new[1:], [True]])[: len(key)])[0]
            f = first[k]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[k], node[k], size[k], node[f], size[f])], names=["key", "node", "size", "first", "first_size"])

        for batch in batches:
            held = tuple(np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last key may go on in the next batch
            if cut:
                yield out(*(h[:cut] for h in held))
                held = tuple(h[cut:] for h in held)
        yield out(*held)

    local = common.stored(rows.select("keys", F.col("row").alias("node"), "size", "mark").mapInArrow(before, "keys array<long>, node long, size long, a long, b long"), "links")
    equal = local.where("a is not null").select("a", "b")
    sent = local.where("node is not null").select(F.explode("keys").alias("key"), "node", "size").repartition("key").sortWithinPartitions("key", "node")
    shared = common.stored(sent.mapInArrow(behind, "key long, node long, size long, first long, first_size long"), "shared")
    fits = F.least("size", "first_size") >= F.lit(similarity) * F.greatest("size", "first_size") - 1e-9
    stars = shared.where((F.col("node") != F.col("first")) & fits).select(F.col("first").alias("a"), F.col("node").alias("b"))
    stars = common.stored(_ordered(stars.unionByName(by_trees(rows, similarity))), "stars")
    found = common.stored(_ordered(verified(texts, stars, words, similarity).unionByName(equal)), "found")
    linked = common.stored(components(found), "linked")

    # keys whose rows are in several components still
    placed = shared.select("key", "node").join(linked, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = common.stored(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    placed = placed.join(open_, "key", "left_semi").join(rows.select(F.col("row").alias("node"), "size", "bits"), "node")
    placed = placed.select("key", "root", "node", "size", "bits").repartition("key").sortWithinPartitions("key", "node")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, root, node, size = (table.column(i).to_numpy() for i in range(4))
            bits = np.frombuffer(b"".join(table.column(4).to_pylist()), "<u8").reshape(len(key), PARITY // 64)
            ends = [*np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0].tolist(), len(key)]
            ready: list[np.ndarray] = []
            for a, b in zip(ends, ends[1:]):
                for pairs in across(similarity, root[a:b], node[a:b], bits[a:b], size[a:b]):
                    ready.append(pairs)
                    if sum(map(len, ready)) > 1 << 16:
                        yield _pairs(ready)
                        ready = []
            yield _pairs(ready)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or held and held[-1].column(0)[0].as_py() != key[-1]:
                yield from out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from out(pa.Table.from_batches(held))

    more = _ordered(placed.mapInArrow(rest, _PAIRS)).join(stars, ["a", "b"], "left_anti")
    more = common.stored(verified(texts, more, words, similarity), "more")
    if not more.isEmpty():
        linked = components(found.unionByName(more))
    linked = common.stored(linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()), "linked")
    members = rows.select("doc_id", "n", "row").join(linked, rows.row == F.col("node"), "left").select("doc_id", "n", "row", F.coalesce("root", "row").alias("root"))
    members = common.stored(members, "members")
    least = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return members.join(least, "root")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, one for each group, with all columns."""
    row = common.fresh(docs, "_row")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    verdict = _similar(numbered, row, doc_id, text, words, similarity)
    first = verdict.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("doc_id"), (-F.col("n")).alias("n"), F.col("row").alias("row"))).alias("x"))
    return common.among(numbered, row, common.stored(first.select("x.row"), "kept")).select(*docs.columns)
