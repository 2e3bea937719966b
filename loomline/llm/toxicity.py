"""Toxicity from two class-conditional Kneser-Ney bigram models.

Each class (toxic, ordinary) has discounted bigram counts that back off to its discounted unigram counts, these to the
discounted counts of the words' stems (first bytes), and these to one continuation distribution that both classes share: in
how many different contexts a word stands. Rare expressions have little of their own in either class, so both models
give them what their stem has or the shared value, and that cancels. Of a text the
per-word log-likelihood ratio of the two models is averaged over the whole text and over the best stretches of a few
lengths; a logistic calibration of these length-normalised ratios, fitted on rows whose counts were left out of the
models, gives the score.

The models are fitted on a bounded sample of labelled rows: at most PER_CLASS documents of each class, chosen by a hash of
their identifier, and keep every word and every pair of the sample, those seen once too. Scoring reads every whole text.

Cases: null and empty texts score by the calibration's value for no evidence. Null labels and labels without a document
are ignored; of repeated labels of a document the toxic one counts. Without learning texts of both classes that have a word
every score is the toxic share of the labels (near 0 without labels); so it is where the rows that calibrate are of one class. Repeated rows score alike. Clashing column names of the input are replaced.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .decontaminate import FOLD

PER_CLASS = 10_000
STRETCHES = (1, 4, 16)
FLUSH = 200_000  # pairs that a task counts before it hands them on
SEED = 42
AT_ONCE = 1 << 20  # bytes of text that are looked up at once
STEMS = (6, 4)  # bytes


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def hashed(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word, as the function xxhash64 of SQL gives it. That any two of a million words share a hash has a chance
    of 3e-8; they would count as one."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), "<u8", len(words))


def joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair of hashes."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Places:
    """Places from 1 on of distinct hashes in their sorted order, 0 for any other: an array, and where in it those with
    the same first bits begin."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        bits = max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.append(np.searchsorted(self.hashes, np.arange(1 << bits, dtype="u8") << self.shift), len(hashes)).astype("i4")

    def of(self, wanted: np.ndarray) -> np.ndarray:
        first = (wanted >> self.shift).astype(np.int64)
        at, stop = self.start[first].astype(np.int64), self.start[first + 1]
        out, open_ = np.zeros(len(wanted), np.int64), np.nonzero(at < stop)[0]
        while len(open_):
            here = at[open_]
            hit = self.hashes[here] == wanted[open_]
            out[open_[hit]] = here[hit] + 1
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out

    def __len__(self) -> int:
        return len(self.hashes)

    def __getitem__(self, word: bytes) -> int:
        return int(self.of(hashed([word]))[0])


class Model:
    """The two models as log ratios: of a word or, if it is rare, of its stem; of a context's backoff weights; and of the
    pairs that were seen. Of words place 0 is an unknown one, and the place after the last the start of a text."""

    def __init__(self, place: Places, unigram: np.ndarray, context: np.ndarray, stem: Places, stems: np.ndarray, keys: Places, pairs: np.ndarray):
        self.place, self.stem, self.keys = place, stem, keys
        self.unigram, self.context, self.stems, self.pairs = (x.astype("f4") for x in (unigram, context, stems, pairs))

    def rare(self, words: list[bytes]) -> np.ndarray:
        """The ratio of each word's longest known stem; 0 without one."""
        at = np.zeros(len(words), np.int64)
        for size in STEMS:
            none = np.nonzero(at == 0)[0]
            at[none] = self.stem.of(hashed([words[i][:size] for i in none.tolist()]))
        return self.stems[at]

    def all_ratios(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ratios of the words of texts, one text after the other, and where each text begins (and the last one ends)."""
        found = list(chain.from_iterable(texts))
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if not found:
            return np.zeros(0), ends
        h = hashed(found)
        ids = self.place.of(h)
        out = self.unigram[ids].astype(float)
        none = np.nonzero(ids == 0)[0]
        if len(none):
            out[none] = self.rare([found[i] for i in none.tolist()])
        first = ends[:-1][ends[:-1] < ends[1:]]
        before, h_before = np.roll(ids, 1), np.roll(h, 1)
        before[first], h_before[first] = len(self.place) + 1, hashed([b""])[0]
        out += self.context[before]
        at = self.keys.of(joined(h_before, h))
        seen = np.nonzero(at)[0]
        out[seen] = self.pairs[at[seen] - 1]
        return out, ends

    def ratios(self, found: list[bytes]) -> np.ndarray:
        return self.all_ratios([found])[0]


def evidence(x: np.ndarray) -> list[float]:
    """Mean ratio of a whole text and of its best stretches, and the logarithm of its length."""
    n = len(x)
    if not n:
        return [0.0] * (len(STRETCHES) + 2)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    best = [float((sums[min(s, n) :] - sums[: n + 1 - min(s, n)]).max()) / s for s in STRETCHES]
    return [float(sums[-1]) / n, *best, math.log1p(n)]


def features(model: Model, texts: pa.Array) -> np.ndarray:
    """The evidence of each text of a column."""
    out = []
    for some in common.by_bytes(texts, AT_ONCE):
        x, ends = model.all_ratios([tokens(t) for t in some])
        out += [evidence(x[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return np.array(out).reshape(len(out), len(STRETCHES) + 2)


def build(pairs: DataFrame, words: int | None = None, keep: int | None = None) -> Model:
    """The ratios from a table of pairs: v, w, t and o (counts in toxic and ordinary texts), each pair once. All words and
    pairs are kept; if bounds are given, so many of the most frequent words, and of the most frequent pairs among those that
    occur again. The driver and the workers see hashes and numbers, no words."""
    spark = pairs.sparkSession
    pairs = pairs.select(*[F.xxhash64(c).alias(c) for c in "vw"], *[F.xxhash64(F.expr(f"substring(w, 1, {n})")).alias(f"s{n}") for n in STEMS], "t", "o")
    ones = pairs.agg(*[F.sum(F.when(F.col(c) == n, 1).otherwise(0)) for c in "to" for n in (1, 2)]).first()
    discount = [min(0.95, max(0.1, a / (a + 2 * b))) if a and b else 0.75 for a, b in (ones[:2], ones[2:])]
    got = pairs.groupBy("w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count(F.lit(1)).alias("contexts"), *[F.first(f"s{n}").alias(f"s{n}") for n in STEMS]).toArrow()
    table = {c: got[c].to_numpy() for c in got.column_names}
    del got
    order = np.argsort(table["w"].view("u8"))
    table = {c: x[order] for c, x in table.items()}
    count = [table[c].astype(float) for c in "to"]
    n = [c.sum() for c in count]
    share = (table["contexts"] + 1) / float(table["contexts"].sum() + len(order) + 1)

    def smoothed(counts: np.ndarray, k: int, below: np.ndarray) -> np.ndarray:
        """Discounted counts of class k, and what they leave spread as `below` is."""
        return (np.maximum(counts - discount[k], 0) + discount[k] * np.count_nonzero(counts) * below) / max(n[k], 1)

    # from short stems to long ones to words: each level backs off to the one before it
    lift, found = np.ones((2, len(order))), []  # of each word, the level's probabilities over the shared ones
    for size in sorted(STEMS):
        kinds, first, of = np.unique(table[f"s{size}"].view("u8"), return_index=True, return_inverse=True)
        mine = np.bincount(of, share, len(kinds))
        prob = [smoothed(np.bincount(of, count[k], len(kinds)), k, mine * lift[k, first]) for k in (0, 1)]
        found.append((kinds, np.log(prob[0] / prob[1])))
        lift = np.array([(prob[k] / mine)[of] for k in (0, 1)]).reshape(2, len(order))
    prob = np.ones((2, len(order) + 2))
    for k in (0, 1):
        prob[k, 1:-1] = smoothed(count[k], k, share * lift[k])
    # a long stem takes the place of a short one of the same bytes
    stems, first = np.unique(np.concatenate([x[0] for x in reversed(found)]), return_index=True)
    stem_ratio = np.concatenate([[0.0], np.concatenate([x[1] for x in reversed(found)])[first]])
    kept = np.arange(len(order))
    if words is not None and words < len(order):
        kept = np.sort(np.argsort(-(count[0] + count[1]), kind="stable")[:words])
        prob = prob[:, np.concatenate([[0], kept + 1, [-1]])]
    place = Places(table["w"].view("u8")[kept])
    del table, lift, share, count
    after = pairs.groupBy("v").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), *[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"{c}s") for c in "to"]).toArrow()
    size, weight = np.zeros((2, len(place) + 2), "f4"), np.ones((2, len(place) + 2), "f4")
    start = hashed([b""])[0]
    context = after["v"].to_numpy().view("u8")
    at = np.where(context == start, len(place) + 1, place.of(context))
    known = np.nonzero(at)[0]
    for k, c in enumerate("to"):
        followed, kinds = after[c].to_numpy().astype(float)[known], after[f"{c}s"].to_numpy().astype(float)[known]
        size[k, at[known]] = followed
        weight[k, at[known]] = np.where(followed > 0, discount[k] * kinds / np.maximum(followed, 1), 1.0)
    del after
    shared = spark.sparkContext.broadcast((place, size, weight, prob.astype("f4"), discount, start))

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The key and the log ratio of each pair."""
        place, size, weight, prob, discount, start = shared.value
        for batch in batches:
            v, w = (batch.column(i).to_numpy().view("u8") for i in (0, 1))
            a, b = np.where(v == start, len(place) + 1, place.of(v)), place.of(w)
            known = np.nonzero((a > 0) & (b > 0))[0]
            v, w, a, b, like = v[known], w[known], a[known], b[known], []
            for k in (0, 1):
                count = np.maximum(batch.column(2 + k).to_numpy().astype(float)[known] - discount[k], 0)
                like.append(np.where(size[k, a] > 0, count / np.maximum(size[k, a], 1), 0) + weight[k, a] * prob[k, b])
            yield pa.RecordBatch.from_arrays([pa.array(joined(v, w).view("i8")), pa.array((np.log(like[0]) - np.log(like[1])).astype("f4"))], names=["key", "ratio"])

    top = pairs.select("v", "w", "t", "o")
    if keep is not None:
        top = top.where(F.col("t") + F.col("o") > 1).orderBy(F.desc(F.col("t") + F.col("o")), "v", "w").limit(keep)
    got = top.mapInArrow(ratio, "key long, ratio float").toArrow()
    keys, ratios = got["key"].to_numpy().view("u8"), got["ratio"].to_numpy()
    del got
    shared.destroy()
    return Model(place, np.log(prob[0]) - np.log(prob[1]), np.log(weight[0]) - np.log(weight[1]), Places(stems), stem_ratio, Places(keys), ratios[np.argsort(keys)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> tuple[Model | None, np.ndarray]:
    """Models and calibration from the labelled rows of `labels` for which `learn` (a column over doc_id) holds.

    Three quarters of the sample are counted, one quarter calibrates; ordinary rows weigh as many as they stand for."""
    spark = docs.sparkSession
    common.ship(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).alias("toxic"))
    known = common.stored(known, "labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, ordinary = sizes.get(True, 0), sizes.get(False, 0)
    share = toxic / max(1, toxic + ordinary)
    share_odds = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    constant = np.array([0.0] * (len(STRETCHES) + 2) + [share_odds])
    if not toxic or not ordinary:
        return None, constant
    parts = [common.least_by_hash(known.where(F.col("toxic") == c), "id", n, per_class) for c, n in ((True, toxic), (False, ordinary))]
    sample = common.stored(parts[0].union(parts[1]).withColumn("count_it", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) > 0), "sample")
    chosen = docs.select(F.col(doc_id).alias("id"), common.utf8(text).alias("body")).join(F.broadcast(sample), "id").select("id", "body", "toxic", "count_it")
    chosen = common.stored(chosen, "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            t, o = held
            grams = list(t | o)
            b = pa.RecordBatch.from_arrays([pa.array([g[0] for g in grams], pa.binary()), pa.array([g[1] for g in grams], pa.binary()), pa.array([t[g] for g in grams], pa.int64()), pa.array([o[g] for g in grams], pa.int64())], names=["v", "w", "t", "o"])
            t.clear()
            o.clear()
            return b

        for batch in batches:
            for body, bad in zip(batch.column(0), batch.column(1)):
                found = tokens(body.as_py())
                held[not bad.as_py()].update(zip([b"", *found], found))
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield out()
        yield out()

    grams = chosen.where("count_it").select("body", "toxic").mapInArrow(count, "v binary, w binary, t long, o long")
    grams = common.stored(grams.groupBy("v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "pairs")
    if not all(grams.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()):
        return None, constant
    model = build(grams)
    shared, key = spark.sparkContext.broadcast(model), f"toxicity {uuid.uuid4().hex}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = common.resident(key, lambda: shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(features(model, batch.column(0)).tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    rest = chosen.where("not count_it").select("body", "toxic").mapInArrow(measure, "toxic boolean, x array<double>").toPandas()
    shared.destroy()  # scoring sends the model with its calibration
    if rest["toxic"].nunique() < 2:
        return model, constant
    y = rest["toxic"].to_numpy(float)
    weight = np.where(y > 0, toxic / max(1, y.sum()), ordinary / max(1, (1 - y).sum()))
    return model, logistic(np.array(rest["x"].tolist()), y, weight * len(y) / weight.sum())


def score(docs: DataFrame, model: Model | None, beta: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) to each row."""
    spark = docs.sparkSession
    common.ship(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"score", "predicted"}]
    body = common.fresh(docs, "_utf8")
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared, key = spark.sparkContext.broadcast((model, beta)), f"toxicity {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, beta = common.resident(key, lambda: shared.value)
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            x = features(model, body) if model else np.zeros((len(body), len(beta) - 1))
            out = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30.0, 30.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out), pa.array((out >= 0.5).astype("i4"))], names=schema.names)

    return docs.select(*[docs[c] for c in kept], common.utf8(text).alias(body)).mapInArrow(run, schema)
