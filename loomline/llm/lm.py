"""Language-model scoring with a causal self-attention model trained in numpy.

The model reads a text as a sequence of words, each embedded as the mean of the vectors of its subword ids (a public BPE
vocabulary; each id has a vector of its own). From the words before it, masked self-attention with learned relative positions
gives a distribution over word classes; inside its class a word has its smoothed share of the corpus counts. A class is one of
the most frequent words, the end of text, or a cluster of word endings that keep the same company in documents. The
probability of a text is the product over its words and its end, so it can be set against the smoothed unigram (base).

Scoring cuts the sequence into blocks of STRIDE positions; the context window of a block is the block and the one before
it, so windows overlap, each position is scored once, with STRIDE to 2 x STRIDE - 1 positions before it (fewer at a text's start).

Word counts, class totals, the company of word endings and all weights are learned from all learning rows; there is no sample. The
counts, totals and company are sums. For the weights the learning rows are dealt into replicas by a hash of id and text and put in
order by it; each replica starts from the same weights, goes through all blocks of its texts in Adam steps, and the replicas' weights
are averaged by what each learned from (a subword id's vector by the steps that met it). A table of fewer than ENOUGH positions is
gone through more often. How many replicas there are follows from the number of positions, so scores don't depend on how the table
is dealt out, but for the rounding of floating-point sums.

Texts are turned into numbers once: those of the frequent words (at most FREQUENT, none over LONGEST bytes) are broadcast; a
text's other words go along with their subword ids, and are joined to the table of counts by a shuffle.

Cases: null and empty texts are their end alone. Without learning rows all counts are zero and the model is uniform over
classes. Null doc_id counts as the empty text for the split. Repeated rows count and are scored each. Columns that
clash with the result's names are left out.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sst import Library

FREQUENT, LONGEST = 100_000, 64
OWN = 31  # most frequent words with a class of their own
CLASSES = 64
BUCKETS, SKETCH = 4096, 24
ROWS, WIDTH, STRIDE = 65_535, 16, 16  # vectors of subword ids, which are below that in vocabularies of 16 bits
SHARED = ("w", "p", "u", "b")  # weights that every position has a part in
RATE, SLOWER, STEP = 0.01, 100.0, 512  # size of the first training steps, how many it takes to fall by a root of two, and blocks of a step
SHARD, SHARDS = 4_000_000, 256  # positions that a replica should learn from, and at most so many replicas
ENOUGH, ROUNDS = 4_000_000, 8  # positions to learn from: smaller tables are gone through more often, at most so many times
AT_ONCE = 60_000  # words that are put in a row together
PASS = 512  # blocks of a forward pass, whose arrays stay in a core's cache
TEXTS = 128  # texts whose word endings are counted together
SAFE = 30  # numbers up to this size have exponentials and sums of them that floats hold well
CACHE = 150_000
FLUSH = 300_000
SLICE = 1 << 15  # numbers of the weights that are added up together
SMOOTH = 0.1
PAD, START, STOP = 0, 1, 2
NO_IDS = b"\xff\xff\xff\xff"


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, ASCII case folded."""
    return text.lower().split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


# --- counts ---------------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; tasks hand on partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return b

        for batch in batches:
            for raw in batch.column(0):
                held.update(tokens(raw.as_py()))
                if len(held) > FLUSH:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def company(tables: DataFrame) -> np.ndarray:
    """The sums over tasks: for each bucket of word endings its count, and the summed sketch of the documents it stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), "<f4").astype(float)
                at = np.nonzero(x)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(x[at])], names=["at", "x"])

    got = tables.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(BUCKETS * (SKETCH + 1))
    out[got["at"].to_numpy(int)] = got["x"].to_numpy(float)
    return out.reshape(BUCKETS, SKETCH + 1)


def clusters(sums: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each bucket: spherical k-means of the company it keeps, beyond what all buckets keep."""
    n = sums[:, 0]
    out = np.zeros(len(n), np.int64)
    seen = np.nonzero(n)[0]
    if len(seen) <= k:
        out[seen] = np.arange(len(seen))
        return out
    x = sums[seen, 1:] / n[seen, None] - sums[:, 1:].sum(0) / n.sum()
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = x[[0]]
    first = np.argsort(-n[seen], kind="stable")
    for _ in range(k - 1):  # of the frequent ones, the one farthest from all centres so far
        some = first[: 16 * k]
        centres = np.vstack([centres, x[some[np.argmin((x[some] @ centres.T).max(1))]]])
    for _ in range(30):
        at = (x @ centres.T).argmax(1)
        for c in range(k):
            mine = at == c
            if mine.any():
                m = (x[mine] * n[seen][mine, None]).sum(0)
                centres[c] = m / (np.linalg.norm(m) + 1e-9)
    out[seen] = at
    return out


# --- the attention model --------------------------------------------------------------------------------------------


def new_weights(frequency: np.ndarray) -> dict[str, np.ndarray]:
    r = np.random.default_rng(11)
    return {
        "e": r.normal(0, 0.3, (ROWS + 3, WIDTH)).astype("f4"),
        "w": r.normal(0, 0.25, (WIDTH, 4 * WIDTH)).astype("f4"),  # queries, keys, values, residual
        "p": np.zeros((STRIDE, 2 * STRIDE), "f4"),  # relative positions
        "u": r.normal(0, 0.1, (WIDTH, len(frequency))).astype("f4"),
        "b": np.log(np.maximum(frequency, 1e-6) / max(frequency.sum(), 1e-6)).astype("f4"),
    }


CAUSAL = np.where(np.arange(2 * STRIDE)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE, 0, -1e9).astype("f4")
SCALE = np.float32(1 / math.sqrt(WIDTH))


def windows_of(a: np.ndarray) -> np.ndarray:
    """[blocks x STRIDE, ...] as overlapping windows [blocks - 1, 2 x STRIDE, ...], without copying."""
    s = a.strides
    return np.lib.stride_tricks.as_strided(a, (len(a) // STRIDE - 1, 2 * STRIDE, *a.shape[1:]), (STRIDE * s[0], *s), writeable=False)


def wild(a: np.ndarray) -> bool:
    """Whether exponentials of a could leave the range of floats, so that rows must be shifted by their maxima first."""
    return max(a.max(initial=0), -a.min(initial=0)) > SAFE


def row_sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, one after the other; a product is several times as fast as a sum over short rows."""
    return a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)


def attend(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray) -> tuple:
    """Class logits for each position of blocks 1.. of a padded sequence, and what the way back needs: the scaled queries,
    windows of keys and values, attention before it is divided by its sums, those sums, and features."""
    m = w["w"]
    q, k, v, r = x[STRIDE:] @ (m[:, :WIDTH] * SCALE), x @ m[:, WIDTH : 2 * WIDTH], x @ m[:, 2 * WIDTH : 3 * WIDTH], x[STRIDE:] @ m[:, 3 * WIDTH :]
    q = q.reshape(-1, STRIDE, WIDTH)
    kw, vw = windows_of(k), windows_of(v)
    a = np.matmul(q, kw.transpose(0, 2, 1))
    a += w["p"]
    shift = wild(a)
    a += CAUSAL
    seen = windows_of(real)
    holes = np.nonzero(~seen.all(1))[0]  # windows with padding
    a[holes] += np.where(seen[holes], np.float32(0), np.float32(-1e9))[:, None, :]
    if shift:
        a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    s = row_sums(a)[:, None] + np.float32(1e-30)  # positions of padding may see nothing
    h = np.matmul(a, vw).reshape(-1, WIDTH)
    h /= s
    h += r
    z = h @ w["u"]
    z += w["b"]
    return z, (q, kw, vw, a, s, h)


def log_classes(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log-probability of each position's class; target covers blocks 1.. (-1: no position)."""
    z, _ = attend(w, x, real)
    if wild(z):
        z -= z.max(1, keepdims=True)
    at = z[np.arange(len(z)), np.maximum(target, 0)]
    np.exp(z, out=z)
    return np.where(target >= 0, at - np.log(row_sums(z)), 0)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean cross-entropy for the weights but e, and for x."""
    z, (q, kw, vw, a, s, h) = attend(w, x, real)
    s = s.reshape(-1, STRIDE, 1)
    if wild(z):
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    live = np.nonzero(target >= 0)[0]
    total, part = row_sums(z), np.zeros(len(z), z.dtype)
    part[live] = 1 / (total[live] * max(1, len(live)))
    z[live, target[live]] -= total[live]
    z *= part[:, None]
    dh = z @ w["u"].T
    d3 = dh.reshape(-1, STRIDE, WIDTH)
    # attention over its sums is divided in what it meets, which is narrower
    seen = (h - x[STRIDE:] @ w["w"][:, 3 * WIDTH :]) * dh
    over = d3 / s
    ds = np.matmul(over, vw.transpose(0, 2, 1))
    ds -= (row_sums(seen) / s.ravel()).astype(ds.dtype).reshape(s.shape)
    ds *= a
    dg = np.zeros((len(x), 4 * WIDTH), x.dtype)
    dg[STRIDE:, :WIDTH] = np.matmul(ds, kw).reshape(-1, WIDTH)
    dg[STRIDE:, :WIDTH] *= SCALE
    for i, part in ((1, np.matmul(ds.transpose(0, 2, 1), q)), (2, np.matmul(a.transpose(0, 2, 1), over))):
        cols = slice(i * WIDTH, (i + 1) * WIDTH)
        dg[:-STRIDE, cols] += part[:, :STRIDE].reshape(-1, WIDTH)
        dg[STRIDE:, cols] += part[:, STRIDE:].reshape(-1, WIDTH)
    dg[STRIDE:, 3 * WIDTH :] = dh
    ones = np.ones(len(z), z.dtype)
    return {"w": x.T @ dg, "p": (ones[: len(ds)] @ ds.reshape(len(ds), -1)).reshape(ds.shape[1:]), "u": h.T @ z, "b": ones @ z}, dg @ w["w"].T


# --- words ----------------------------------------------------------------------------------------------------------


class Words:
    """Numbers, subword rows and classes of words; the frequent ones for good, others while the cache has room."""

    def __init__(self, spec: bytes, frequent: list[bytes], own: list[bytes], cluster: np.ndarray):
        self.library = Library(spec, 50_000)  # this class remembers the words itself
        self.own = {w: i + 1 for i, w in enumerate(own)}  # class 0: the end
        self.cluster = (cluster + 1 + OWN).tolist()
        self.fixed = len(frequent) + 3
        self.reset(frequent)

    def reset(self, frequent: list[bytes] | None = None) -> None:
        if frequent is not None:
            self.place: dict[bytes, int] = {}
            self.flat, self.starts, self.names = array("i", [ROWS, ROWS + 1, ROWS + 2]), array("q", [0, 1, 2, 3]), [b"", b"", b""]
            self.classes = array("i", [-1, -1, 0])
            self.add(frequent)
            self.library.keep()  # many other words are these with another case or tail
            self.kept = dict(self.place)
            return
        self.place = dict(self.kept)
        del self.flat[self.starts[self.fixed] :], self.starts[self.fixed + 1 :], self.names[self.fixed :], self.classes[self.fixed :]

    def add(self, new: list[bytes]) -> None:
        """Give numbers to words that have none; a word without subword ids has one of its own."""
        raw = [r or NO_IDS for r in self.library.learn(new)]
        ids = np.frombuffer(b"".join(raw), "<u4")
        rows = np.where(ids == 0xFFFFFFFF, ROWS, ids % ROWS)
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)
        self.flat.frombytes(rows.astype(np.int32).tobytes())
        self.starts.frombytes(ends.astype(np.int64).tobytes())
        self.place.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names += new
        own, cluster, crc = self.own, self.cluster, zlib.crc32
        self.classes.extend([w in own and own[w] or cluster[crc(w[-3:]) % BUCKETS] for w in new])

    def learn(self, texts: list[list[bytes]]) -> None:
        new = set().union(*texts).difference(self.place)
        if new:
            self.add(list(new))

    def learned(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of the words of texts, one text after the other, given to those that have none."""
        found = list(chain.from_iterable(texts))
        out = np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found))
        missing = np.nonzero(out < 0)[0]
        if len(missing):
            words = [found[i] for i in missing.tolist()]
            self.add(list(dict.fromkeys(words)))
            out[missing] = self.numbers(words)
        return out

    def classes_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.classes, np.intc)[numbers]  # the view is gone when this returns

    def numbers(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))

    @property
    def full(self) -> bool:
        return len(self.names) > self.fixed + CACHE

    def pieces(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword rows of these words one after the other, where each begins, and how many it has."""
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.intc)  # views, gone when this returns
        sizes = starts[numbers + 1] - starts[numbers]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return flat[np.arange(sizes.sum()) + np.repeat(starts[numbers] - begin, sizes)], begin, sizes


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the inputs, of the targets (-1: none) and the text of each position of texts laid end to end:
    a block of padding, then start, words and padding to whole blocks; each position's target is the next word."""
    sizes = [STRIDE + -(-(len(t) + 1) // STRIDE) * STRIDE for t in texts]
    into, target, owner = np.zeros(sum(sizes), np.int64), np.full(sum(sizes), -1, np.int64), np.repeat(np.arange(len(texts)), sizes)
    at = 0
    for t, size in zip(texts, sizes):
        a = at + STRIDE
        into[a], into[a + 1 : a + 1 + len(t)] = START, t
        target[a : a + len(t)], target[a + len(t)] = t, STOP
        at += size
    return into, target, owner


def sample(words: Words, found: list[bytes], b: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of block b of a text and the block before it (padding before the first)."""
    first = (b - 1) * STRIDE
    part = found[max(0, first - 1) : first + 2 * STRIDE]
    words.learn([part])
    part = words.numbers(part)
    line = np.concatenate([np.full(STRIDE, PAD), [START]] if b == 0 else [[START]] if first == 0 else [np.zeros(0, np.int64)]).astype(np.int64)
    line = np.concatenate([line, part, [STOP] if first + 2 * STRIDE > len(found) else []]).astype(np.int64)
    # line[i] is the input of position first + i, and the target of the one before it
    into, target = np.full(2 * STRIDE, PAD), np.full(2 * STRIDE, -1)
    after = line[1 : 2 * STRIDE + 1]
    target[: len(after)] = np.where(after > START, after, -1)
    line = line[: 2 * STRIDE]
    into[: len(line)] = np.where(line == STOP, PAD, line)
    return into, target


# curvature(), newton(), stepped() and sample() are off the operator's path; they stay because existing tests name them


def curvature(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the output layer, summed over the positions that target names: the gradient [WIDTH + 1, classes] of the
    log-probability, the products of features [WIDTH + 1, WIDTH + 1], p (1 - p) of each class, and the positions."""
    z, (*_, h) = attend(w, x, real)
    live = np.nonzero(target >= 0)[0]
    if wild(z):
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    s = row_sums(z)
    part = np.zeros_like(s)  # a position without a target has no part in the sums
    part[live] = 1 / s[live]
    spread = part @ z - (part * part) @ (z * z)
    z[live, target[live]] -= s[live]
    h = np.hstack([h, np.ones((len(h), 1), h.dtype)])
    some = h[live]
    return np.concatenate([-((h * part[:, None]).T @ z).ravel(), (some.T @ some).ravel(), spread, [len(live)]]).astype(float)


def newton(w: dict[str, np.ndarray], sums: np.ndarray) -> np.ndarray:
    """The step [WIDTH + 1, classes] of the output layer: each class's curvature is taken as that of the features, times its
    own mean p (1 - p)."""
    wide, classes = WIDTH + 1, len(w["b"])
    g, f, spread, n = np.split(sums, np.cumsum([wide * classes, wide * wide, classes]))
    g, f, n = g.reshape(wide, classes), f.reshape(wide, wide), max(n[0], 1)
    return np.linalg.solve(f / n + 1e-4 * np.eye(wide), g / n) / (spread / n + 1e-4)


def stepped(w: dict[str, np.ndarray], step: np.ndarray, share: float) -> dict[str, np.ndarray]:
    return w | {"u": (w["u"] + share * step[:-1]).astype("f4"), "b": (w["b"] + share * step[-1]).astype("f4")}


def cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells of an array: the numbers between each two of ends."""
    if ends[-1] * data.itemsize > 2**31 - 1:
        raise ValueError("a text is too long for an Arrow batch")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))])


class Lines:
    """Texts that were turned into numbers, laid end to end: frequent words have their numbers, a text's other words are -1,
    -2, ... in the order of its own lists."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, classes: np.ndarray, cluster: np.ndarray):
        self.flat, self.sizes, self.classes, self.cluster, self.fixed = flat, np.diff(np.append(starts, len(flat))), classes, cluster, len(starts)

    def groups(self, seq: pa.Array, kinds: pa.Array, sizes: pa.Array, pieces: pa.Array) -> Iterator[tuple]:
        """(first row, inputs, classes of the targets, owners, subword rows and their number of each word that is not frequent)
        of about AT_ONCE positions."""
        lines = [np.frombuffer(x.as_py(), "<i4") for x in seq]
        first = 0
        while first < len(lines):
            last, size = first, 0
            while last < len(lines) and (last == first or size < AT_ONCE):
                size += len(lines[last]) + STRIDE
                last += 1
            kind, n, rows = (np.frombuffer(b"".join(c.slice(first, last - first).to_pylist()), t) for c, t in ((kinds, "<u2"), (sizes, "<i4"), (pieces, "<u2")))
            classes = np.concatenate([self.classes, self.cluster[kind]])
            texts, at = [], self.fixed
            for line, own in zip(lines[first:last], kinds.slice(first, last - first)):
                texts.append(np.where(line >= 0, line, at - 1 - line))
                at += len(own.as_py()) // 2
            into, target, owner = padded(texts)
            yield first, into, np.where(target >= 0, classes[np.maximum(target, 0)], -1), owner, rows.astype(np.int64), n.astype(np.int64)
            first = last


def cuts(positions: int, blocks: int) -> Iterator[tuple[slice, slice]]:
    """So many blocks at a time of a padded sequence: with the block before them, and without."""
    for a in range(STRIDE, positions, blocks * STRIDE):
        b = min(a + blocks * STRIDE, positions)
        yield slice(a - STRIDE, b), slice(a, b)


class Sequences(Lines):
    """The model's input from texts that were turned into numbers."""

    def __init__(self, w: dict[str, np.ndarray], flat: np.ndarray, starts: np.ndarray, classes: np.ndarray, cluster: np.ndarray):
        super().__init__(flat, starts, classes, cluster)
        self.w = w
        self.vectors = self._means(self.flat, self.sizes)  # and behind them room for those of a group's other words

    def _means(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.cumsum(sizes) - sizes
        return (np.add.reduceat(self.w["e"][rows], starts) / sizes[:, None]).astype("f4") if len(sizes) else np.zeros((0, WIDTH), "f4")

    def parts(self, seq: pa.Array, kinds: pa.Array, sizes: pa.Array, pieces: pa.Array) -> Iterator[tuple]:
        """(first row, vectors, which is padding's opposite, class of each position but the first block's, owner)."""
        for first, into, label, owner, rows, n in self.groups(seq, kinds, sizes, pieces):
            if self.fixed + len(n) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors[: self.fixed], np.zeros((2 * len(n), WIDTH), "f4")])
            self.vectors[self.fixed : self.fixed + len(n)] = self._means(rows, n)
            for whole, own in cuts(len(into), PASS):
                yield first, self.vectors[into[whole]], into[whole] != PAD, label[own], owner[own]


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a, which of them each place holds, the order that sorts a, and where each value begins in it."""
    both = np.sort(a.astype(np.int64) << 32 | np.arange(len(a)))  # several times as fast as a stable argsort; a is not negative
    found, order = both >> 32, both & 0xFFFFFFFF
    new = np.concatenate([[True], found[1:] != found[:-1]])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    begin = np.nonzero(new)[0]
    return found[begin], back, order, begin


class Learner(Lines):
    """A copy of the weights that takes an Adam step for every STEP blocks of the texts it is given; vectors of subword ids
    take part in the steps that meet them."""

    def __init__(self, w: dict[str, np.ndarray], flat: np.ndarray, starts: np.ndarray, classes: np.ndarray, cluster: np.ndarray):
        super().__init__(flat, starts, classes, cluster)
        self.first, self.begin = w, np.cumsum(self.sizes) - self.sizes
        self.anew()

    def anew(self) -> None:
        self.w = {k: v.copy() for k, v in self.first.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        self.met = np.zeros(len(self.w["e"]), np.int64)
        self.steps = self.learned = 0

    def learn(self, seq: pa.Array, kinds: pa.Array, sizes: pa.Array, pieces: pa.Array) -> None:
        for _, into, label, _, rows, n in self.groups(seq, kinds, sizes, pieces):
            flat, n = np.concatenate([self.flat, rows]), np.concatenate([self.sizes, n])
            begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n[self.fixed :]) - n[self.fixed :]])
            for whole, own in cuts(len(into), STEP):
                self._step(into[whole], label[own], flat, begin, n)

    def _step(self, into: np.ndarray, label: np.ndarray, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
        word, back, order, at = runs(into)
        n = sizes[word]
        start = np.cumsum(n) - n
        row = flat[np.arange(n.sum()) + np.repeat(begin[word] - start, n)]
        x = (np.add.reduceat(self.w["e"][row], start) / n[:, None]).astype("f4")
        grads, dx = gradients(self.w, x[back], into != PAD, label)
        dx = np.repeat(np.add.reduceat(dx[order], at) / n[:, None].astype("f4"), n, axis=0)
        row, _, order, at = runs(row)
        rate = RATE / math.sqrt(1 + self.steps / SLOWER)
        self.steps += 1
        self.learned += int((label >= 0).sum())
        self.met[row] += 1
        for k, g, some in [*((k, g, ...) for k, g in grads.items()), ("e", np.add.reduceat(dx[order], at), row)]:
            t = self.met[row][:, None] if k == "e" else self.steps
            m, v = self.m[k][some], self.v[k][some]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            if k == "e":
                self.m[k][some], self.v[k][some] = m, v
            size, spread = (np.asarray(x, "f4") for x in (rate / (1 - 0.9**t), 1 / (1 - 0.99**t)))
            self.w[k][some] -= size * m / (np.sqrt(v * spread) + np.float32(1e-8))

    def sums(self) -> np.ndarray:
        """All weights times what they learned from: positions, and for the vector of a subword id the steps that met it."""
        flat = [self.w[k].ravel() * np.float32(self.learned) for k in SHARED]
        return np.concatenate([*flat, [self.learned], (self.w["e"] * self.met[:, None]).ravel(), self.met]).astype("<f4")


def added(replicas: pa.Table) -> pa.Table:
    """The sum of the slices (at, x) of one number; as float64."""
    total = sum(np.frombuffer(x, "<f4").astype("<f8") for x in replicas["x"].to_pylist())
    return pa.table({"at": replicas["at"].slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})


def mean(w: dict[str, np.ndarray], sums: np.ndarray) -> dict[str, np.ndarray]:
    """The weights from the summed sums() of replicas; subword ids that no replica met say nothing."""
    at, out = 0, {}
    every = sum(w[k].size for k in SHARED)
    for k in SHARED:
        out[k] = (sums[at : at + w[k].size] / max(sums[every], 1)).reshape(w[k].shape).astype("f4")
        at += w[k].size
    e, met = np.split(sums[every + 1 :], [w["e"].size])
    return out | {"e": (e.reshape(w["e"].shape) / np.maximum(met, 1)[:, None]).astype("f4")}


# --- the operator ---------------------------------------------------------------------------------------------------


def scored(docs: DataFrame, tokenizer: str, learn_from, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of each row; learn_from: a column that
    holds for the rows to learn from."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(tokenizer, "rb") as f:
        spec = f.read()
    rows = docs.select(F.col(doc_id).alias("doc_id"), common.utf8(text).alias("body"), learn_from.alias("learn"))
    learning = rows.where("learn").select("body")
    counts = common.stored(word_counts(learning), "counts")
    ends = learning.count()
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = total + ends, kinds + (ends > 0)
    # the frequent words are those from a count on which no more than FREQUENT words reach; the counts are looked up by eighths
    # of powers of two
    short, level = counts.where(F.length("word") <= LONGEST), F.floor(F.log2("c") * 8)
    reach, cut = 0, None
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        reach += r["n"]
        if reach > FREQUENT:
            break
        cut = r["level"]
    top = short.where(level >= F.lit(cut)).toPandas().sort_values(["c", "word"], ascending=[False, True]) if cut is not None else None
    frequent, often = ([bytes(x) for x in top["word"]], top["c"].to_numpy().astype(float)) if top is not None else ([], np.zeros(0))
    own = frequent[:OWN]
    shared = spark.sparkContext.broadcast((spec, frequent))
    key = "words " + hashlib.sha256(spec + b"\0".join(frequent)).hexdigest()
    bottom = math.log10(n + SMOOTH * (v + 1))
    logs = np.log10(np.concatenate([[1.0, 1.0, ends + SMOOTH], often + SMOOTH]))
    value_of = spark.sparkContext.broadcast(logs)
    names = ["doc_id", "learn", "mark", "n_tokens", "n_known", "n_common", "value", "seq", "kinds", "sizes", "pieces", "rare", "company"]
    schema = "doc_id long, learn boolean, mark long, n_tokens long, n_known long, n_common long, value double, seq binary, kinds binary, sizes binary, pieces binary, rare array<struct<word: binary, m: long>>, company binary"
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int64())]))

    kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), rare_type)
    signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0], "f4"), (BUCKETS, SKETCH))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.resident(key, lambda: Words(*shared.value, [], np.arange(BUCKETS) - 1 - OWN))  # a word's bucket in the place of its class
        fixed, logs = words.fixed, value_of.value
        sums = np.zeros((BUCKETS, SKETCH + 1))
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, size = [], 0
                while first + len(texts) < batch.num_rows and (not texts or size < AT_ONCE):
                    texts.append(tokens(batch.column(3)[first + len(texts)].as_py()))
                    size += len(texts[-1]) + STRIDE
                found = words.learned(texts)
                lens = np.fromiter(map(len, texts), np.int64, len(texts))
                owner = np.repeat(np.arange(len(texts)), lens)
                buckets, ends_of = words.classes_of(found), np.append(0, np.cumsum(lens))
                learn = batch.column(1).slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                for a in range(0, len(texts), TEXTS):
                    some, b = slice(ends_of[a], ends_of[min(a + TEXTS, len(texts))]), min(a + TEXTS, len(texts))
                    n_of = np.bincount((owner[some] - a) * BUCKETS + buckets[some], minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
                    n_of = n_of[learn[a:b]].astype("f4")
                    sums[:, 0] += n_of.sum(0, dtype=float)
                    sums[:, 1:] += n_of.T @ (n_of @ signs / np.maximum(lens[a:b][learn[a:b], None], 1).astype("f4"))
                often = found < fixed
                rare = np.nonzero(~often)[0]
                both, back, m = np.unique(owner[rare] << 32 | found[rare], return_inverse=True, return_counts=True)
                some, begin = both & 0xFFFFFFFF, np.searchsorted(both >> 32, np.arange(len(texts) + 1))  # each text's own in order
                line = found.astype("<i4")
                line[rare] = -1 - (back - begin[owner[rare]])
                rows_of, _, sizes = words.pieces(some) if len(some) else (np.zeros(0, np.intc),) * 3
                common_ = lens - np.bincount(owner[rare], minlength=len(texts))
                value = np.bincount(owner[often], logs[found[often]], len(texts)) + logs[STOP]
                names_of = pa.array([words.names[i] for i in some.tolist()], pa.binary())
                columns = [
                    *map(pa.array, (lens + 1, common_ + (ends > 0), common_ + 1, value)), cells(line, ends_of), cells(words.classes_of(some).astype("<u2"), begin), cells(sizes.astype("<i4"), begin),
                    cells(rows_of.astype("<u2"), np.append(0, np.cumsum(sizes))[begin]), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.StructArray.from_arrays([names_of, pa.array(m, pa.int64())], fields=list(rare_type.value_type))),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in (0, 1, 2)), *columns, pa.nulls(len(texts), pa.binary())], names=names)
                first += len(texts)
                if words.full:
                    words.reset()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.int64(), *kinds_of)] + [pa.array([sums.astype("<f4").tobytes()], pa.binary())], names=names)

    parts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "learn", F.xxhash64("doc_id", "body").alias("mark"), "body").mapInArrow(numbered, schema)
    parts = common.stored(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    cluster = clusters(company(parts.where("company is not null").select("company")), CLASSES - OWN - 1)
    parts = parts.where("company is null").drop("company")
    # totals of the classes, over all words
    at = F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")), F.lit(BUCKETS))
    by = {r["at"]: (r["c"], r["v"]) for r in counts.groupBy(at.alias("at")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    size, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for b, (c, k) in by.items():
        size[cluster[b] + 1 + OWN] += c
        types[cluster[b] + 1 + OWN] += k
    for i, w in enumerate(own):
        size[cluster[bucket(w)] + 1 + OWN] -= often[i]
        types[cluster[bucket(w)] + 1 + OWN] -= 1
        size[i + 1], types[i + 1] = often[i], 1
    size[0], types[0] = ends, ends > 0
    share = np.log10(size + SMOOTH * (types + 1))
    weights = new_weights(size + SMOOTH)
    lists = Words(spec, frequent, own, cluster)
    flat, starts, classes = np.array(lists.flat), np.array(lists.starts)[:-1], np.array(lists.classes)
    key = f"{key} {uuid.uuid4().hex}"
    class_of = cluster + 1 + OWN
    columns = ["seq", "kinds", "sizes", "pieces"]
    if ends:
        shards = max(1, min(SHARDS, round(n / SHARD)))
        # all learning rows, dealt and put in order by what they hold; copies with ids of their own are dealt out
        dealt = parts.where("learn").select(F.pmod("mark", F.lit(shards)).alias("shard"), "mark", "doc_id", *columns).repartition("shard").sortWithinPartitions("shard", "mark", "doc_id").select("shard", *columns)
        for turn in range(max(1, min(ROUNDS, -(-ENOUGH // n)))):
            now = spark.sparkContext.broadcast((weights, flat, starts, classes, class_of))

            def replicas(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
                learner = common.resident(f"{key} turn {turn}", lambda: Learner(*now.value))
                shard, held, size = None, [], 0

                def out() -> Iterator[pa.RecordBatch]:
                    sums = learner.sums()
                    for at in range(0, len(sums), SLICE):
                        yield pa.RecordBatch.from_arrays([pa.array([at // SLICE], pa.int32()), pa.array([sums[at : at + SLICE].tobytes()], pa.binary())], names=["at", "x"])

                for batch in batches:
                    for of, *row in zip(*(c.to_pylist() for c in batch.columns)):
                        if held and (of != shard or size >= AT_ONCE):  # so that steps don't depend on batches
                            learner.learn(*(pa.array(c, pa.binary()) for c in zip(*held)))
                            held, size = [], 0
                        if of != shard:
                            if shard is not None:
                                yield from out()
                            shard = of
                            learner.anew()
                        held.append(row)
                        size += len(row[0]) // 4 + STRIDE
                if held:
                    learner.learn(*(pa.array(c, pa.binary()) for c in zip(*held)))
                if shard is not None:
                    yield from out()

            got = dealt.mapInArrow(replicas, "at int, x binary").groupBy("at").applyInArrow(added, "at int, x binary").toPandas().sort_values("at")
            weights = mean(weights, np.concatenate([np.frombuffer(x, "<f8") for x in got["x"]]))
    model = spark.sparkContext.broadcast((weights, flat, starts, classes, class_of))
    log10e = math.log10(math.e)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = common.resident(f"{key} last", lambda: Sequences(*model.value))
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, x, real, label, owner in sequences.parts(*batch.columns[1:]):
                got = log_classes(sequences.w, x, real, label).astype(float) * log10e - np.where(label >= 0, share[np.maximum(label, 0)], 0)
                out[first:] += np.bincount(owner, got, len(out) - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["row", "model"])

    model_sums = parts.select("row", *columns).mapInArrow(score, "row long, model double")
    tail = parts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.m")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    sums = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("m") * log_c).alias("tail"), F.sum("m").alias("m"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known"))
    tail_sum, m, known = (F.coalesce(c, F.lit(0)) for c in ("tail", "m", "known"))
    return parts.select("row", "doc_id", "n_tokens", "n_known", "n_common", "value").join(model_sums, "row").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("value") + tail_sum - (F.col("n_common") + m) * F.lit(bottom)).alias("base_score"), (F.col("model") + F.col("value") + tail_sum).alias("score"),
    )
