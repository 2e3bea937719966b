"""Language identification by segmentation-marginalised unigrams.

For each language every piece of a fixed public vocabulary has a probability, learned by a few rounds of
expectation-maximisation from the words of labelled texts. A word's probability in a language is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. The predicted language has
the largest; the score is its posterior probability with equal priors, of the text taken at the length of one word.

The model is fitted on a bounded sample of labelled rows: about PER_LANGUAGE texts of each language, chosen by a hash of
their identifier, with all their words (but runs of over pieces.LONG letters). Every whole text is predicted.

Cases: null texts and texts without a letter get `und` and score 0. Rows with null language are not learned from but
predicted. Without any learning row everything is `und`. Of equal likelihoods the language first in order is taken.
Repeated rows are predicted alike. Clashing column names of the input are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pieces import LONG, MARK, Vocabulary, load

PER_LANGUAGE = 2_000
ROUNDS = 3
SMOOTH = 0.01  # count that each piece has beforehand
UNKNOWN = 1e-7  # probability of a character that no piece has
STEP = 200.0  # scale of the forward sums for each letter, so they stay near 1
CACHE = 64 << 20  # bytes of scores that a worker remembers
AT_ONCE = 4 << 20  # bytes of text whose words share a trie
#: ASCII other than letters parts words; case is folded in learn().
PART = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(chunk: bytes) -> list[str]:
    """The runs of letters in a chunk, in lower case."""
    low = chunk.decode("utf-8", "replace").lower()
    if low.isalpha():
        return [low]
    return "".join(c if c.isalpha() else " " for c in low).split()


def learn(vocabulary: Vocabulary, counts: dict[str, int]) -> np.ndarray:
    """Piece probabilities that make the counted words likely: expectation-maximisation on their trie, where a prefix is
    gone through once for all words that share it. Sums are scaled by STEP for each letter."""
    n = len(vocabulary.pieces)
    words = [MARK + w for w in counts]
    times = np.fromiter(counts.values(), float, len(counts))
    size = np.array([len(t) for t in vocabulary.pieces])
    tries = []
    for block in vocabulary.blocks(words):
        ends = np.zeros(len(block), np.int64)
        levels = list(vocabulary.levels([words[i] for i in block], ends))
        tries.append((levels, [x.lacking() for x in levels], ends, times[block], np.fromiter((len(words[i]) for i in block), float, len(block))))
    expected = np.full(n, SMOOTH)
    for levels, _, ends, c, letters in tries:  # at first a piece has its share of the letters of the words it stands in
        back = np.zeros(levels[-1].first + len(levels[-1].codes))
        np.add.at(back, ends, c / letters)
        for x in reversed(levels):
            here = back[x.first : x.first + len(x.codes)]
            for at, _, k in x.edges:
                expected += np.bincount(k, here[at] * size[k], n)
            np.add.at(back, x.parent, here)
    for _ in range(ROUNDS):
        p = expected / expected.sum() * STEP**size
        expected = np.full(n, SMOOTH)
        for levels, lacking, ends, c, _ in tries:
            forward = np.zeros(levels[-1].first + len(levels[-1].codes))
            forward[0] = 1
            for x, none in zip(levels, lacking):
                here = forward[x.first : x.first + len(x.codes)]
                for at, start, k in x.edges:
                    here[at] += p[k] * forward[start]
                here[none] += UNKNOWN * STEP * forward[x.parent[none]]
            # of each node, the sum over the words through it of count x what follows / the whole word
            back = np.zeros(len(forward))
            np.add.at(back, ends, np.divide(c, forward[ends], out=np.zeros(len(c)), where=forward[ends] > 1e-280))
            for x, none in zip(reversed(levels), reversed(lacking)):
                here = back[x.first : x.first + len(x.codes)]
                for at, start, k in x.edges:
                    part = here[at] * p[k]
                    expected += np.bincount(k, part * forward[start], n)
                    np.add.at(back, start, part)
                np.add.at(back, x.parent[none], here[none] * UNKNOWN * STEP)
    return expected / expected.sum()


class Scorer:
    """Log-probabilities of chunks in all languages; prefixes of the words of many texts share their forward sums."""

    def __init__(self, vocabulary: Vocabulary, probabilities: np.ndarray):
        self.vocabulary = vocabulary
        self.langs = probabilities.shape[0]
        sizes = np.array([len(t) for t in vocabulary.pieces])[:, None]
        self.log = np.log(probabilities.T)
        self.scaled = np.ascontiguousarray(probabilities.T * STEP**sizes)
        self.known = common.Recent(self.langs + 1, CACHE)

    def score(self, found: list[str]) -> dict[str, np.ndarray]:
        words = [MARK + w for w in set(found)]
        return dict(zip([w[1:] for w in words], self.logs(words)))

    def logs(self, words: list[str]) -> np.ndarray:
        """Log-probabilities [words, languages] of distinct words with their marks."""
        out = np.zeros((len(words), self.langs))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for block in self.vocabulary.blocks(words):
            got = self.trie([words[i] for i in block])
            with np.errstate(divide="ignore"):
                out[block] = np.log(got) - size[block, None] * math.log(STEP)
            # a word can fall below the smallest number: then its letters are scored one at a time
            for i in np.nonzero((got < 1e-280).any(axis=1))[0].tolist():
                out[block[i]] = self.long(words[block[i]])
        for i in np.nonzero(size > LONG)[0].tolist():
            out[i] = self.long(words[i])
        return out

    def trie(self, words: list[str]) -> np.ndarray:
        """Scaled probabilities of sorted words."""
        forward, ends = np.zeros((sum(map(len, words)) + 1, self.langs)), np.zeros(len(words), np.int64)
        forward[0] = 1
        for x in self.vocabulary.levels(words, ends):
            here = forward[x.first : x.first + len(x.codes)]
            for at, start, k in x.edges:
                here[at] += self.scaled[k] * forward[start]
            none = x.lacking()
            here[none] += UNKNOWN * STEP * forward[x.parent[none]]
        return forward[ends]

    def long(self, word: str) -> np.ndarray:
        """The forward algorithm in logarithms, with no more than the last sums held."""
        place, sizes, keep = self.vocabulary.place, self.vocabulary.sizes, self.vocabulary.longest
        path = [np.zeros(self.langs)]
        for end in range(1, len(word) + 1):
            terms, single = [], False
            for size in sizes.get(word[end - 1], ()):
                if size > end:
                    break
                k = place.get(word[end - size : end])
                if k is not None:
                    single |= size == 1
                    terms.append(self.log[k] + path[-size])
            if not single:
                terms.append(np.log(UNKNOWN) + path[-1])
            path.append(np.logaddexp.reduce(terms))
            if len(path) > keep + 1:
                path.pop(0)
        return path[-1]

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        """Of each chunk the sum over its words, and their number."""
        parts = [words(c) for c in chunks]
        kinds = list(set().union(*parts))
        place = dict(zip(kinds, range(len(kinds))))
        logs = self.logs([MARK + w for w in kinds])
        out = np.zeros((len(chunks), self.langs + 1))
        out[:, -1] = [len(p) for p in parts]
        owner = np.repeat(np.arange(len(chunks)), out[:, -1].astype(np.int64))
        which = np.fromiter((place[w] for p in parts for w in p), np.int64, len(owner))
        for i in range(self.langs):
            out[:, i] = np.bincount(owner, logs[which, i], len(chunks))
        return out

    def texts(self, raw: list[bytes]) -> np.ndarray:
        """Log-probability in each language, then the number of words, of each text."""
        return self.known.sums([x.translate(PART).split() for x in raw], self.rows)

    def text(self, raw: bytes) -> np.ndarray:
        return self.texts([raw])[0]


def fit(docs: DataFrame, vocabulary: str, learn_from, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities, from the rows for which learn_from holds."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & learn_from)
    sizes = rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("of"))
    few = rows.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), common.utf8(text).alias("body")).join(F.broadcast(sizes), "lang")
    few = few.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) * F.col("of") < F.lit(per_language * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            flat = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for k, body in zip(batch.column(0), batch.column(1)):
                counter = held.setdefault(k.as_py(), Counter())
                counter.update(w for c in body.as_py().translate(PART).split() for w in words(c))
                if sum(map(len, held.values())) > 200_000:
                    yield out()
        yield out()

    counts = few.select("lang", "body").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    by: dict[str, dict[str, int]] = {}
    for k, w, n in zip(table["lang"].to_pylist(), table["word"].to_pylist(), table["n"].to_pylist()):
        by.setdefault(k, {})[w] = n
    names = sorted(by)
    v = Vocabulary(load(vocabulary))
    return names, np.array([learn(v, by[k]) for k in names]).reshape(len(names), len(v.pieces))


def predict(docs: DataFrame, vocabulary: str, names: list[str], probabilities: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to each row."""
    spark = docs.sparkSession
    common.ship(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"lang_pred", "score"}]
    body = common.fresh(docs, "_utf8")
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    raw = load(vocabulary)
    shared, key = spark.sparkContext.broadcast((raw, probabilities.astype("f4"))), "languages " + hashlib.sha256(raw + probabilities.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = common.resident(key, lambda: Scorer(Vocabulary(shared.value[0]), shared.value[1].astype(float))) if names else None
        for batch in batches:
            found, sure = [], []
            for texts in common.by_bytes(batch.column(batch.num_columns - 1), AT_ONCE):
                for got in scorer.texts(texts) if scorer else [[0]] * len(texts):
                    if got[-1] == 0:
                        found.append("und")
                        sure.append(0.0)
                        continue
                    mean = got[:-1] / got[-1]
                    k = int(np.argmax(mean))
                    found.append(names[k])
                    sure.append(float(1 / np.exp(mean - mean[k]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=schema.names)

    return docs.select(*[docs[c] for c in kept], common.utf8(text).alias(body)).mapInArrow(run, schema)
