"""Token counts by dynamic programming over a trie.

The distinct pre-tokens that a worker has not met yet, of many texts at once, are put in a trie. Each node has the best
unigram score of its prefix over all segmentations into pieces of a fixed public vocabulary, and the number of pieces of that
segmentation; a node is computed once for all pre-tokens that share it, level by level, and a pre-token's count is stored at
its end. A document's count is the sum over its pre-tokens.

A pre-token is a run of characters other than ASCII white space, with a word mark before it. The vocabulary's file holds no
unigram probabilities (it is one of merges): a piece's log-probability follows Zipf's law in its place, which is the order of
frequency. A character that no piece has costs its UTF-8 bytes as tokens. Of equal scores the segmentation whose last piece is
shorter is taken. Pre-tokens of more than pieces.LONG characters share no prefixes: their scores are computed one by one.

Cases: null and empty texts have no token. Repeated rows are counted each; texts of any length are counted whole.
Clashing column names of the input are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .pieces import LONG, MARK, Vocabulary, load

CACHE = 64 << 20  # bytes of counts that a worker remembers
AT_ONCE = 4 << 20  # bytes of text whose pre-tokens share a trie
BYTE_PENALTY = -10.0  # added for each byte of an unknown character, below the rarest piece


class Counter:
    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        n = len(self.vocabulary.pieces)
        norm = math.log(sum(1 / (i + 2) for i in range(n)))
        self.logp = np.array([-math.log(i + 2) - norm for i in range(n)])
        self.byte = float(self.logp[-1]) + BYTE_PENALTY
        self.known = common.Recent(2, CACHE)

    def learn(self, missing: list[bytes]) -> dict[bytes, tuple[int, float]]:
        """(tokens, score) of each pre-token."""
        return {w: (int(n), s) for w, (n, s) in zip(missing, self.rows(missing).tolist())}

    def rows(self, missing: list[bytes]) -> np.ndarray:
        words = [MARK + w.decode("utf-8", "replace") for w in missing]
        out = np.zeros((len(words), 2))
        for block in self.vocabulary.blocks(words):
            out[block] = self.trie([words[i] for i in block])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.long(w)
        return out

    def trie(self, words: list[str]) -> np.ndarray:
        """(tokens, score) of sorted words."""
        room = sum(map(len, words)) + 1
        score, count, ends = np.zeros(room), np.zeros(room, np.int64), np.zeros(len(words), np.int64)
        for level in self.vocabulary.levels(words, ends):
            best, tokens = np.full(len(level.codes), -math.inf), np.zeros(len(level.codes), np.int64)

            def take(at: np.ndarray, s: np.ndarray, n: np.ndarray) -> None:
                more = s > best[at]
                best[at[more]], tokens[at[more]] = s[more], n[more]

            for at, start, k in level.edges:
                take(at, score[start] + self.logp[k], count[start] + 1)
            at = level.lacking()
            size = 1 + np.searchsorted([0x80, 0x800, 0x10000], level.codes[at], "right")  # bytes of the character
            take(at, score[level.parent[at]] + size * self.byte, count[level.parent[at]] + size)
            here = slice(level.first, level.first + len(best))
            score[here], count[here] = best, tokens
        return np.column_stack([count[ends], score[ends]])

    def long(self, word: str) -> tuple[int, float]:
        """The same for one word, with no more than the last scores held."""
        place, sizes, keep = self.vocabulary.place, self.vocabulary.sizes, self.vocabulary.longest
        score, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            last = word[end - 1]
            best, tokens, single = -math.inf, 0, False
            for size in sizes.get(last, ()):
                if size > end:
                    break
                k = place.get(word[end - size : end])
                if k is not None:
                    single |= size == 1
                    s = score[-size] + self.logp[k]
                    if s > best:
                        best, tokens = s, count[-size] + 1
            if not single:
                n = len(last.encode("utf-8", "replace"))
                s = score[-1] + n * self.byte
                if s > best:
                    best, tokens = s, count[-1] + n
            score.append(best)
            count.append(tokens)
            if len(score) > 4 * keep:
                del score[:-keep], count[:-keep]
        return count[-1], score[-1]

    def texts(self, raw: list[bytes]) -> tuple[list[int], list[int], list[float]]:
        """Pre-tokens, tokens and scores of whole texts."""
        words = [x.split() for x in raw]
        got = self.known.sums(words, self.rows)
        return [len(w) for w in words], got[:, 0].astype(np.int64).tolist(), got[:, 1].tolist()

    def text(self, raw: bytes) -> tuple[int, int, float]:
        """The same of one text."""
        words, tokens, scores = self.texts([raw])
        return words[0], tokens[0], scores[0]


def counted(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_pretokens, n_tokens and logprob (natural logarithm) to each row."""
    spark = docs.sparkSession
    common.ship(spark)
    raw = load(vocabulary)
    model, key = spark.sparkContext.broadcast(raw), "counts " + hashlib.sha256(raw).hexdigest()
    new = {"n_pretokens": T.LongType(), "n_tokens": T.LongType(), "logprob": T.DoubleType()}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    body = common.fresh(docs, "_utf8")
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.resident(key, lambda: Counter(model.value))
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for texts in common.by_bytes(batch.column(batch.num_columns - 1), AT_ONCE):
                for column, part in zip(columns, counter.texts(texts)):
                    column += part
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64())))], names=schema.names)

    return docs.select(*[docs[c] for c in kept], common.utf8(text).alias(body)).mapInArrow(run, schema)
