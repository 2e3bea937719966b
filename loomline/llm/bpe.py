"""BPE encoding and decoding.

Encoding walks a word left to right. One Aho-Corasick scan gives the longest token at each position; a token is kept if
it forms a compatible pair with the token before it, else shorter prefix tokens are tried, else the walk backs up. A pair
is compatible if encoding its joined string gives the pair itself, and a sequence whose neighbours are all compatible is
the one that the merge rules give, so the result is exact and no position is entered twice after it was given up.
Decoding copies slices of one string of all tokens, found by an offset table.

Cases: null and empty text give no ids. Repeated rows are encoded each. Texts of any length are encoded whole. Columns of
the input with clashing names are replaced by the new ones.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

END = "\0"  # stands for the end-of-word mark while matching
#: Types of the normalizers and pre-tokenizers of the tokenizers that are supported.
FORM = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
CACHE = 500_000  # chunks that a worker remembers
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


class Bpe:
    """Tables of one tokenizer file and the encoder over them."""

    def __init__(self, spec: bytes):
        import ahocorasick
        import regex

        d = json.loads(spec)
        steps = tuple([x["type"] for x in (d.get(a) or {}).get(b, [])] for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if steps != FORM:
            raise ValueError(f"a tokenizer with the steps {steps} is not supported, only {FORM}")
        model = d["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.text = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.text |= {i: t for t, i in self.special.items()}
        vocab = model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        self.time: dict[int, int] = {}  # when a token comes to be: its merge's rank; letters are there from the start
        for rank, (a, b) in enumerate(model["merges"]):
            t = vocab[a + b]
            self.joined[vocab[a] << 32 | vocab[b]] = rank
            if t not in self.parts:
                self.parts[t], self.time[t] = (vocab[a], vocab[b]), rank
        self.pairs: dict[int, bool] = {}
        plain = {i: self._plain(t) for t, i in vocab.items()}
        whole = {i for i in plain if i not in self.parts}
        for t in sorted(self.parts, key=self.time.__getitem__):
            a, b = self.parts[t]
            if a in whole and b in whole and self._apart(a, b, self.time[t]):
                whole.add(t)
        self.size = {i: len(plain[i]) for i in whole}
        by_text = {plain[i]: i for i in whole}
        self.shorter: dict[int, int] = {}
        for i in whole:
            s = plain[i]
            self.shorter[i] = next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), -1)
        self.automaton = ahocorasick.Automaton()
        for s, i in by_text.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        top = max(self.text) + 1
        self.letters = byte_letters()
        names = [self.text.get(i, "") for i in range(top)]
        self.names = names
        self.decimal = [str(i) for i in range(top)]
        self.all_text = "".join(names)
        self.offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])]).tolist()
        self.slices = [self.all_text[a:b] for a, b in zip(self.offsets, self.offsets[1:])]
        self.words: dict[str, bytes] = {}
        self.open = commonprefix(list(self.special)).encode() if self.special else b"\0"  # a chunk without it holds no special token
        self.chunks = Remembered()
        pattern = next(x["pattern"]["Regex"] for x in d["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _plain(self, t: str) -> str:
        return t[: -len(self.mark)] + END if self.mark and t.endswith(self.mark) else t

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether the rules up to (not including) rank `until` leave a boundary between a and b standing.

        The last merges on both sides of the boundary are taken back in turn, latest first; whatever touches the boundary
        then stood there until that merge. Of equal ranks the left one comes first."""
        joined, parts, time = self.joined, self.parts, self.time
        while True:
            rank = joined.get(a << 32 | b)
            if rank is not None and rank < until:
                return False
            ta, tb = time.get(a, -1), time.get(b, -1)
            if ta < 0 and tb < 0:
                return True
            if ta > tb:
                until, a = ta, parts[a][1]
            else:
                until, b = tb + 1, parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CACHE // 2:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(a, b, 1 << 60)
        return found

    def word(self, letters: str) -> list[int]:
        """Ids of one pre-token, given in byte letters."""
        s = letters + END if self.mark else letters
        n = len(s)
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(s):
            longest[end - size + 1] = i
        size, shorter, compatible = self.size, self.shorter, self.compatible
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and not (open_[at + size[token]] and (not out or compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out

    def chunk(self, raw: bytes) -> bytes:
        """Ids of a piece of text without ASCII white space, as little-endian 32-bit numbers."""
        if self.open not in raw:
            # a run of ASCII letters is a pre-token, and full stops or commas behind it are others
            low = raw.lower()
            core = low.rstrip(b".,")
            if core.isalpha():
                ids, tail = self.known_word(core.decode()), low[len(core) :]
                return ids + self.mixed(tail) if tail else ids
        return self.mixed(raw)

    def known_word(self, w: str) -> bytes:
        if (ids := self.words.get(w)) is None:
            if len(self.words) > CACHE // 2:
                self.words.clear()
            letters = w if w.isascii() and w.isprintable() else "".join(map(self.letters.__getitem__, w.encode()))
            ids = self.words[w] = packed(self.word(letters))
        return ids

    def mixed(self, raw: bytes) -> bytes:
        """Ids of any text, by the steps of the tokenizer."""
        text, out = raw.decode("utf-8", "replace"), []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(packed([self.special[part]]))
                continue
            part = unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            out += map(self.known_word, self.pattern.findall(part))
        return b"".join(out)

    def encode(self, text: bytes) -> np.ndarray:
        # no pre-token spans ASCII white space, so chunks between it can be encoded alone
        return np.frombuffer(self.chunks.joined(text.split(), self._learn), "<u4")

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        return [self.chunk(c) for c in missing]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by a space: what a tokenizer without a decoder gives."""
        return " ".join(map(self.slices.__getitem__, ids))


class Remembered:
    """Ids of the chunks that were met last: two generations of CACHE / 2 each, so chunks in use stay."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def joined(self, chunks: list[bytes], learn) -> bytes:
        """The ids of chunks one after the other; learn gives those of a list of unknown ones."""
        young, old = self.young, self.old
        try:
            return b"".join(map(young.__getitem__, chunks))
        except KeyError:
            pass
        missing = []
        for c in set(chunks):
            if c not in young:
                known = old.get(c)
                if known is None:
                    missing.append(c)
                else:
                    young[c] = known
        if missing:
            young.update(zip(missing, learn(missing)))
        out = b"".join(map(young.__getitem__, chunks))
        if len(young) > CACHE // 2:
            self.young, self.old = {}, young
        return out


def model(key: str, spec: bytes) -> Bpe:
    """The worker's model of that file; kept for later tasks of the operator."""
    return common.resident("bpe " + key, lambda: Bpe(spec))


def _spec(spark, path: str):
    with open(path, "rb") as f:
        spec = f.read()
    return spark.sparkContext.broadcast(spec), hashlib.sha256(spec).hexdigest()


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", n: str = "n_tokens", ids_sha256: str = "ids_sha256", decoded_sha256: str = "decoded_sha256", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode a text column and decode the ids again.

    Adds the ids (array of int, unless with_ids is False), their number, the SHA-256 of the decimal ids joined by one
    space and that of the decoded text. keep: the input columns to carry along (default: all). The tokenizer file's path
    is read on the driver and its bytes are broadcast: they don't grow with the data."""
    spark = docs.sparkSession
    common.ship(spark)
    spec, key = _spec(spark, tokenizer)
    new = [n, ids_sha256, decoded_sha256] + [ids] * with_ids
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {x.lower() for x in new}]
    body = common.fresh(docs, "_utf8")
    source = docs.select(*[docs[c] for c in kept], common.utf8(text).alias(body))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(n, T.LongType()), T.StructField(ids_sha256, T.StringType()), T.StructField(decoded_sha256, T.StringType())] + [T.StructField(ids, T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(key, spec.value)
        for batch in batches:
            sizes, first, second, flat = [], [], [], []
            for raw in batch.column(batch.num_columns - 1):
                got = m.encode(raw.as_py())
                numbers = got.tolist()
                sizes.append(len(numbers))
                first.append(hashlib.sha256(" ".join(map(m.decimal.__getitem__, numbers)).encode()).hexdigest())
                second.append(hashlib.sha256(m.decode(numbers).encode()).hexdigest())
                if with_ids:
                    flat.append(got.astype("<i4"))
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(sizes)])
                if ends[-1] > 2**31 - 1:
                    raise ValueError("a batch holds more ids than an Arrow list can: lower spark.sql.execution.arrow.maxRecordsPerBatch")
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
