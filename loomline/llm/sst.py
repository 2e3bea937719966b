"""Token-ID output as sorted-string tables.

One file (shard) holds the documents of one range of identifiers in ascending order:

    block*   zstd frame of entries: varint(shared key bytes) varint(other key bytes) varint(value bytes) key value
    index    for each block: varint(key bytes) first key, varint(offset), varint(size), varint(entries)
    bloom    bit array; a key sets PROBES bits by double hashing of its XXH64
    footer   fixed size: offset and size of index, offset and size of bloom, entries, ids, bytes of an id, magic

Inside a block each key leaves out the bytes that it shares with the key before it. A lookup asks the Bloom filter,
finds the block by binary search in the index and reads that block alone. Keys are order-preserving: one byte 1 and the
identifier as a big-endian 64-bit number with its sign bit flipped; a null identifier is the byte 0, before all others.
A value is the ids of the document, two or four bytes each, little-endian.

Cases: null and empty text have the end id alone; null identifiers come first; repeated identifiers are kept side by
side, in the order of their texts; an empty table gives no shard. Other columns are not stored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import posixpath
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

BLOCK = 64 * 1024
TAIL = string.punctuation.encode()
BITS_PER_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<QQQQQQI8s")
MAGIC = b"LOOMSST1"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    step = h >> 33 | 1
    return [(h + i * step) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width, self.pack = sink, width, zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.first, self.rows = bytearray(), b"", b"", 0
        self.index, self.keys, self.at, self.ids = [], [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.rows:
            self.first, self.last = key, b""
        shared = len(os.path.commonprefix([self.last, key]))
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, len(value))
        self.block += key[shared:]
        self.block += value
        self.last, self.rows = key, self.rows + 1
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _write(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self) -> None:
        if self.rows:
            at = self.at
            self.index.append((self.first, at, self._write(self.pack.compress(bytes(self.block))), self.rows))
            self.block, self.rows = bytearray(), 0

    def close(self) -> tuple[int, int, int]:
        """Entries, ids and bytes of the shard."""
        self._flush()
        out = bytearray()
        for first, at, size, rows in self.index:
            put_varint(out, len(first))
            out += first
            for n in (at, size, rows):
                put_varint(out, n)
        index_at, index_size = self.at, self._write(bytes(out))
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for b in _probes(k, len(bloom) * 8):
                bloom[b >> 3] |= 1 << (b & 7)
        bloom_at, bloom_size = self.at, self._write(bytes(bloom))
        self._write(FOOTER.pack(index_at, index_size, bloom_at, bloom_size, len(self.keys), self.ids, self.width, MAGIC))
        return len(self.keys), self.ids, self.at


class Reader:
    """Reads one shard from a file that can seek."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        index_at, index_size, self.bloom_at, self.bloom_size, self.entries, self.ids, self.width, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, at, self.index = self._read(index_at, index_size), 0, []
        while at < len(raw):
            n, at = get_varint(raw, at)
            first, at = raw[at : at + n], at + n
            where, at = get_varint(raw, at)
            size, at = get_varint(raw, at)
            rows, at = get_varint(raw, at)
            self.index.append((first, where, size, rows))
        self.firsts = [x[0] for x in self.index]
        self.bloom: bytes | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, where, size, rows = self.index[k]
        data = self.unpack.decompress(self._read(where, size))
        at, key = 0, b""
        for _ in range(rows):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, key: bytes) -> list[bytes]:
        """The values under a key; reads the blocks that can hold it and no other."""
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, self.bloom_size)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key, self.bloom_size * 8)):
            return []
        out, k = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.index) and self.firsts[k] <= key:
            out += [v for found, v in self.block(k) if found == key]
            k += 1
        return out


class Library:
    """The tokenizers library, asked once for each distinct chunk of text.

    Under the normalizers and pre-tokenizers of bpe.FORM, pre-tokens never span ASCII white space, and ASCII case and a tail of
    ASCII punctuation behind a letter or digit change nothing but their own pre-tokens, so whole texts are put together from the ids
    of their chunks; a chunk that is one run of letters is one pre-token, and goes to the library's model without the
    steps before it. With any other tokenizer whole texts are encoded."""

    def __init__(self, spec: bytes, remember: int = bpe.CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_str(spec.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        self.marks = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.open = os.path.commonprefix(self.marks) if self.marks else b"\0"  # a chunk without it holds no mark
        d = json.loads(spec)
        steps = tuple([x["type"] for x in (d.get(a) or {}).get(b, [])] for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.in_chunks = steps == bpe.FORM
        self.letters = "".join(bpe.byte_letters())
        self.chunks = bpe.Remembered()
        self.cores: dict[bytes, bytes] = {}
        self.kept: dict[bytes, bytes] = {}
        self.remember = remember

    def keep(self) -> None:
        """Remember the chunks known now for good, besides `remember` others."""
        self.kept = dict(self.cores)

    def _pretoken(self, core: bytes) -> str | None:
        """The one pre-token of a core that is a run of letters, in byte letters; None for other cores."""
        text = core.decode("utf-8", "replace")
        low = text.lower()
        if low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
            return low.encode().decode("latin-1").translate(self.letters)
        return None

    def learn(self, missing: list[bytes]) -> list[bytes]:
        cores, tokenize, packed = self.cores, self.lib.model.tokenize, bpe.packed
        if len(cores) - len(self.kept) + len(missing) > self.remember:
            cores.clear()
            cores.update(self.kept)
        parts, mixed, opened, pretoken = [], {}, self.open, self._pretoken
        for chunk in missing:
            low = chunk.lower()
            core = low.rstrip(TAIL)
            if opened in chunk:
                core, tail, one = chunk, b"", None
            elif core.isalpha():  # ASCII letters: what most chunks are
                tail, one = low[len(core) :], core.decode()
            else:
                tail, one = low[len(core) :], pretoken(core)
                if one is None and not core[-1:].isalnum():  # nothing known ends where the tail begins
                    core, tail = low, b""
            if core not in cores:
                if one is None:
                    mixed[core] = None
                else:
                    cores[core] = packed([t.id for t in tokenize(one)])
            if tail and tail not in cores:
                mixed[tail] = None
            parts.append((core, tail))
        mixed = list(mixed)
        for a in range(0, len(mixed), 2000):
            some = mixed[a : a + 2000]
            for w, e in zip(some, self.lib.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                cores[w] = packed(e.ids)
        return [cores[a] + cores[b] if b else cores[a] for a, b in parts]

    def encode(self, text: bytes) -> bytes:
        if not self.in_chunks:
            return np.array(self.lib.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return self.chunks.joined(text.split(), self.learn)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Encode whole texts, append end_id to each, and write shards in ascending order of the identifier.

    folder: a path that driver and executors share. The table is dealt out by ranges of the identifier, so each task
    writes one shard; a task that runs again replaces its shard with the same bytes under the same name. Returns path,
    entries and ids of each shard, in order: a row for each partition, whatever the number of documents."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(tokenizer, "rb") as f:
        raw = f.read()
    spec, model = spark.sparkContext.broadcast(raw), "library " + hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = common.resident(model, lambda: Library(spec.value))
        width = 2 if max(library.lib.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        end = np.uint32(end_id).tobytes()
        task = TaskContext.get()
        fs, root = _files(folder)
        name = posixpath.join(root, f"shard-{task.partitionId():08d}.sst")
        draft, writer, sink = f"{name}.{task.taskAttemptId()}.draft", None, None
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(draft)
                    writer = Writer(sink, width)
                ids = library.encode(raw.as_py()) + end
                writer.add(key_of(key), ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        if writer is not None:
            rows, ids, _ = writer.close()
            sink.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([ids], pa.int64())], names=["path", "rows", "ids"])

    body = common.fresh(docs, "_utf8")
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), common.utf8(text).alias(body))
    done = rows.repartitionByRange("key").sortWithinPartitions("key", body).mapInArrow(run, "path string, rows long, ids long")
    return sorted((r["path"], r["rows"], r["ids"]) for r in done.collect())


def read(spark, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Read the shards back: one row per document with doc_id, start, n_tokens and the CRC-32 of its ids.

    start counts the ids of all documents before it; the sums over earlier shards come from the list of shards."""
    common.ship(spark)
    starts, total = [], 0
    for path, _, ids in shards:
        starts.append((path, total))
        total += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, end_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(folder)
        kinds = (pa.int64(),) * 5

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "end_id"])

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                with fs.open_input_file(path) as source:
                    reader = Reader(source)
                    for key, value in reader:
                        ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids), int(ids[-1])))
                        start += len(ids)
                        if len(out) == 4096:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    listed = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return listed.mapInArrow(run, schema)


def lookup(folder: str, shards: list[tuple[str, int, int]], doc_id: int | None) -> list[list[int]]:
    """The ids stored under an identifier, by Bloom filter and binary search in each shard."""
    fs, _ = _files(folder)
    out = []
    for path, _, _ in shards:
        with fs.open_input_file(path) as source:
            r = Reader(source)
            out += [np.frombuffer(v, f"<u{r.width}").tolist() for v in r.get(key_of(doc_id))]
    return out
