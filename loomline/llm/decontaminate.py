"""Benchmark decontamination.

Test items are cut into windows of consecutive words; all windows stand in one Aho-Corasick automaton over normalised
text (ASCII case folded, words joined by one space). Each document is normalised the same way and scanned once; a match
is mapped from the normalised text to the words it covers, and from there to offsets of the original.

Cases: null texts have no words; an item without words has no window; an item of fewer words than a window is one
window; items with equal windows are all named; a null item_id is not named but its windows count; repeated rows are
scanned each; an empty benchmark hits nothing. Clashing column names of the input are replaced by the new ones.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes to normalised bytes: A-Z folded, what is no word a space.
FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BYTES = 16 * 1024 * 1024  # of benchmark text in one automaton


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows(text: bytes, size: int) -> list[bytes]:
    found = words(text)
    if not found:
        return []
    return [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]


class Automaton:
    """All windows of the items, as one automaton over Latin-1 views of the bytes."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        import ahocorasick

        owners: dict[bytes, list[str | None]] = {}
        for item, text in items:
            for w in set(windows(text, size)):
                owners.setdefault(w, []).append(item)
        self.owners = list(owners.values())
        self.trie = ahocorasick.Automaton()
        for k, w in enumerate(owners):
            self.trie.add_word(f" {w.decode('latin-1')} ", (k, w.count(b" ") + 1, len(w)))
        self.any = bool(owners)
        if self.any:
            self.trie.make_automaton()

    def scan(self, text: bytes) -> tuple[int, bytearray, set]:
        """Words of the text, a mark for each (1: hit), and the items whose windows occur."""
        found = words(text)
        hit, items = bytearray(len(found)), set()
        if not self.any or not found:
            return len(found), hit, items
        line = f" {b' '.join(found).decode('latin-1')} "
        at, seen, owners = 0, 0, self.owners
        for end, (k, n, size) in self.trie.iter(line):
            start = end - size  # of the window's first word
            at += line.count(" ", seen, start) if start >= seen else -line.count(" ", start, seen)
            seen = start
            hit[at - 1 : at - 1 + n] = b"\1" * n
            items.update(owners[k])
        return len(found), hit, items


def spans(text: bytes, hit: bytearray) -> list[tuple[int, int]]:
    """Runs of hit words as code-point offsets [from, to) of the original text."""
    out: list[list[int]] = []
    run = False
    for word, h in zip(WORDS.finditer(text.translate(FOLD)), hit):
        if h and run:
            out[-1][1] = word.end()
        elif h:
            out.append([word.start(), word.end()])
        run = bool(h)
    return [(len(text[:a].decode("utf-8", "replace")), len(text[:b].decode("utf-8", "replace"))) for a, b in out]


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> tuple[int, Iterator[list[tuple[str | None, bytes]]]]:
    """The distinct rows of the benchmark in blocks of about limit bytes of text or less (but one text at least): their
    number, and each block, collected when it is asked for."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), common.utf8(text).alias("body")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    n = 1 if total <= limit else 2 * -(-total // limit)
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    return n, ([(r["item"], bytes(r["body"])) for r in rows.where(part == k).collect()] for k in range(n))


def contaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score each document against a benchmark table.

    Adds n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings) and spans (offsets in the
    original). The benchmark is a table of bounded size; its bytes are checked, and beyond block_bytes it is scanned for
    in blocks, the texts with the marks of one pass written to the shared folder for the next, so no automaton outgrows a worker."""
    spark = docs.sparkSession
    common.ship(spark)
    fields = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType(), "items": T.ArrayType(T.StringType()), "spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in fields]
    body, mark = common.fresh(docs, "_utf8"), common.fresh(docs, "_marks")
    state = docs.select(*[docs[c] for c in kept], common.utf8(text).alias(body), F.lit(None).cast("binary").alias(mark), F.array().cast("array<string>").alias("items"))
    n_blocks, blocks = _blocks(benchmark, item, item_text, block_bytes)
    shared = None
    for k, block in enumerate(blocks):
        if k:
            state = common.stored(state, "marks")
            shared.destroy()
        shared, last, key = spark.sparkContext.broadcast(block), k == n_blocks - 1, f"windows {uuid.uuid4().hex}"
        schema = T.StructType([docs.schema[c] for c in kept] + ([T.StructField(n, t) for n, t in fields.items()] if last else [*state.schema[-3:]]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, key=key, names=schema.names) -> Iterator[pa.RecordBatch]:
            automaton = common.resident(key, lambda: Automaton(shared.value, window))
            for batch in batches:
                out: dict[str, list] = {n: [] for n in names[len(kept) :]}
                for raw, old, before in zip(*(batch.column(i) for i in range(batch.num_columns - 3, batch.num_columns))):
                    raw, old = raw.as_py(), old.as_py()
                    n, hit, items = automaton.scan(raw)
                    if old:
                        hit = bytearray(a | b for a, b in zip(old, hit))
                    items = sorted({x for x in items if x is not None}.union(before.as_py()))
                    if not last:
                        for name, v in zip(out, (raw, bytes(hit), items)):
                            out[name].append(v)
                        continue
                    hits = sum(hit)
                    values = (n, hits, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hits > 0, items, [{"start": a, "stop": b} for a, b in spans(raw, hit)] if hits else [])
                    for name, v in zip(out, values):
                        out[name].append(v)
                kinds = [pa.binary(), pa.binary(), pa.list_(pa.string())] if not last else [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=names)

        state = state.mapInArrow(run, schema)
    return state
