"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship  # noqa: F401  the operators take it from here

BITMAPS = 16_384  # of 4 KiB, that may be broadcast
BATCH = 1_000  # rows that a Python worker gets at once, where texts go along with other models in memory


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), "loomline-shared")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/loomline-{uuid.uuid4().hex}/{name}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path(), if the session still lives."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers at most BATCH rows at once, or fewer where it is set so. A batch is held a few
    times over by the JVM and by the worker; Spark's 10,000 whole texts take hundreds of MB of an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:  # 0: no bound
        spark.conf.set(key, str(BATCH))


_resident: tuple[str, object] | None = None


def resident(key: str, make):
    """The model that this Python worker holds: of one key at a time, so that of an operator that has ended is let go."""
    global _resident
    if _resident is None or _resident[0] != key:
        vacate()  # before the next one is made
        _resident = (key, make())
    return _resident[1]


def vacate() -> None:
    """Let the worker's model go, and give what it and earlier tasks took back to the system: a worker lives on from stage to
    stage, and tasks without a model leave freed memory behind too."""
    global _resident
    _resident = None
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Recent:
    """Rows of `width` numbers by chunk of text, for the chunks that were met last: two generations of about `most` bytes
    together, so chunks in use stay."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        self._open()
        self.old, self.old_rows = {}, self.rows

    def _open(self) -> None:
        self.young: dict[bytes, int] = {}
        self.rows = np.zeros((1024, self.width))
        self.size = 0

    def _add(self, chunks: list[bytes], rows: np.ndarray) -> None:
        at = len(self.young)
        if at + len(chunks) > len(self.rows):
            more = np.zeros((max(2 * len(self.rows), at + len(chunks)), self.width))
            more[:at] = self.rows[:at]
            self.rows = more
        self.rows[at : at + len(chunks)] = rows
        self.young.update(zip(chunks, range(at, at + len(chunks))))
        self.size += sum(map(len, chunks)) + len(chunks) * (150 + 8 * self.width)

    def sums(self, texts: list[list[bytes]], learn) -> np.ndarray:
        """For each list of chunks the sum of their rows; learn gives the rows of a list of unknown chunks."""
        need = set().union(*texts).difference(self.young)
        again = [c for c in need if c in self.old]
        if again:
            self._add(again, self.old_rows[[self.old[c] for c in again]])
        missing = list(need.difference(self.old))
        if missing:
            self._add(missing, learn(missing))
        out = np.zeros((len(texts), self.width))
        for k, chunks in enumerate(texts):
            if chunks:
                out[k] = self.rows[np.fromiter(map(self.young.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
        if self.size > self.most // 2:
            self.old, self.old_rows = self.young, self.rows
            self._open()
        return out


def least_by_hash(df: DataFrame, column: str, rows: int, most: int) -> DataFrame:
    """The `most` rows of df with the smallest hash of a column, of which df has `rows`; ties by the column itself. Rows that
    can't be among them are filtered out before the sort, so the task that merges gets little more than `most`."""
    share = (1.2 * most + 200) / max(rows, 1)  # of all hashes; the rows below it are fewer than `most` with a chance under 1e-9
    if share < 1:
        df = df.where(F.xxhash64(column) < F.lit(int(share * 2.0**64) - 2**63))
    return df.orderBy(F.xxhash64(column), column).limit(most)


def by_bytes(texts: pa.Array, most: int) -> Iterator[list[bytes]]:
    """The texts of a column in order, in lists of about `most` bytes."""
    held, size = [], 0
    for x in texts:
        held.append(x.as_py())
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str):
    """A text column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo: the fixed split into learning and held-out rows. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def among(rows: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """The rows whose number is in wanted (row). Rows are not shuffled while a bitmap of the numbers is small enough to be
    broadcast: its size is checked; beyond that the tables are joined."""
    # numbers from 1 on, so that a bitmap's bucket and bit follow from them
    number, bucket, bits = F.col("row") + 1, fresh(rows, "_bucket"), fresh(rows, "_bits")
    maps = wanted.select(F.bitmap_bucket_number(number).alias(bucket), F.bitmap_bit_position(number).alias("bit"))
    maps = stored(maps.groupBy(bucket).agg(F.bitmap_construct_agg("bit").alias(bits)), "bits")
    if maps.count() > BITMAPS:
        return rows.join(wanted.select(F.col("row").alias(row)).distinct(), row, "left_semi")
    number = F.col(row) + 1
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(F.col(bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(bucket, F.bitmap_bucket_number(number)).join(F.broadcast(maps), bucket)
    return found.where((byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1).select(*rows.columns)


def one_row_each(docs: DataFrame, on: dict[str, str], chosen: DataFrame, prefer) -> DataFrame:
    """The rows of docs whose columns `on` (name in docs: name in chosen, null equal to null) stand in chosen, one row
    for each. chosen has such keys once each and n, how many rows of docs have them. Keys of more than one row, which
    nothing tells apart, keep the row with the largest `prefer`; their rows are reduced before they are shuffled."""
    chosen = stored(chosen, "chosen")
    renamed = chosen.select(*[F.col(b).alias(f"_chosen_{k}") for k, b in enumerate(on.values())], F.col("n").alias("_chosen_n"))
    same = F.lit(True)
    for k, a in enumerate(on):
        same = same & docs[a].eqNullSafe(F.col(f"_chosen_{k}"))
    single = docs.join(renamed.where("_chosen_n = 1"), same, "left_semi")
    several = renamed.where("_chosen_n > 1")
    if several.isEmpty():
        return single
    rows = docs.withColumn("_prefer", prefer).join(several, same, "left_semi")
    best = rows.groupBy(*on).agg(F.max_by(F.struct(*docs.columns), F.col("_prefer")).alias("_row"))
    return single.unionByName(best.select("_row.*"))
