"""Exact deduplication with a heavy-hitter split.

Texts are equal when equal after all ASCII white space is deleted; they are compared by the SHA-256 of that. Misra-Gries
summaries of the digests, one for each task and then merged, name every digest of over 2 x rows/CAPACITY rows.
Their exact winners and counts come from one aggregation with partial sums in each task; the winners (fewer than
CAPACITY) are broadcast and removed map-side. All other digests are shuffled by digest in the ordinary way; none of them
has more than 2 x rows/CAPACITY rows.

Cases: null text counts as empty, and empty texts are equal. Of equal texts the row with the most code points in the
original stays, then the one with the smallest doc_id (nulls last). Rows that repeat doc_id and text alike are copies;
decisions() marks one of them as kept. An empty table gives an empty result. Columns with clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WHITE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
CAPACITY = 4096  # counters of a Misra-Gries summary


def digested(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, SHA-256 of the normalised text, code points of the original, and a number for each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.translate(body, WHITE, "").cast("binary"), 256)).alias("digest"), F.length(body).alias("n"), F.monotonically_increasing_id().alias("row"))


def summary(counts: dict[bytes, int], digest: bytes, n: int, capacity: int) -> None:
    """Misra-Gries: add n of a digest; when the summary is full, take the smallest count off all."""
    if digest in counts:
        counts[digest] += n
    elif len(counts) < capacity:
        counts[digest] = n
    else:
        least = min(n, min(counts.values()))
        for k in [k for k, v in counts.items() if v <= least]:
            del counts[k]
        for k in counts:
            counts[k] -= least
        if n > least:
            counts[digest] = n - least


def frequent(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Candidates, fewer than capacity; every digest with over 2 x rows/capacity rows is among them.

    A task's summary is short by its rows/capacity at most, so a sum is short by rows/capacity at most: such a digest's
    sum is over rows/capacity, and fewer than capacity digests can have such sums, which never exceed the true counts."""
    total = digests.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.vacate()
        counts: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts():
                summary(counts, x["values"].as_py(), x["counts"].as_py(), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    sums = digests.select("digest").mapInArrow(run, "digest binary, n long")
    return sums.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") * capacity > total).select("digest")


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id (a whole number), keep_id, group_size, kept, text_sha256."""
    common.ship(docs.sparkSession)
    rows = common.stored(digested(docs, doc_id, text), "digests")
    best = F.struct(F.col("n"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("low"), (-F.col("row")).alias("first"))
    candidates = common.stored(frequent(rows, capacity), "frequent")
    winners = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    heavy = common.stored(winners, "winners")
    shape = [F.col("doc_id"), F.bitwise_not("best.low").alias("keep_id"), F.col("group_size"), (F.col("row") == -F.col("best.first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    near = rows.join(F.broadcast(heavy), "digest").select(*shape)
    w = Window.partitionBy("digest")
    far = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumns({"best": F.max(best).over(w), "group_size": F.count(F.lit(1)).over(w)}).select(*shape)
    return near.unionByName(far)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns, one for each different text."""
    key = common.fresh(docs, "_digest")
    body = F.coalesce(F.col(text), F.lit(""))
    verdict = common.stored(decisions(docs, doc_id, text, capacity), "verdict")
    digest = F.col("text_sha256")
    rows = verdict.groupBy("keep_id", digest).agg(F.sum(F.col("doc_id").eqNullSafe(F.col("keep_id")).cast("long")).alias("n"))
    return common.one_row_each(docs.withColumn(key, F.sha2(F.translate(body, WHITE, "").cast("binary"), 256)), {doc_id: "keep_id", key: "text_sha256"}, rows, F.length(body)).drop(key)
