"""Line statistics of files, of languages, and of everything."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decoding, lexing
from ..functions.catalogue import Catalogue
from ..functions.naming import resolve
from ..sources import files as sources

TOTAL = "Total:"
STATS = ("total", "blank", "comment")


def revisable(files: DataFrame, name: str = "name", catalogue: Catalogue | None = None) -> DataFrame:
    """The files whose names resolve, with language and family."""
    return resolve(files, name, catalogue).where("language is not null")


def ignored(files: DataFrame, name: str = "name", catalogue: Catalogue | None = None) -> DataFrame:
    """The files whose names resolve to no language."""
    return resolve(files, name, catalogue).where("language is null").drop("language", "family")


def text_stats(files: DataFrame, name: str = "name", text: str = "text", catalogue: Catalogue | None = None) -> DataFrame:
    """Lines of each row of (name, text) whose name resolves, inside the JVM; other columns but the text are kept.

    A row without text (null) counts as a file without lines."""
    found = revisable(files, name, catalogue)
    out = found.withColumn("_stats", lexing.line_stats(text, F.col("family")))
    return out.select(*[c for c in found.columns if c not in (text, "total", "blank", "comment", "code")], *[F.col(f"_stats.{c}").alias(c) for c in ("total", "blank", "comment", "code")])


def content_stats(files: DataFrame, name: str = "name", content: str = "content", catalogue: Catalogue | None = None) -> DataFrame:
    """As text_stats, of bytes: marks are taken off and binary content counts as a file without lines.

    Names are resolved first, and the contents are read once. Those with a UTF-16 mark are decoded in Arrow batches, for which
    all others are null; these are decoded inside the JVM."""

    @F.pandas_udf("binary")
    def utf16(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else decoding.to_text(bytes(x)) or b"")

    sources.ship(files.sparkSession)
    wide = decoding.bom(F.col(content)).startswith("utf-16")
    text = F.coalesce(F.decode(utf16(F.when(wide, F.col(content))), "ISO-8859-1"), decoding.decoded(content).getField("text"))
    return text_stats(files.withColumn("_text", text).drop(content), name, "_text", catalogue)


def file_stats(files: DataFrame, failfast: bool = False, catalogue: Catalogue | None = None) -> DataFrame:
    """Reads listed files and counts their lines; names are resolved first, so others are never opened.

    failfast: a file that cannot be read fails the query; else it counts as a file without lines."""
    out = sources.read_stats(revisable(files, "name", catalogue))
    if failfast:
        fail = F.raise_error(F.concat(F.col("status"), F.lit(": "), F.col("path")))
        out = out.withColumn("status", F.when(F.col("status") == sources.SUCCESS, F.col("status")).otherwise(fail.cast("string")))
    return out.withColumn("code", lexing.code(F.col("total"), F.col("blank"), F.col("comment")))


def _sums() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), zero).alias(c) for c in STATS]]


def _shaped(df: DataFrame) -> DataFrame:
    code = lexing.code(F.col("total"), F.col("blank"), F.col("comment"))
    return df.select("language", "files", "blank", "comment", code.alias("code"), "total")


def language_stats(stats: DataFrame) -> DataFrame:
    """(language, files, blank, comment, code, total): partial sums in each task, one small shuffle by language."""
    return _shaped(stats.groupBy("language").agg(*_sums()))


def grand_total(stats: DataFrame) -> DataFrame:
    """One row over all files, zeros for none."""
    return _shaped(stats.agg(*_sums()).withColumn("language", F.lit(TOTAL)))


def report(stats: DataFrame) -> DataFrame:
    """Languages and the grand total, which is there for empty input too.

    The files are read and counted once: each language's row is taken twice, for itself and for the total, and a row of
    zeros for the total stands beside them; the second shuffle has two rows for each language and task of the first."""
    by = stats.groupBy("language").agg(*_sums())
    twice = by.withColumn("language", F.explode(F.array(F.col("language"), F.lit(TOTAL))))
    none = stats.sparkSession.range(1).select(F.lit(TOTAL).alias("language"), *[F.lit(0).cast("long").alias(c) for c in ("files", *STATS)])
    return _shaped(twice.unionByName(none).groupBy("language").agg(*[F.sum(c).alias(c) for c in ("files", *STATS)]))


def ignored_count(files: DataFrame, name: str = "name", catalogue: Catalogue | None = None) -> DataFrame:
    """One row: how many files resolve to no language."""
    return resolve(files, name, catalogue).agg(F.count_if(F.col("language").isNull()).alias("ignored"))
