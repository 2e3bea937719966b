"""File names to languages, as column expressions and broadcast joins with the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import _LOWER, _UPPER, STYLE_RULES, C, Catalogue, default


def base_name(path: Column | str) -> Column:
    """What follows the last slash or backslash; the whole path if it ends in one."""
    path = F.col(path) if isinstance(path, str) else path
    last = F.regexp_extract(path, r"[^\\/]+\z", 0)
    return F.when(last == "", path).otherwise(last)


def folded(name: Column | str) -> Column:
    """A-Z in lower case, nothing else; lower() would fold other letters too."""
    return F.translate(name, _UPPER, _LOWER)


def style(language: Column | str) -> Column:
    """Comment style of a language name."""
    language = F.col(language) if isinstance(language, str) else language
    out = None
    for part, s in STYLE_RULES:
        hit = F.contains(language, F.lit(part))
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.otherwise(C)


def candidates(name: Column, dots: int) -> list[Column]:
    """Keys to look up, in order: the whole name, then suffixes from the longest that a key can have to the shortest."""
    low = folded(name)
    have = F.length(low) - F.length(F.replace(low, F.lit("."), F.lit("")))
    return [F.concat(F.lit("."), low)] + [F.when(have >= j, F.concat(F.lit("."), F.substring_index(low, ".", -j))) for j in range(dots, 0, -1)]


def resolve(files: DataFrame, name: str = "name", catalogue: Catalogue | None = None) -> DataFrame:
    """Adds language and family to each row; both null if the name resolves to none.

    One broadcast hash join for each candidate key, no shuffle; the catalogue's size doesn't grow with the data."""
    catalogue = catalogue or default()
    table = catalogue.frame(files.sparkSession)
    out, found = files, []
    for k, key in enumerate(candidates(F.col(name), catalogue.dots)):
        out = out.withColumn(f"_key{k}", key).join(F.broadcast(table.select(F.col("ext_key").alias(f"_key{k}"), F.struct("language", "family").alias(f"_hit{k}"))), f"_key{k}", "left")
        found.append(f"_hit{k}")
    hit = F.coalesce(*found)
    kept = [c for c in files.columns if c not in ("language", "family")]
    return out.select(*kept, hit.getField("language").alias("language"), hit.getField("family").alias("family"))
