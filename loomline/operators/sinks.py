"""Reports as a text table and as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import TOTAL

RULE = "-" * 109
HEAD = ("File Type", "Files", "Blank", "Comment", "Code", "Total")
#: Field names of the JSON report.
FIELDS = {"CountOfFiles": "files", "CountOfLinesBlank": "blank", "CountOfLinesComment": "comment", "CountOfLinesCode": "code", "CountOfLinesTotal": "total"}


def _line(cells) -> str:
    first, *rest = cells
    return f"{first:<25}{rest[0]:>10}" + "".join(f"{c:>15}" for c in rest[1:])


def text_table(report: DataFrame) -> str:
    """The report as text, languages in order. Its rows are one for each language, so they are collected."""
    rows = sorted((r["language"] == TOTAL, r["language"], r) for r in report.collect())
    body = [_line((r["language"], r["files"], r["blank"], r["comment"], r["code"], r["total"])) for _, _, r in rows]
    return "\n".join([RULE, _line(HEAD), RULE, *body[:-1], RULE, body[-1], RULE]) + "\n"


def json_report(report: DataFrame) -> DataFrame:
    """One row, report: the JSON document {"Totals": {...}, "languages": [...]}, languages in order."""
    counts = [F.col(c).alias(name) for name, c in FIELDS.items()]
    total = F.first(F.when(F.col("language") == TOTAL, F.struct(*counts)), ignorenulls=True)
    each = F.sort_array(F.collect_list(F.when(F.col("language") != TOTAL, F.struct(F.col("language").alias("Language"), *counts))))
    return report.agg(F.to_json(F.struct(total.alias("Totals"), each.alias("languages"))).alias("report"))


def write_report(report: DataFrame, path: str, kind: str = "parquet") -> None:
    """The report as parquet, json, csv or orc files."""
    report.coalesce(1).write.mode("overwrite").format(kind).save(path)
