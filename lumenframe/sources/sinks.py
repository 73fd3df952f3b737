"""Tables and reports written out."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A folder of CSV files with headers; arrays and structs have to be turned into text first."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """A folder of JSON lines."""
    df.write.mode("overwrite").json(path)


def report_dict(df: DataFrame) -> dict:
    """The single row of a report; more or fewer rows fail."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    return rows[0].asDict(recursive=True)


def write_report(report: dict, path: str) -> str:
    """A report as JSON with sorted keys; parent folders are made."""
    text = json.dumps(report, indent=2, sort_keys=True, default=str, ensure_ascii=False)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return text
