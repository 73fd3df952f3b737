"""Files whose fields drift: one table over all of them, and every change between files of a feed.

The schema of a file is read from its own lines, all files in parallel: for each field the spelling most of
its values use and the kind most of them have. Kinds are folded up a lattice to the type of the union
schema. A field that only holds null or blank values is not carried. Lines that aren't JSON objects are
unreadable and skipped; a repeated key counts with its last value. Files follow each other by time, then id.
Null file ids and payloads, and empty tables, give no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.field_names import Catalog

#: The lattice: each kind with the kinds directly above it; everything ends in text.
ABOVE = {"nothing": ("boolean", "long", "object", "array"), "boolean": ("text",), "long": ("double",), "double": ("text",), "object": ("text",), "array": ("text",), "text": ()}
SQL_TYPES = {"nothing": "string", "boolean": "boolean", "long": "bigint", "double": "double", "object": "string", "array": "string", "text": "string"}


def reaches(kind: str) -> set[str]:
    return {kind}.union(*(reaches(k) for k in ABOVE[kind]))


def promoted(kinds: Sequence[str]) -> str:
    """The least kind that all ``kinds`` can become."""
    common = set.intersection(*(reaches(k) for k in kinds)) if kinds else {"nothing"}
    return min(common, key=lambda k: (-len(reaches(k)), k))


def kind_of(value: Any) -> str:
    """nothing, boolean, long, double, object, array or text."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return "nothing"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long" if -(2**63) <= value < 2**63 else "double"
    return {float: "double", dict: "object", list: "array"}.get(type(value), "text")


def parsed(payload: str | None) -> dict[str, Any] | None:
    try:
        found = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def file_fields(rows: DataFrame, catalog: Sequence[str]) -> DataFrame:
    """(file_id, field_name, spelling, kind, n): how many values of each kind a file holds under each spelling, partial by batch."""
    names = list(catalog)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Catalog(names)
        for b in batches:
            n: Counter[tuple[int, str, str]] = Counter()
            for file_id, payload in zip(b.column("file_id").to_pylist(), b.column("payload").to_pylist(), strict=True):
                for name, value in (parsed(payload) or {}).items():
                    if (kind := kind_of(value)) != "nothing":
                        n[file_id, name, kind] += 1
            rows = [(f, known.field(s), s, k, c) for (f, s, k), c in n.items()]
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["file_id", "field_name", "spelling", "kind", "n"])

    schema = "file_id long, field_name string, spelling string, kind string, n long"
    found = rows.select(F.col("file_id").cast("long").alias("file_id"), "payload").where("file_id is not null and payload is not null").mapInArrow(scan, schema)
    return found.groupBy("file_id", "field_name", "spelling", "kind").agg(F.sum("n").alias("n"))


def _most(what: str) -> Column:
    return F.max(F.struct(F.col("n"), F.col(what))).getField(what)


def headers(fields: DataFrame) -> DataFrame:
    """(file_id, field_name, spelling, kind) of each field that a file carries; long and double are one kind, number."""
    kinds = fields.withColumn("kind", F.when(F.col("kind").isin("long", "double"), "number").otherwise(F.col("kind")))
    kind = kinds.groupBy("file_id", "field_name", "kind").agg(F.sum("n").alias("n")).groupBy("file_id", "field_name").agg(_most("kind").alias("kind"))
    spelling = fields.groupBy("file_id", "field_name", "spelling").agg(F.sum("n").alias("n")).groupBy("file_id", "field_name").agg(_most("spelling").alias("spelling"))
    return kind.join(spelling, ["file_id", "field_name"])


def file_order(rows: DataFrame) -> DataFrame:
    """(feed, file_id, exported_at, previous_id) of every file, by time within its feed."""
    files = rows.where("file_id is not null").groupBy("feed", "file_id").agg(F.min("exported_at").alias("exported_at"))
    return files.withColumn("previous_id", F.lag("file_id").over(W.partitionBy("feed").orderBy("exported_at", "file_id")))


def changes(order: DataFrame, header: DataFrame) -> DataFrame:
    """feed, exported_at, file_id, field_name, change_kind, before and after: what each file changes against the previous of its feed."""
    steps = order.where("previous_id is not null")
    now = steps.join(header, "file_id").select("file_id", "field_name", F.struct("spelling", "kind").alias("after"))
    was = steps.select("file_id", F.col("previous_id")).join(header.withColumnRenamed("file_id", "previous_id"), "previous_id").select("file_id", "field_name", F.struct("spelling", "kind").alias("before"))
    both = now.join(was, ["file_id", "field_name"], "full").join(steps.select("file_id", "feed", "exported_at"), "file_id")
    named = F.array_compact(
        F.array(
            F.when(F.col("before").isNull(), F.lit("added")),
            F.when(F.col("after").isNull(), F.lit("removed")),
            F.when(F.col("before.spelling") != F.col("after.spelling"), F.lit("renamed")),
            F.when(F.col("before.kind") != F.col("after.kind"), F.lit("retyped")),
        )
    )
    return both.select("feed", "exported_at", "file_id", "field_name", F.explode(named).alias("change_kind"), "before", "after")


def union_schema(fields: DataFrame, catalog: Sequence[str]) -> dict[str, str]:
    """The union type of each catalogued field: kinds of all files folded up the lattice. The driver gets at most six kinds a field."""
    held: dict[str, list[str]] = {f: [] for f in catalog}
    for r in fields.where(F.col("field_name").isin(*catalog)).select("field_name", "kind").distinct().collect():
        held[r["field_name"]].append(r["kind"])
    return {f: SQL_TYPES[promoted(sorted(k))] for f, k in held.items()}


def union_table(rows: DataFrame, catalog: Sequence[str], types: dict[str, str]) -> DataFrame:
    """row_id, file_id and one column for each catalogued field, cast to its union type; objects and arrays are JSON text.

    Where a line holds a field under two spellings, the catalogued one counts, else the first; ``file_fields`` counts them all.
    """
    names = list(catalog)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Catalog(names)
        for b in batches:
            columns: dict[str, list[str | None]] = {f: [] for f in names}
            keep = []
            for i, payload in enumerate(b.column("payload").to_pylist()):
                if (found := parsed(payload)) is None:
                    continue
                keep.append(i)
                row: dict[str, Any] = {}
                for s, v in found.items():
                    if kind_of(v) != "nothing" and ((f := known.field(s)) not in row or s == f):
                        row[f] = v
                for f in names:
                    v = row.get(f)
                    columns[f].append(v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row_id").take(take), b.column("file_id").take(take), *(pa.array(columns[f], pa.string()) for f in names)], names=["row_id", "file_id", *names])

    schema = "row_id long, file_id long, " + ", ".join(f"`{f}` string" for f in names)
    read = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("file_id").cast("long").alias("file_id"), "payload").mapInArrow(scan, schema)
    return read.select("row_id", "file_id", *(F.expr(f"try_cast(`{f}` as {types[f]})").alias(f) for f in names))
