"""Value counts of string columns straight from columnar files: footers first, dictionaries next, pages last.

Files are listed by Spark, their footers read in parallel, and each row group (chunk) becomes a task row.
A chunk whose footer gives exact statistics - all null, or one value and no null - is answered from it.
Otherwise its dictionary gives the distinct candidates, and only their indices are counted; chunks without a
dictionary are decoded. What leaves a task is one row for each distinct key and value, not the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT_LENGTH = 64


def open_file(path: str) -> Any:
    """A Parquet file of any file system that Arrow knows; plain paths and file: URIs are local."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pq.ParquetFile(unquote(parts.path) if parts.scheme else path, memory_map=True)
    system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(inner, filesystem=system)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_group, rows) of every row group of the Parquet files at ``path``."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column("path").to_pylist():
                meta = open_file(p).metadata
                found += [(p, i, meta.row_group(i).num_rows) for i in range(meta.num_row_groups)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["path", "row_group", "rows"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInArrow(footers, "path string, row_group int, rows long")


def single_value(column: Any) -> tuple[bool, str | None]:
    """(whether the footer proves that the chunk holds one value only, that value); min and max may be cut, so long ones prove nothing."""
    s = column.statistics
    if s is None or not s.has_null_count:
        return False, None
    if s.null_count == column.num_values or (s.num_values == 0 and s.null_count > 0):
        return True, None
    if s.null_count == 0 and s.has_min_max and s.min == s.max and len(str(s.max)) < EXACT_LENGTH:
        return True, s.max
    return False, None


def value_counts(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys (as strings), column_name, value, n and source: counts of each value of each column, partial by chunk.

    ``source`` says what answered: footer, dictionary or pages. Values are strings; null is a value of its own.
    Missing columns count as null. Empty tables give an empty result.
    """
    keys, columns = list(keys), list(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, group in zip(b.column("path").to_pylist(), b.column("row_group").to_pylist(), strict=True):
                yield from _chunk(p, group, keys, columns)

    schema = ", ".join(f"{k} string" for k in keys) + ", column_name string, value string, n long, source string"
    return _dealt(spark, path).mapInArrow(count, schema)


def extrema(column: Any, kind: pa.DataType) -> tuple[Any, Any] | None:
    """(least, largest) of a chunk if its footer gives them exactly: always for numbers, dates and booleans, for texts if too short to have been cut. NaN counts for neither."""
    s = column.statistics
    if s is None or not s.has_null_count:
        return None
    if s.null_count == column.num_values or (s.num_values == 0 and s.null_count > 0):
        return None, None
    text = pa.types.is_string(kind) or pa.types.is_large_string(kind)
    plain = text or pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)
    if not plain or not s.has_min_max or (text and max(len(str(s.min)), len(str(s.max))) >= EXACT_LENGTH):
        return None
    return s.min, s.max


def chunk_statistics(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(column_name, rows, nulls, low_number, high_number, low_text, high_text, source) of each column of each chunk.

    Footers answer where their nulls and extrema are exact; only the other chunks are read. ``source`` says which: footer or scan. A
    column that a file lacks is null throughout. Numbers, and booleans as 0 and 1, have no text extrema, texts no numbers.
    """
    columns = list(columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, group in zip(b.column("path").to_pylist(), b.column("row_group").to_pylist(), strict=True):
                file = open_file(p)
                meta, schema = file.metadata.row_group(group), file.schema_arrow
                by_name = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
                for c in columns:
                    if c not in by_name:
                        out.append((c, meta.num_rows, meta.num_rows, None, None, None, None, "footer"))
                        continue
                    kind, ends, source = schema.field(c).type, extrema(by_name[c], schema.field(c).type), "footer"
                    nulls = by_name[c].statistics.null_count if ends else None
                    if ends is None:
                        x, source = file.read_row_group(group, columns=[c], use_threads=False).column(0), "scan"
                        found = pc.min_max(x)
                        ends, nulls = (found["min"].as_py(), found["max"].as_py()), x.null_count
                    text = [None if v is None else str(v) for v in ends]
                    number = [None if v is None or not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)) else float(v) for v in ends]
                    out.append((c, meta.num_rows, nulls, *number, *(text if number == [None, None] else (None, None)), source))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=STATISTICS)

    schema = "column_name string, rows long, nulls long, low_number double, high_number double, low_text string, high_text string, source string"
    return _dealt(spark, path).mapInArrow(look, schema)


STATISTICS = ["column_name", "rows", "nulls", "low_number", "high_number", "low_text", "high_text", "source"]


def chunk_values(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) of the distinct values of each column of each chunk, as text: the entries of its dictionary where it has one."""
    columns = list(columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, group in zip(b.column("path").to_pylist(), b.column("row_group").to_pylist(), strict=True):
                have = set(open_file(p).schema_arrow.names)
                wanted = [c for c in columns if c in have]
                data = open_coded(p, wanted).read_row_group(group, columns=wanted, use_threads=False) if wanted else None
                for c in wanted:
                    x = data.column(c)
                    for part in x.chunks:
                        names = part.dictionary if pa.types.is_dictionary(part.type) else pc.unique(part)
                        names = pc.cast(names, pa.string()).drop_null()
                        yield pa.RecordBatch.from_arrays([pa.array([c] * len(names), pa.string()), names], names=["column_name", "value"])

    return _dealt(spark, path).mapInArrow(look, "column_name string, value string")


def column_profile(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """column_name, rows, nulls, distinct_values, low and high (number or text) of whole columns, and how many chunks footers answered and how many were scanned for it."""
    ends = [F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"), F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text")]
    sums = chunk_statistics(spark, path, columns).groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), *ends, F.count_if(F.col("source") == "footer").alias("from_footers"), F.count_if(F.col("source") == "scan").alias("scanned"))
    distinct = chunk_values(spark, path, columns).distinct().groupBy("column_name").agg(F.count("*").alias("distinct_values"))
    return sums.join(distinct, "column_name", "left").fillna(0, ["distinct_values"])


def _dealt(spark: SparkSession, path: str) -> DataFrame:
    """The chunks, dealt to a fixed number of tasks, so that few of them aren't put together in one."""
    return chunks(spark, path).repartition(4 * spark.sparkContext.defaultParallelism, "path", "row_group")


def _chunk(path: str, group: int, keys: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    file = open_file(path)
    meta = file.metadata.row_group(group)
    if meta.num_rows == 0:
        return
    by_name = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    known = {c: single_value(by_name[c]) if c in by_name else (True, None) for c in [*keys, *columns]}
    wanted = [c for c in [*keys, *columns] if not known[c][0]]
    data = open_coded(path, wanted).read_row_group(group, columns=wanted, use_threads=False) if wanted else None
    code, words = np.zeros(meta.num_rows, np.int64), []
    for k in keys:
        index, names = _coded(data, k, known[k], meta.num_rows)
        code = code * len(names) + index
        words.append(names)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    labels = [_coded(data, k, known[k], meta.num_rows)[0][first] for k in keys]
    for c in columns:
        index, names = _coded(data, c, known[c], meta.num_rows)
        pair, n = np.unique(code * len(names) + index, return_counts=True)
        of_key, of_value = pair // len(names), pair % len(names)
        source = "footer" if known[c][0] else "dictionary" if by_name[c].has_dictionary_page else "pages"
        arrays = [w.take(pa.array(label[of_key])) for w, label in zip(words, labels, strict=True)]
        arrays += [pa.array([c] * len(pair)), names.take(pa.array(of_value)), pa.array(n.astype(np.int64)), pa.array([source] * len(pair))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "column_name", "value", "n", "source"])


def open_coded(path: str, wanted: list[str]) -> Any:
    """The file with its string columns read as dictionaries and indices, not as strings."""
    plain = open_file(path)
    text = [c for c in wanted if pa.types.is_string(plain.schema_arrow.field(c).type) or pa.types.is_large_string(plain.schema_arrow.field(c).type)]
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pq.ParquetFile(unquote(parts.path) if parts.scheme else path, read_dictionary=text, memory_map=True)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(inner, filesystem=system, read_dictionary=text)


def _coded(data: pa.Table | None, column: str, known: tuple[bool, Any], rows: int) -> tuple[np.ndarray, pa.Array]:
    """(index of each row into the names, names as strings); null is the last name."""
    if known[0]:
        return np.zeros(rows, np.int64), pa.array([None if known[1] is None else str(known[1])], pa.string())
    x = data.column(column).combine_chunks()
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    x = x if pa.types.is_dictionary(x.type) else x.dictionary_encode()
    names = pc.cast(x.dictionary, pa.string())
    index = x.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    return index, pa.concat_arrays([names, pa.array([None], pa.string())])
