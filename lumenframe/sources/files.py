"""Metadata tables, files and images as tables."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = r"(?i)\.(jpe?g|png|bmp|tiff?)$"


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, texts: Sequence[str] = ()) -> DataFrame:
    """A table by its suffix: parquet, csv with a header, json (an array of records) or jsonl. ``texts`` are columns kept as text, so that leading zeros stay."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (".parquet", ".csv", ".json", ".jsonl"):
        raise ValueError(f"unsupported suffix: {suffix}")
    if suffix == ".parquet":
        return spark.read.parquet(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == ".csv":
        if schema is not None or not texts:
            return reader.option("header", True).option("inferSchema", schema is None).csv(path)
        inferred = spark.read.option("header", True).option("inferSchema", True).csv(path).schema
        fields = [T.StructField(f.name, T.StringType() if f.name in texts else f.dataType) for f in inferred]
        return spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
    return reader.option("multiLine", suffix == ".json").json(path)


def from_arrays(spark: SparkSession, **columns: Sequence) -> DataFrame:
    """Arrays of equal length as columns, with their position as row_id."""
    if len({len(c) for c in columns.values()}) > 1:
        raise ValueError("arrays must have equal length")
    pdf = pd.DataFrame({k: np.asarray(v) for k, v in columns.items()})
    pdf.insert(0, "row_id", np.arange(len(pdf), dtype=np.int64))
    return spark.createDataFrame(pdf)


def resolved(path: Column, root: str | None) -> Column:
    """A path as it is if absolute or without a root, else below the root."""
    return path if root is None else F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


PIECE = 1 << 23


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, sha256) of the files below ``root``, each read in its task piece by piece, whatever its length."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column("path").to_pylist():
                h = hashlib.sha256()
                with open_input(p) as f:
                    while piece := f.read(PIECE):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(out, pa.string())], names=["path", "length", "sha256"])

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    f = f.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(hashed, "path string, length long, sha256 string")
    return f.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "sha256")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of image files below ``root``, sorted; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")
    return f.where(F.col("path").rlike(IMAGES)).orderBy("path")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, readable, data) of decoded images; what can't be decoded is there with readable false."""
    i = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")
    return i.select(F.regexp_replace("origin", "^file:/*", "/").alias("path"), "width", "height", (F.col("height") > 0).alias("readable"), "nChannels", "data")


def _located(path: str) -> tuple:
    """(file system, path in it); plain paths and file: URIs are local."""
    from pyarrow import fs

    parts = urlsplit(path)
    return (fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def open_input(path: str):
    """A file to read, on any file system that Arrow knows."""
    system, inner = _located(path)
    return system.open_input_stream(inner, compression=None)


def open_output(path: str):
    """A file to write, on any file system that Arrow knows; folders are made."""
    system, inner = _located(path)
    system.create_dir(str(PurePosixPath(inner).parent), recursive=True)
    return system.open_output_stream(inner, compression=None)


def encode_bmp(rgb: np.ndarray) -> bytes:
    """Red, green and blue bytes (height, width, 3) as an uncompressed bitmap file."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    rows[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b) of decoded images; the decoder's order is blue, green, red, and one channel is gray."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, w, h, n, data in zip(*(b.column(c).to_pylist() for c in ("path", "width", "height", "nChannels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                bgr = a[:, :, :3] if n >= 3 else np.repeat(a[:, :, :1], 3, axis=2)
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                yield pa.RecordBatch.from_arrays([pa.array([path] * (h * w)), pa.array(y), pa.array(x), *(pa.array(bgr[:, :, c].reshape(-1).astype(np.int32)) for c in (2, 1, 0))], names=["image_id", "y", "x", "r", "g", "b"])

    return images.where("readable").select("path", "width", "height", "nChannels", "data").mapInArrow(spread, "image_id string, y int, x int, r int, g int, b int")


def inventory(spark: SparkSession, rows: DataFrame, root: str, path: str = "image_path") -> DataFrame:
    """``rows`` with exists, readable, sha256, width and height of their file; the hash only of readable ones."""
    named = rows.withColumn("_path", resolved(F.col(path), root))
    hashes = file_hashes(spark, root).select(F.col("path").alias("_path"), F.col("sha256").alias("_sha"))
    sizes = read_images(spark, root).select(F.col("path").alias("_path"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("readable").alias("_ok"))
    j = named.join(hashes, "_path", "left").join(sizes, "_path", "left")
    ok = F.coalesce("_ok", F.lit(False))
    return j.select(*rows.columns, F.col("_sha").isNotNull().alias("exists"), ok.alias("readable"), F.when(ok, F.col("_sha")).alias("sha256"), F.when(ok, F.col("_w")).alias("width"), F.when(ok, F.col("_h")).alias("height"))


def inspect_videos(spark: SparkSession, manifest: DataFrame, root: str, path: str = "video_path", order: str = "row_id") -> DataFrame:
    """``manifest`` with exists, sha256, duplicate_of (the first row with the same bytes) and, where a decoder is installed, fps, decoded and reported frames, duration, width, height and readable.

    Without a decoder nothing counts as readable and the error says so.
    """
    from ..operators.gates import first_repeat

    named = manifest.withColumn("_path", resolved(F.col(path), root))
    found = named.join(file_hashes(spark, root).select(F.col("path").alias("_path"), "sha256"), "_path", "left").withColumn("exists", F.col("sha256").isNotNull())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import cv2
        except ImportError:
            cv2 = None
        for pdf in batches:
            out = []
            for p, there in zip(pdf["_path"], pdf["exists"], strict=True):
                fps = frames = width = height = reported = duration = None
                error = None if there else "video not found"
                if there and cv2 is None:
                    error = "no video decoder is installed"
                elif there:
                    v = cv2.VideoCapture(p)
                    if not v.isOpened():
                        error = "video can't be opened"
                    else:
                        fps, width, height = v.get(cv2.CAP_PROP_FPS), int(v.get(cv2.CAP_PROP_FRAME_WIDTH)), int(v.get(cv2.CAP_PROP_FRAME_HEIGHT))
                        frames, reported = 0, int(v.get(cv2.CAP_PROP_FRAME_COUNT))
                        duration = reported / fps if fps > 0 else None
                        while v.read()[0]:
                            frames += 1
                        error = None if frames and fps > 0 else "no frame can be decoded"
                    v.release()
                out.append((fps, frames, width, height, reported, duration, there and error is None, error))
            names = ["fps", "decoded_frames", "width", "height", "reported_frames", "duration_s", "readable", "error"]
            yield pd.concat([pdf[[order]].reset_index(drop=True), pd.DataFrame(out, columns=names).astype({"fps": "float64", "duration_s": "float64", "decoded_frames": "Int64", "reported_frames": "Int64", "width": "Int64", "height": "Int64", "readable": "bool"})], axis=1)

    kind = dict(manifest.dtypes)[order]
    seen = found.select(order, "_path", "exists").mapInPandas(decode, f"`{order}` {kind}, fps double, decoded_frames long, width long, height long, reported_frames long, duration_s double, readable boolean, error string")
    return first_repeat(found, "sha256", order).drop("_path").join(seen, order)
