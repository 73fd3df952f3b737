"""Streaming queries over the given tables, read to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..streaming.drift import first_deliveries, last_states, session_means, written_stream
from .staging import fresh_path


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; times without a zone are read in the session's."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else f"{name}.parquet")
    df = reader.parquet(path if folder else d)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of events, with those of the days still open where the source ends."""
    return rounded(last_states(session_means(_stream(spark, d, "events")), ["session"], fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")))


def stream_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The identifiers of messages, each once, as they arrive."""
    out = fresh_path(spark, "stream")
    first = first_deliveries(_stream(spark, d, "documents").select("message_id", "received_at"), ["message_id"])
    written_stream(first.select("message_id"), out, fresh_path(spark, "stream-checkpoint"))
    return spark.read.schema("message_id string").parquet(out)


QUERIES = {"stream_sessions": stream_sessions, "stream_first_deliveries": stream_first_deliveries}
SQL = {
    "stream_first_deliveries": "select distinct message_id from documents",
    "stream_sessions": "select date_trunc('day', ts) as session, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from events group by 1"
}

