"""Measurements as they arrive: drift of session means, and repeated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def session_means(stream: DataFrame, time: str = "ts", value: str = "value", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean, spread and number of values of each window; rows later than ``late`` behind the newest are left out once their window is closed."""
    v = F.col(value).cast("double")
    return stream.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).select(F.col("window.start").alias("session"), "n", "mean", "sd")


def first_deliveries(stream: DataFrame, keys: list[str], time: str = "received_at", late: str = "7 days") -> DataFrame:
    """Rows but the first of those with equal ``keys`` within ``late``; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drained(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """What a bounded stream gives once all that is there is read; the query ends by itself."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def written_stream(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """A bounded stream into Parquet files, exactly once."""
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_states(df: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """The last state of each key of a bounded stream's aggregate, open windows too: a batch writes the rows it changed, and the latest of a key counts.

    A batch that is run again overwrites its own folder, so its rows count once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    spark = df.sparkSession
    put(spark.createDataFrame([], df.schema), -1)  # for a source without rows
    df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(out)
    return states.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), "batch").alias("last")).select(*keys, "last.*")
