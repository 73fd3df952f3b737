"""Sources mixed to target shares of all tokens by systematic sampling.

A source's records are expected to be used share * total / its tokens times each, where the total is the
largest for which no source is used more than its allowed times. Expected copies are summed up along each source
and a random offset of its own is added; a record is emitted once for each whole number its stretch crosses, so any stretch
of a source is used as often as expected, give or take one. Records run in order of size, in classes a hundredth wide, then hash,
so that shares of tokens are met as closely as shares of records.

Sums are of whole units (RESOLUTION to a copy), so that no boundary is crossed twice or missed where partial sums meet.
Sources without a target, and null sources, are not drawn; targets without records contribute nothing and bind nothing.
Records without tokens are drawn like others and add nothing. Empty tables give an empty selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import beside

RESOLUTION = 1 << 24
BUCKETS = 64


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, records, tokens, and units: the expected copies of a record, in RESOLUTION units."""
    have = sizes.where("source is not null").groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    t = targets.select("source", "target_share", "max_repeats").where("target_share > 0 and max_repeats > 0").join(have.where("tokens > 0"), "source")
    total = t.agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    copies = F.col("target_share") * F.lit(float(total)) / F.col("tokens")
    return t.withColumn("units", F.least(F.round(copies * RESOLUTION), F.col("max_repeats") * RESOLUTION).cast("long"))


def drawn(sizes: DataFrame, planned: DataFrame, seed: int = 11) -> DataFrame:
    """source, doc_id, tokens and copy (from 1) for each use of a record. ``sizes`` is (doc_id, source, tokens)."""
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(RESOLUTION))
    bucket = F.when(F.col("tokens") > 0, F.floor(F.log2("tokens") * 64)).otherwise(-1) * BUCKETS + F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    each = sizes.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens")).join(planned.select("source", "units"), "source").withColumn("bucket", bucket.cast("long"))
    ends = each.groupBy("source", "bucket").agg(F.sum("units").alias("held"))
    ends = ends.withColumn("before", F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum("units").over(W.partitionBy("source", "bucket").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0))
    placed = each.withColumn("upto", run).join(ends.drop("held"), ["source", "bucket"]).withColumn("upto", F.col("upto") + F.col("before") + offset)
    whole = lambda c: F.expr(f"({c}) div {RESOLUTION}")
    placed = placed.withColumn("uses", whole("upto") - whole("upto - units")).where("uses > 0")
    return placed.select("source", "doc_id", "tokens", F.explode(F.expr("sequence(1L, uses)")).alias("copy"))


def shares(planned: DataFrame, selection: DataFrame) -> DataFrame:
    """Per source: target and actual share of the drawn tokens, uses, and the most uses of a record."""
    got = selection.groupBy("source").agg(F.count("*").alias("uses"), F.sum("tokens").alias("drawn_tokens"), F.max("copy").alias("most_repeats"))
    s = planned.select("source", "target_share", "max_repeats", "records", "tokens").join(got, "source", "left").fillna(0, ["uses", "drawn_tokens", "most_repeats"])
    s = beside(s, selection.agg(F.sum("tokens").cast("double").alias("_all")))
    return s.withColumn("actual_share", F.round(F.try_divide(F.col("drawn_tokens").cast("double"), F.col("_all")), 6)).drop("_all")
