"""Queries of the problems on texts: packing (7), mixing (8) and list pages (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import beside
from ..plans.staging import written
from ..sources.tables import table
from .mixing import RESOLUTION, drawn, plan, shares
from .packing import fills, packed
from .page_spam import scores
from .tokens import token_counts


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return packed(written(token_counts(table(spark, d, "documents")), "sizes"), table(spark, d, "containers"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text, or of each piece of a text that is longer than the capacity."""
    return _pieces(spark, d)


def p7_fills(spark: SparkSession, d: str) -> DataFrame:
    """The fill of each container."""
    return fills(_pieces(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: texts, and how many break a rule: texts lost, in pieces that don't add up, or cut without need, and containers above their capacity."""
    sizes = written(token_counts(table(spark, d, "documents")), "sizes")
    pieces = written(packed(sizes, table(spark, d, "containers")), "pieces")
    got = pieces.groupBy("container_kind", "capacity_tokens", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("held"))
    each = got.join(sizes, "doc_id")
    count = lambda c: F.count_if(c)
    texts = each.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("texts"), count(F.col("held") != F.col("tokens")).alias("uneven"), count((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("cut"))
    over = fills(pieces).groupBy("container_kind").agg(count(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"))
    total = sizes.agg(F.count("*").alias("all"))
    return beside(texts.join(over, "container_kind"), total).select("container_kind", "texts", (F.col("all") - F.col("texts")).alias("lost"), "uneven", "cut", "overfull")


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """Each use of each record that is drawn."""
    sizes = written(token_counts(table(spark, d, "documents"), keep=("source",)), "sizes")
    return drawn(sizes, plan(sizes, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    sizes = written(token_counts(table(spark, d, "documents"), keep=("source",)), "sizes")
    planned = plan(sizes, table(spark, d, "mix_targets"))
    return shares(planned, drawn(sizes, planned))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source with a target: records, and how many break a rule: used more often than allowed, or not as often as expected, give or take one; and whether its share is within a thousandth and one record's weight of the target."""
    sizes = written(token_counts(table(spark, d, "documents"), keep=("source",)), "sizes")
    planned = plan(sizes, table(spark, d, "mix_targets"))
    selection = written(drawn(sizes, planned), "selection")
    used = selection.groupBy("source", "doc_id").agg(F.count("*").alias("uses"))
    each = sizes.join(planned.select("source", "max_repeats", "units"), "source").join(used, ["source", "doc_id"], "left").withColumn("off", F.abs(F.coalesce("uses", F.lit(0)) - F.col("units") / RESOLUTION))
    rules = each.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("uses") > F.col("max_repeats")).alias("over"), F.count_if(F.col("off") >= 1).alias("uneven"), F.max("tokens").alias("largest"))
    s = beside(shares(planned, selection).join(rules.drop("records"), "source"), selection.agg(F.sum("tokens").alias("_all")))
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.001 + 2 * F.col("largest") / F.col("_all")
    return s.select("source", "records", "over", "uneven", near.alias("near"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose own body is mostly keywords, links or product tags."""
    return scores(table(spark, d, "documents")).where("is_case").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per source and language: messages, cases and the share of list words in all words."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    s = docs.join(scores(table(spark, d, "documents")), "doc_id", "left")
    return s.groupBy("source", "lang").agg(F.count("*").alias("messages"), F.count_if("is_case").alias("cases"), F.round(F.try_divide(F.sum("listed"), F.sum(F.col("listed") + F.col("plain"))), 6).alias("listed_share"))


QUERIES = {"p7_containers": p7_containers, "p7_fills": p7_fills, "p7_checks": p7_checks, "p8_selection": p8_selection, "p8_shares": p8_shares, "p8_checks": p8_checks, "p9_found": p9_found, "p9_sources": p9_sources}
SQL = {
    "p7_checks": "select container_kind, (select count(*) from documents) as texts, 0 as lost, 0 as uneven, 0 as cut, 0 as overfull from containers",
    "p8_checks": "select source, count(*) as records, 0 as over, 0 as uneven, true as near from documents join mix_targets using (source) group by source",
}
