"""Queries of the problems on identifiers: shared records (1) and repeated files (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import fresh_path, spread
from ..sources.tables import table
from . import identity as ident
from .vector_cells import CellIndex, replay
from .winnow import shared_records


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "captures").select("record_id", "split_name", "patient_id", "image_id", "acquisition_id"))
    return shared_records(c, F.col("record_id"), F.col("split_name") == "train", [ident.patient_key("patient_id"), ident.image_key("image_id"), ident.acquisition_key("acquisition_id")])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train record and one of another split with two or three equal identifiers; null split names are left out."""
    p = _pairs(spark, d)
    return p.select(F.least("record_id_a", "record_id_b").alias("record_id_a"), F.greatest("record_id_a", "record_id_b").alias("record_id_b"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: records, those shared with train, pairs, most pairs of one record, and mean best coverage of all records."""
    best = _pairs(spark, d).groupBy(F.col("record_id_b").alias("record_id")).agg(F.count("*").alias("pairs"), F.max("coverage").alias("coverage"))
    evals = table(spark, d, "captures").where("split_name <> 'train'").select("record_id", "split_name", "source_dataset")
    return (
        evals.join(best, "record_id", "left")
        .groupBy("split_name", "source_dataset")
        .agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.max("pairs"), F.lit(0)).alias("most_pairs"), F.round(F.sum(F.coalesce("coverage", F.lit(0.0))) / F.count("*"), 6).alias("coverage"))
    )


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluation record that is shared with train: its pairs, the best coverage, and the smallest train record that has it."""
    best = _pairs(spark, d).groupBy(F.col("record_id_b").alias("record_id")).agg(F.count("*").alias("pairs"), F.max(F.struct("coverage", (-F.col("record_id_a")).alias("back"))).alias("best"))
    evals = table(spark, d, "captures").where("split_name <> 'train'").select("record_id", "split_name", "source_dataset")
    return evals.join(best, "record_id").select("record_id", "split_name", "source_dataset", "pairs", F.round("best.coverage", 6).alias("coverage"), (-F.col("best.back")).alias("train_record_id"))


def _evidence(files: DataFrame) -> DataFrame:
    """Two vectors a file, by batch: its digest, and the digest of the place its path names."""
    f = spread(files.select("file_id", "batch_id", "sha256", "image_path")).select("file_id", "batch_id", ident.digest_key("sha256").alias("digest"), F.sha2(ident.path_key("image_path"), 256).alias("place"))
    both = F.array(F.struct(F.lit(0).cast("byte").alias("kind"), F.unhex("digest").alias("vec")), F.struct(F.lit(1).cast("byte").alias("kind"), F.unhex("place").alias("vec")))
    return f.select("file_id", "batch_id", F.explode(both).alias("e")).select("file_id", "batch_id", "e.kind", "e.vec")


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    """Batch after batch through an index that starts empty; files without a batch come with the first."""
    files = table(spark, d, "inventory").where("file_id is not null").withColumn("batch_id", F.coalesce("batch_id", F.lit(-1)))
    batches = files.groupBy("batch_id").agg(F.count("*").alias("n")).persist()
    expected = 2 * int(batches.agg(F.sum("n")).first()[0] or 0)
    found = replay(CellIndex(spark, fresh_path(spark, "cells"), expected), _evidence(files), batches)
    batches.unpersist()
    return found


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """file_id_b repeats file_id_a, the smallest file_id with the same digest or place."""
    return _repeats(spark, d).select(F.col("earliest").alias("file_id_a"), F.col("file_id").alias("file_id_b"))


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """Per batch: files, those that repeat an earlier one, and those whose original came in an earlier batch."""
    files = table(spark, d, "inventory").select("file_id", "batch_id")
    found = _repeats(spark, d).join(files.select(F.col("file_id").alias("earliest"), F.col("batch_id").alias("first_batch")), "earliest").select("file_id", "first_batch")
    return files.join(found, "file_id", "left").groupBy("batch_id").agg(F.count("*").alias("files"), F.count("first_batch").alias("repeats"), F.count_if(F.col("first_batch") < F.col("batch_id")).alias("of_earlier_batches"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_records": p1_records, "p2_found": p2_found, "p2_batches": p2_batches}

_KEYS_1 = f"""keys as materialized (select record_id, split_name, source_dataset, {ident.patient_key_sql('patient_id')} as p, {ident.image_key_sql('image_id')} as i, {ident.acquisition_key_sql('acquisition_id')} as a from captures),
either as (select t.record_id as x, e.record_id as y, t.p as tp, e.p as ep, t.i as ti, e.i as ei, t.a as ta, e.a as ea from keys t join keys e on t.p = e.p and t.i = e.i where t.split_name = 'train' and e.split_name <> 'train'
union select t.record_id, e.record_id, t.p, e.p, t.i, e.i, t.a, e.a from keys t join keys e on t.i = e.i and t.a = e.a where t.split_name = 'train' and e.split_name <> 'train'
union select t.record_id, e.record_id, t.p, e.p, t.i, e.i, t.a, e.a from keys t join keys e on t.p = e.p and t.a = e.a where t.split_name = 'train' and e.split_name <> 'train'),
pairs as materialized (select distinct x, y, coalesce((tp = ep)::int, 0) + coalesce((ti = ei)::int, 0) + coalesce((ta = ea)::int, 0) as n from either)"""

_KEYS_2 = f"""keys as materialized (select file_id, batch_id, {ident.digest_key_sql('sha256')} as digest, {ident.path_key_sql('image_path')} as place from inventory),
firsts as (select file_id, batch_id, least(min(file_id) over (partition by coalesce(digest, 'no ' || file_id)), min(file_id) over (partition by coalesce(place, 'no ' || file_id))) as first_id from keys)"""

SQL = {
    "p1_found": f"with {_KEYS_1} select distinct least(x, y) as record_id_a, greatest(x, y) as record_id_b from pairs",
    "p1_counts": f"""with {_KEYS_1}, best as (select y as record_id, count(distinct x) as pairs, max(n) / 3.0::double as coverage from pairs group by y)
select split_name, source_dataset, count(*) as records, count(pairs) as overlapping, coalesce(sum(pairs), 0)::bigint as pairs, coalesce(max(pairs), 0) as most_pairs, round(sum(coalesce(coverage, 0::double)) / count(*), 6) as coverage
from keys left join best using (record_id) where split_name <> 'train' group by all""",
    "p1_records": f"""with {_KEYS_1}, best as (select y as record_id, count(*) as pairs, max(n) as n, arg_min(x, (-n, x)) as train_record_id from pairs group by y)
select record_id, split_name, source_dataset, pairs, round(n / 3.0::double, 6) as coverage, train_record_id from keys join best using (record_id)""",
    "p2_found": f"with {_KEYS_2} select first_id as file_id_a, file_id as file_id_b from firsts where first_id < file_id",
    "p2_batches": f"""with {_KEYS_2} select f.batch_id, count(*) as files, count(*) filter (f.first_id < f.file_id) as repeats, count(*) filter (o.batch_id < f.batch_id) as of_earlier_batches
from firsts f join keys o on o.file_id = f.first_id group by all""",
}
