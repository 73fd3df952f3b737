"""Queries of canonical values (3) and of splits that keep related records together (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import beside
from ..plans.staging import cut, spread, written
from ..sources.tables import table
from . import identity as ident
from .canonical_values import candidates, map_values
from .components import assigned, grouped

FIELDS = ("white_balance_mode", "illumination", "roi_type")
SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def _values(spark: SparkSession, d: str) -> DataFrame:
    return map_values(spread(table(spark, d, "captures").select("record_id", *FIELDS)), FIELDS, table(spark, d, "vocabulary"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry of each value of the three fields that isn't null, blank or a label; 0 if it stands for none."""
    return _values(spark, d).select("record_id", "field_name", "entry_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Each unmatched value of a field with its number of rows."""
    return _values(spark, d).where("entry_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("rows"))


def p3_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every entry within the limit of each distinct value of the three fields."""
    c = spread(table(spark, d, "captures").select(*FIELDS))
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS))
    return candidates(c.select(F.explode(each).alias("v")).select("v.*").where("value is not null"), table(spark, d, "vocabulary"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    v = spread(table(spark, d, "visits").select("visit_id", "patient_id", "device_model")).select("visit_id", ident.patient_key("patient_id").alias("patient"), ident.unit_key("device_model").alias("unit"))
    return grouped(v, "visit_id", ["patient", "unit"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every visit with the smallest visit of its group, but for those smallest ones."""
    return _groups(spark, d).where("group_id <> row_id").select(F.col("group_id").alias("group_visit_id"), F.col("row_id").alias("visit_id"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every visit."""
    g = cut(_groups(spark, d))
    return g.join(assigned(g, SHARES), "group_id").select(F.col("row_id").alias("visit_id"), F.col("group_id").alias("group_visit_id"), "split")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per split its visits, and the groups that are in more than one split."""
    s = written(p4_splits(spark, d), "splits")
    torn = s.groupBy("group_visit_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn_groups"))
    return beside(s.groupBy("split").agg(F.count("*").alias("visits")), torn)


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched, "p3_candidates": p3_candidates, "p4_found": p4_found, "p4_splits": p4_splits, "p4_totals": p4_totals}

SQL = {
    "p4_found": f"""with recursive keys as materialized (select visit_id, {ident.patient_key_sql('patient_id')} as p, {ident.unit_key_sql('device_model')} as u from visits),
e as materialized (select k.visit_id as a, m.m as b from keys k join (select p, min(visit_id) as m from keys where p is not null group by p) m using (p)
union select k.visit_id, m.m from keys k join (select u, min(visit_id) as m from keys where u is not null group by u) m using (u)),
both_ways as materialized (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b)
select min(b) as group_visit_id, a as visit_id from reach group by a having min(b) < a""",
    "p4_totals": "select split, visits, 0 as torn_groups from (select round(count(*) * 0.15)::bigint as n, count(*) - 2 * round(count(*) * 0.15)::bigint as rest from visits), lateral (values ('validation', n), ('test', n), ('train', rest)) t(split, visits)",
}
