"""Profiles, duplicates, overlaps between partitions, and group-disjoint splits.

Null identifiers overlap with nothing and belong to no group unless said otherwise. Empty tables give empty or zero results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import beside, finite, missing, number, stripped
from ..functions.ordering import indexed
from ..plans.staging import written


def missingness(df: DataFrame) -> DataFrame:
    """(column, missing_fraction) for every column, in one pass, most first."""
    shares = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(str(i)) for i, c in enumerate(df.columns)))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("missing_fraction")) for i, c in enumerate(df.columns)))
    return shares.select(F.explode(each).alias("x")).select("x.*").orderBy(F.desc("missing_fraction"), "column")


def target_summary(df: DataFrame, value: str = "target_value", by: Sequence[str] = ("biomarker", "target_unit")) -> DataFrame:
    v = number(value)
    known = df.where(F.greatest(*(F.col(c).isNull() for c in by)) == F.lit(False))
    return known.groupBy(*by).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"))


def leakage_report(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patients, records, and patients with more than one record."""
    per = df.groupBy(patient).agg(F.count("*").alias("n"))
    return per.agg(F.count(patient).alias("patients"), F.sum("n").alias("records"), F.count_if((F.col("n") > 1) & F.col(patient).isNotNull()).alias("patients_with_multiple_records"))


def leakage_audit(df: DataFrame, patient: str = "patient_id", acquisition: str = "acquisition_id", device: str = "device_model") -> DataFrame:
    """Rows, patients, rows beyond the first of a patient or acquisition, and surplus (patient, device) pairs. Null is one identity for repeats."""
    null_once = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    pairs = df.where(F.col(patient).isNotNull() & F.col(device).isNotNull()).select(patient, device).distinct()
    surplus = pairs.groupBy(patient).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first()["n"]
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(patient).alias("n_patients"), (F.count("*") - null_once(patient)).alias("duplicate_patient_rows"), (F.count("*") - null_once(acquisition)).alias("duplicate_acquisition_rows"), F.lit(int(surplus)).cast("long").alias("patients_seen_on_multiple_devices")
    )


def device_distribution(df: DataFrame, device: str = "device_model") -> DataFrame:
    """Rows and share of each device, the null device included, most first."""
    counts = df.groupBy(device).agg(F.count("*").alias("n"))
    return beside(counts, df.agg(F.count("*").alias("_all"))).select(device, "n", (F.col("n") / F.col("_all")).alias("fraction")).orderBy(F.desc("n"), device)


def status_counts(df: DataFrame, status: Column | str, states: Sequence[str] = ("PASS", "REVIEW", "FAIL")) -> DataFrame:
    """Rows of each state, zero where there are none, and their shares of all rows."""
    s = F.col(status) if isinstance(status, str) else status
    out = df.agg(F.count("*").alias("n"), *(F.count_if(s == x).alias(x.lower()) for x in states))
    return out.select("*", *(F.round(F.try_divide(F.col(x.lower()).cast("double"), F.col("n").cast("double")), 6).alias(f"{x.lower()}_rate") for x in states))


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null ``key`` occurs more than once: counted first, then semi-joined, so hot keys shrink before they move."""
    many = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(many, key, "left_semi").orderBy(key)


def partition_overlaps(df: DataFrame, partition: str, identifiers: Sequence[str]) -> DataFrame:
    """(kind, a, b, id) of every identifier that two partitions share: one shuffle for all kinds and pairs."""
    each = df.select(F.col(partition).alias("partition"), F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in identifiers))).alias("x"))
    held = each.where("x.id is not null and partition is not null").groupBy("x.kind", "x.id").agg(F.array_sort(F.collect_set("partition")).alias("in")).where("size(in) > 1")
    pairs = F.flatten(F.transform("in", lambda a: F.transform(F.filter("in", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.select("kind", "id", F.explode(pairs).alias("p")).select("kind", "p.a", "p.b", "id")


def overlap_counts(df: DataFrame, partition: str, identifiers: Sequence[str]) -> DataFrame:
    """(kind, a, b, n) for every two partitions, zero included."""
    names = df.where(F.col(partition).isNotNull()).agg(F.array_sort(F.collect_set(partition)).alias("in"))
    pairs = F.flatten(F.transform("in", lambda a: F.transform(F.filter("in", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    every = names.select(F.explode(pairs).alias("p"), F.array(*map(F.lit, identifiers)).alias("kinds")).select(F.explode("kinds").alias("kind"), "p.a", "p.b")
    found = partition_overlaps(df, partition, identifiers).groupBy("kind", "a", "b").agg(F.count("*").alias("n"))
    return every.join(found, ["kind", "a", "b"], "left").select("kind", "a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def require_disjoint(df: DataFrame, partition: str, patient: str = "patient_id", unique: bool = False) -> DataFrame:
    """``df`` if no patient is in two partitions (nor, with ``unique``, twice in one); else ValueError."""
    bad = df.where(F.col(patient).isNotNull()).groupBy(patient).agg(F.count_distinct(partition).alias("k"), F.count("*").alias("n")).where("k > 1 or n > 1" if unique else "k > 1")
    if not bad.isEmpty():
        raise ValueError("patients overlap between partitions or repeat")
    return df


def require_patients(df: DataFrame, least: int, patient: str = "patient_id") -> int:
    """The number of patients; ValueError for a missing column, no rows, missing ids or fewer than ``least``."""
    if patient not in df.columns:
        raise ValueError(f"column {patient} is missing")
    r = df.agg(F.count("*").alias("n"), F.count_if(missing(patient)).alias("bad"), F.count_distinct(stripped(patient)).alias("k")).first()
    if not r["n"] or r["bad"] or r["k"] < least:
        raise ValueError(f"at least {least} patients, each named, are required")
    return r["k"]


def _dealt(df: DataFrame, groups: DataFrame, by: list[str], seed: int, train: float, validation: float, patient: str) -> DataFrame:
    """``df`` with ``partition``, from ``groups`` (by, _p): patients of each ``by`` in order of a seeded hash, counted in sorted ranges."""
    placed = indexed(groups.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), "_p").cast("binary"))), [*by, "_h", "_p"])
    bounds = placed.groupBy(*by).agg(F.min("idx").alias("_first"), F.count("*").alias("_k"))
    n_train = F.floor(F.col("_k") * train)
    n_val = F.floor((F.col("_k") - n_train) * validation / (1 - train))
    bounds = written(bounds.withColumns({"_train": n_train, "_val": n_val}), "bounds")
    sizes = bounds.agg(F.count("*").alias("n"), F.min("_k").alias("k"), F.count_if((F.col("_train") < 1) | (F.col("_val") < 1) | (F.col("_train") + F.col("_val") >= F.col("_k"))).alias("bad")).first()
    if not sizes["n"] or sizes["k"] < 4 or sizes["bad"]:
        raise ValueError("at least four patients are required, and no partition may be empty")
    place = F.col("idx") - F.col("_first")
    part = F.when(place < F.col("_train"), "train").when(place < F.col("_train") + F.col("_val"), "validation").otherwise("test").alias("partition")
    held = (placed.join(bounds, by) if by else beside(placed, bounds)).select(*by, "_p", part)
    return df.withColumn("_p", stripped(patient)).join(written(held, "split"), [*by, "_p"]).drop("_p")


def patient_split(df: DataFrame, seed: int = 42, train: float = 0.70, validation: float = 0.15, patient: str = "patient_id") -> DataFrame:
    """``df`` with ``partition``: patients in order of a seeded hash, the first share to train, half of the rest by the given shares.

    No patient is in two partitions; fewer than four patients or an empty partition fail.
    """
    require_patients(df, 4, patient)
    return _dealt(df, df.select(stripped(patient).alias("_p")).distinct(), [], seed, train, validation, patient)


def split_by(df: DataFrame, by: str = "biomarker", seed: int = 42, train: float = 0.70, validation: float = 0.15, patient: str = "patient_id") -> DataFrame:
    """``patient_split`` of each value of ``by``, all in one pass; rows without one are left out."""
    df = df.where(F.col(by).isNotNull())
    require_patients(df, 4, patient)
    return _dealt(df, df.select(by, stripped(patient).alias("_p")).distinct(), [by], seed, train, validation, patient)


def unseen_device_split(df: DataFrame, held_out: str, device: str = "device_model", patient: str = "patient_id", strict: bool = True) -> DataFrame:
    """``df`` with ``partition``: test is the held-out device, train is the rest without the patients seen there; their rows elsewhere are excluded.

    ``strict`` fails on missing devices; else null devices are no match and null patients match null patients.
    """
    if strict and not df.where(missing(device)).isEmpty():
        raise ValueError("every row needs a device")
    test = F.coalesce(F.col(device).cast("string") == held_out, F.lit(False))
    seen = df.where(test).select(F.col(patient).alias("_seen")).distinct()
    marked = df.withColumn("_test", test).join(seen.withColumn("_hit", F.lit(True)), F.col(patient).eqNullSafe(F.col("_seen")), "left")
    part = F.when(F.col("_test"), "test").when(F.coalesce("_hit", F.lit(False)), "excluded").otherwise("train")
    return marked.withColumn("partition", part).drop("_seen", "_hit", "_test")


def audit_gate(checks: DataFrame) -> DataFrame:
    """(name, ok) rows to one row: checks and passed; no check or an unknown one doesn't pass."""
    return checks.agg(F.count("*").alias("checks"), (F.coalesce(F.every(F.coalesce("ok", F.lit(False))), F.lit(False))).alias("passed"))


def require_features(df: DataFrame, features: Sequence[str], target: str, biomarker: str, unit: str) -> DataFrame:
    """``df`` if features and target are finite and biomarker and unit are as given; else ValueError."""
    bad = ~F.least(*(finite(c) for c in (*features, target))) | F.coalesce((F.col("biomarker") != biomarker) | (F.col("target_unit") != unit), F.lit(True))
    r = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if not r["n"] or r["bad"]:
        raise ValueError("features, targets, biomarker or unit are invalid")
    return df
