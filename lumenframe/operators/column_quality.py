"""Data quality of columns between loads, from value counts alone.

Missing: null, blank, a mark without letters or digits, or a word for no value. Numeric: a plain decimal.
Each load is held against all other loads of its site together. Rows without a load or a site belong to none and are left out.
Empty tables give empty results; a load without numeric values has no range, median or constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import written

#: Words for no value, in lower case.
NO_VALUE = ("na", "n/a", "n.a.", "n.a", "#n/a", "nan", "null", "nil", "none", "missing", "unknown", "not available", "not recorded", "not measured", "no value", "empty", "n/k", "n.k.", "nd", "n.d.", "tbd", "undefined", "<na>", "(null)", "k.a.", "void")

DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?$"

#: Limits of the findings.
NULL_EXCESS, PATTERN_SHARE, RANGE_SHARE, CONSTANT_SHARE = 0.20, 0.08, 0.08, 0.30


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def classified(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Value counts (load_id, site_code, biomarker, column_name, value, n) with missing, number and inside, and the bounds low_value and high_value.

    ``bounds`` is (column_name, biomarker, low_value, high_value); a null biomarker holds for any that has no bounds of its own. A column without bounds is inside.
    """
    c = counts.withColumn("text", trimmed(F.col("value")))
    missing = F.col("text").isNull() | ~F.col("text").rlike(r"[\p{L}\p{N}]") | F.lower("text").isin(*NO_VALUE)
    c = c.withColumn("missing", missing).withColumn("number", F.when(~F.col("missing") & F.col("text").rlike(DECIMAL), F.expr("try_cast(text as double)")))
    span = F.struct("low_value", "high_value")
    own = bounds.where("biomarker is not null").select("column_name", "biomarker", span.alias("_own"))
    general = bounds.where("biomarker is null").select("column_name", span.alias("_any"))
    c = c.join(own, ["column_name", "biomarker"], "left").join(general, "column_name", "left").withColumn("_span", F.coalesce("_own", "_any"))
    c = c.withColumns({"low_value": F.col("_span.low_value"), "high_value": F.col("_span.high_value")})
    outside = (F.col("number") < F.col("low_value")) | (F.col("number") > F.col("high_value"))
    return c.withColumn("inside", F.col("number").isNotNull() & ~F.coalesce(outside, F.lit(False))).drop("_own", "_any", "_span", "text")


#: Value counts of a column and site that one task sorts, about.
PER_RANGE = 100_000
SHARES = (0.25, 0.5, 0.75)
BLOCK = 64


def _ranges(rows: int) -> Column:
    """Which of so many ranges of numbers a value count belongs to that even a site with a third of all rows has about PER_RANGE in each; ranges follow each other as numbers do."""
    n = max(1, -(-rows // (3 * PER_RANGE)))
    x, low, high = F.col("number"), F.col("low_value"), F.col("high_value")
    place = F.coalesce(F.try_divide(x - low, high - low), F.atan("number") / F.lit(3.15) + 0.5)
    of_number = F.greatest(F.lit(0), F.least(F.floor(place * n), F.lit(n - 1)))
    return F.coalesce(of_number, F.pmod(F.xxhash64("value"), F.lit(n))).cast("int")


def cumulated(counts: DataFrame, rows: int) -> DataFrame:
    """Distinct classified value counts with running numbers of inside values in the order of numbers, from one shuffle by site, column and range.

    Beside the counts: same (of the number in its load), at and upto (inside values of the site equal to the number, and up to it, within the range),
    first (whether it is the number's first row), own (the load's inside values up to it, within the range).
    """
    by = ["site_code", "column_name", "range"]
    dealt = counts.withColumn("range", _ranges(rows)).repartition(*by)
    known = dealt.groupBy(*by, "load_id", "value", "missing", "number", "inside").agg(F.sum("n").alias("n"))
    held = F.when(F.col("inside"), F.col("n")).otherwise(0)
    load = W.partitionBy(*by, "load_id").orderBy(F.col("inside").desc(), "number")
    site = W.partitionBy(*by).orderBy(F.col("inside").desc(), "number")
    upto, equal = (W.unboundedPreceding, W.currentRow), (W.currentRow, W.currentRow)
    return known.withColumns({"same": F.sum("n").over(load.rangeBetween(*equal)), "own": F.sum(held).over(load.rangeBetween(*upto))}).withColumns(
        {"at": F.sum(held).over(site.rangeBetween(*equal)), "upto": F.sum(held).over(site.rangeBetween(*upto)), "first": F.row_number().over(site.orderBy(F.col("inside").desc(), "number", "load_id", "value"))}
    ).withColumn("first", F.col("inside") & (F.col("first") == F.min("first").over(W.partitionBy(*by, "inside", "number"))))


def _before(totals: DataFrame, by: list[str], name: str, alias: str) -> DataFrame:
    """(by, range, alias): what the ranges before each hold."""
    return totals.select(*by, "range", F.coalesce(F.sum(name).over(W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(alias))


def _ranks(total: Column) -> Column:
    """For each of SHARES, the ranks (from 1) of the two values it lies between, and how far from the first."""
    at = [F.lit(q) * (total - 1) for q in SHARES]
    return F.array(*(F.struct((F.floor(p) + 1).alias("k"), F.least(F.floor(p) + 2, total).alias("k2"), (p - F.floor(p)).alias("part")) for p in at))


def _between(low: Column, high: Column, part: Column) -> Column:
    return low + (high - low) * part


def profiled(cumulated_counts: DataFrame) -> DataFrame:
    """One row for each load and column: rows, nulls, missing, distinct, numeric, outside, range, quartiles, the commonest number's count,
    and rows, missing and quartiles of the values inside bounds of all other loads of its site (other_...).

    Nothing gathers a site's values. The k-th value of all loads but one is the site's value of rank k + c, where c is the most values
    the load has up to a number that fewer than k of the others reach: running numbers say so, and only that rank is looked up.
    """
    load, site = ["site_code", "column_name", "load_id"], ["site_code", "column_name"]
    c, n = cumulated_counts, F.col("n")
    held = F.when(F.col("inside"), n).otherwise(0)
    ranges = c.groupBy(*load, "range").agg(F.sum(held).alias("held"))
    sums = c.groupBy(*load).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("missing"), n)), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), n)), F.lit(0)).alias("numeric"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull() & ~F.col("inside"), n)), F.lit(0)).alias("outside"),
        F.count("value").alias("distinct_values"),
        F.max(F.when(F.col("number").isNotNull(), F.col("same"))).alias("commonest"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.sum(held).alias("held"),
    )
    total = sums.groupBy(*site).agg(F.sum("rows").alias("site_rows"), F.sum("missing").alias("site_missing"), F.sum("held").alias("site_held"))
    profile = written(sums.join(total, site).withColumns({"other_rows": F.col("site_rows") - F.col("rows"), "other_missing": F.col("site_missing") - F.col("missing"), "ks": _ranks(F.col("held")), "other_ks": _ranks(F.col("site_held") - F.col("held"))}), "profile")
    inside = c.where("inside").select(*load, "range", "number", "at", "upto", "own", "first")
    inside = inside.join(_before(ranges.groupBy(*site, "range").agg(F.sum("held").alias("held")), site, "held", "_site"), [*site, "range"]).join(_before(ranges, load, "held", "_own"), [*load, "range"])
    inside = inside.select(*load, "number", "at", (F.col("upto") + F.col("_site")).alias("upto"), (F.col("own") + F.col("_own")).alias("own"), "first")
    both = inside.join(profile.select(*load, "ks", "other_ks"), load)
    each = [(i, k) for i in range(len(SHARES)) for k in ("k", "k2")]
    mine = [F.min(F.when(F.col("own") >= F.col("ks")[i][k], F.col("number"))).alias(f"own_{i}_{k}") for i, k in each]
    less = [F.coalesce(F.max(F.when(F.col("upto") - F.col("own") < F.col("other_ks")[i][k], F.col("own"))), F.lit(0)).alias(f"less_{i}_{k}") for i, k in each]
    found = both.groupBy(*load).agg(*mine, *less)
    profile = written(profile.join(found, load, "left"), "profile")
    asked = profile.where("site_held > held").select(*load, F.explode(F.array(*(F.struct(F.lit(f"{i}_{k}").alias("which"), (F.col("other_ks")[i][k] + F.coalesce(f"less_{i}_{k}", F.lit(0))).alias("rank")) for i, k in each))).alias("x")).select(*load, "x.*")
    steps = inside.where("first").select(*site, "number", (F.col("upto") - F.col("at")).alias("below"), "upto")
    steps = steps.withColumn("block", F.explode(F.expr(f"sequence(below div {BLOCK}, (upto - 1) div {BLOCK})")))
    met = asked.withColumn("block", F.expr(f"(rank - 1) div {BLOCK}")).join(steps, [*site, "block"]).where("below < rank and rank <= upto")
    other = met.groupBy(*load).agg(*(F.max(F.when(F.col("which") == f"{i}_{k}", F.col("number"))).alias(f"other_{i}_{k}") for i, k in each))
    out = profile.join(other, load, "left")
    quartiles = lambda name, ks: F.when(F.col(f"{name}_0_k").isNotNull(), F.array(*(_between(F.col(f"{name}_{i}_k"), F.col(f"{name}_{i}_k2"), F.col(ks)[i]["part"]) for i in range(len(SHARES)))))
    kept = [*load, "rows", "nulls", "missing", "numeric", "outside", "distinct_values", "commonest", "low", "high", "other_rows", "other_missing"]
    return out.select(*kept, quartiles("own", "ks").alias("quartiles"), quartiles("other", "other_ks").alias("other_quartiles"))


def findings(profile: DataFrame) -> DataFrame:
    """(load_id, column_name, finding) of a profile with others: nulls, pattern, range, shift, constant."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    known = F.col("rows") - F.col("missing")
    own, other = F.col("quartiles"), F.col("other_quartiles")
    rules = {
        "nulls": share("missing", "rows") - share("other_missing", "other_rows") > NULL_EXCESS,
        "pattern": F.try_divide((known - F.col("numeric")).cast("double"), known.cast("double")) > PATTERN_SHARE,
        "range": share("outside", "numeric") > RANGE_SHARE,
        "shift": F.abs(own[1] - other[1]) > other[2] - other[0],
        "constant": share("commonest", "numeric") > CONSTANT_SHARE,
    }
    named = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return profile.select("load_id", "column_name", F.explode(named).alias("finding"))
