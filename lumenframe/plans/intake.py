"""Queries on delivered loads (5) and on export files (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import column_quality as quality
from ..operators import schema_drift as drift
from ..sources.chunks import chunks, column_profile, value_counts
from ..sources.tables import table
from .staging import written

MEASURED = ("target_value", "working_distance_mm", "incidence_angle_deg")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/intake_manifest.parquet"
    raw = value_counts(spark, path, ["load_id", "site_code", "biomarker"], MEASURED)
    counts = raw.withColumn("load_id", F.col("load_id").cast("int")).where("load_id is not null and site_code is not null").drop("source")
    rows = int(chunks(spark, path).agg(F.sum("rows")).first()[0] or 0)
    return quality.profiled(written(quality.cumulated(quality.classified(counts, table(spark, d, "column_bounds")), rows), "counts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The findings of each load and measured column."""
    return quality.findings(_profile(spark, d))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Counts, range and quartiles of each load and measured column, beside the other loads of its site."""
    q, o = F.col("quartiles"), F.col("other_quartiles")
    return _profile(spark, d).select("load_id", "site_code", "column_name", "rows", "nulls", "missing", "distinct_values", "numeric", "outside", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(q[1], 6).alias("median"), F.round(o[1], 6).alias("other_median"))


PROFILED = (*MEASURED, "exposure_us", "iso", "image_width", "image_height")


def p5_columns(spark: SparkSession, d: str) -> DataFrame:
    """Rows, nulls, extrema and distinct values of whole columns, from footers where these are exact."""
    return column_profile(spark, f"{d}/intake_manifest.parquet", PROFILED).drop("from_footers", "scanned")


def catalog(spark: SparkSession, d: str) -> list[str]:
    """Field names of the catalogue: a fixed list of a few names."""
    return [r["field_name"] for r in table(spark, d, "field_catalog").select("field_name").distinct().orderBy("field_name").collect()]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each change that a file makes to the fields of its feed."""
    rows = table(spark, d, "export_rows")
    header = written(drift.headers(drift.file_fields(rows, catalog(spark, d))), "headers")
    order = written(drift.file_order(rows), "order")
    return drift.changes(order, header).select(F.col("file_id").cast("int").alias("file_id"), "field_name", "change_kind")


def p6_log(spark: SparkSession, d: str) -> DataFrame:
    """The same changes in order of time, with spelling and kind before and after."""
    rows = table(spark, d, "export_rows")
    header = written(drift.headers(drift.file_fields(rows, catalog(spark, d))), "headers")
    log = drift.changes(written(drift.file_order(rows), "order"), header)
    return log.select("feed", "exported_at", "file_id", "field_name", "change_kind", "before.spelling", F.col("before.kind").alias("kind"), F.col("after.spelling").alias("new_spelling"), F.col("after.kind").alias("new_kind")).orderBy("feed", "exported_at", "file_id", "field_name", "change_kind")


def p6_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a field in a file with the number of its values; rarer ones too, which changes between files leave out."""
    f = drift.file_fields(table(spark, d, "export_rows"), catalog(spark, d)).groupBy("file_id", "field_name", "spelling").agg(F.sum("n").alias("n"))
    return f.withColumn("commonest", F.col("n") == F.max("n").over(W.partitionBy("file_id", "field_name")))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable lines as one table with the catalogued fields in their union types."""
    rows, names = table(spark, d, "export_rows"), catalog(spark, d)
    return drift.union_table(rows, names, drift.union_schema(drift.file_fields(rows, names), names))


QUERIES = {"p5_found": p5_found, "p5_profile": p5_profile, "p5_columns": p5_columns, "p6_found": p6_found, "p6_log": p6_log, "p6_table": p6_table, "p6_spellings": p6_spellings}

_WORDS = ", ".join(f"'{w}'" for w in quality.NO_VALUE)
_P5 = rf"""long as (select load_id, site_code, biomarker, 'target_value' as column_name, target_value as v from intake_manifest
union all select load_id, site_code, biomarker, 'working_distance_mm', working_distance_mm from intake_manifest
union all select load_id, site_code, biomarker, 'incidence_angle_deg', incidence_angle_deg from intake_manifest),
t as (select *, regexp_replace(v, '^\s+|\s+$', '', 'g') as x from long),
m as (select *, coalesce(not regexp_matches(x, '[\p{{L}}\p{{N}}]') or lower(x) in ({_WORDS}), true) as missing from t),
n as (select *, case when not missing and regexp_matches(x, '^[+-]?[0-9]+(\.[0-9]+)?$') then x::double end as num from m),
c as materialized (select n.*, num is not null and coalesce(num between low_value and high_value, true) as inside from n left join column_bounds b on b.column_name = n.column_name and (b.biomarker is null or b.biomarker = n.biomarker)),
own as (select load_id, site_code, column_name, count(*) as rows, count(*) - count(v) as nulls, count(*) filter (missing) as missing, count(distinct v) as distinct_values, count(num) as numeric, count(*) filter (num is not null and not inside) as outside, min(num) as low, max(num) as high, median(num) filter (inside) as med from c group by all),
same as (select load_id, column_name, max(k) as commonest from (select load_id, column_name, num, count(*) as k from c where num is not null group by all) group by all),
other as (select o.load_id, o.column_name, count(*) as rows, count(*) filter (c.missing) as missing, median(c.num) filter (c.inside) as med, quantile_cont(c.num, 0.75) filter (c.inside) - quantile_cont(c.num, 0.25) filter (c.inside) as iqr from own o join c on c.site_code = o.site_code and c.column_name = o.column_name and c.load_id <> o.load_id group by all)"""

SQL = {
    "p5_found": f"""with {_P5}, j as (select own.*, commonest, other.rows as o_rows, other.missing as o_missing, other.med as o_med, iqr from own left join same using (load_id, column_name) left join other using (load_id, column_name))
select load_id, column_name, 'nulls' as finding from j where missing / rows - o_missing / o_rows > 0.20
union all select load_id, column_name, 'pattern' from j where (rows - missing - numeric) / nullif(rows - missing, 0) > 0.08
union all select load_id, column_name, 'range' from j where outside / nullif(numeric, 0) > 0.08
union all select load_id, column_name, 'shift' from j where abs(med - o_med) > iqr
union all select load_id, column_name, 'constant' from j where commonest / nullif(numeric, 0) > 0.30""",
    "p5_profile": f"""with {_P5} select own.load_id, own.site_code, own.column_name, own.rows, own.nulls, own.missing, own.distinct_values, own.numeric, own.outside, round(own.low, 6) as low, round(own.high, 6) as high, round(own.med, 6) as median, round(other.med, 6) as other_median
from own left join other using (load_id, column_name)""",
}

# The fields' names told by patterns over the letters of a name, apart from the library's concepts.
_NAMED = {
    "participant_uuid": "regexp_matches(w, 'participant|patient')", "cbc_hgb_g_dl": "contains(w, 'cbc')", "survey_haemoglobin": "contains(w, 'survey') and regexp_matches(w, 'globin|hgb|hb')",
    "device_model": "regexp_matches(w, 'device|phone')", "iso": "regexp_matches(w, '^iso|iso$|^sensitivity$')", "exposure_us": "starts_with(w, 'exp')", "flash_mode": "contains(w, 'flash')",
    "white_balance_mode": "regexp_matches(w, '^a?wb|^whitebalance')", "image_tongue": "regexp_matches(w, 'image|img') and contains(w, 'tongue')", "image_conjunctiva": "regexp_matches(w, 'image|img') and contains(w, 'conj')",
    "camera_meta_tongue": "regexp_matches(w, 'cam|meta') and contains(w, 'tongue')", "camera_meta_conjunctiva": "regexp_matches(w, 'cam|meta') and contains(w, 'conj')", "session_id": "contains(w, 'session')",
    "operator_id": "regexp_matches(w, '^op($|erator)')", "focus_state": "regexp_matches(w, '^af|focus')", "bit_depth": "regexp_matches(w, '^bit')",
}
_FIELDS = f"""lines as materialized (select row_id, file_id, payload from export_rows where file_id is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
vals as (select row_id, file_id, key as spelling, type, value, coalesce(regexp_replace(lower(key), '[^a-z]', '', 'g'), '') as w from lines, json_each(lines.payload)),
named as materialized (select row_id, file_id, spelling, value, case when type in ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') then 'number' when type = 'VARCHAR' then 'text' else lower(type) end as kind, case {' '.join(f"when {rule} then '{f}'" for f, rule in _NAMED.items())} else spelling end as field_name
from vals where type <> 'NULL' and not (type = 'VARCHAR' and trim(value ->> '$') = ''))"""
_DRIFT = f"""{_FIELDS}, spelled as (select file_id, field_name, spelling from named group by file_id, field_name, spelling qualify row_number() over (partition by file_id, field_name order by count(*) desc, spelling desc) = 1),
kinds as (select file_id, field_name, kind from named group by file_id, field_name, kind qualify row_number() over (partition by file_id, field_name order by count(*) desc, kind desc) = 1), header as materialized (select * from spelled join kinds using (file_id, field_name)),
files as (select feed, file_id, min(exported_at) as exported_at from export_rows where file_id is not null group by all), steps as materialized (select *, lag(file_id) over (partition by feed order by exported_at, file_id) as previous_id from files),
both_ as (select coalesce(n.file_id, o.file_id) as file_id, coalesce(n.field_name, o.field_name) as field_name, o.spelling, o.kind, n.spelling as new_spelling, n.kind as new_kind
from (select h.* from header h join steps using (file_id) where previous_id is not null) n full join (select s.file_id, h.field_name, h.spelling, h.kind from steps s join header h on h.file_id = s.previous_id) o on n.file_id = o.file_id and n.field_name = o.field_name),
changed as (select *, case when spelling is null then ['added'] when new_spelling is null then ['removed'] else list_filter([case when spelling <> new_spelling then 'renamed' end, case when kind <> new_kind then 'retyped' end], lambda x: x is not null) end as kinds from both_),
log as materialized (select s.feed, s.exported_at, file_id, field_name, unnest(kinds) as change_kind, spelling, kind, new_spelling, new_kind from changed join steps s using (file_id))"""
_FIRST = lambda f: f"max(case when field_name = '{f}' then case when kind in ('text') then value ->> '$' else value::varchar end end)"
_CAMERA = lambda meta, key: f"""nullif(case when json_type({meta}, '$."{key}"') = 'OBJECT' then case when json_exists({meta}, '$."{key}".result') then {meta} ->> '$."{key}".result' else {meta} ->> '$."{key}".request' end else {meta} ->> '$."{key}"' end, '')"""
_IMAGES = " union all ".join(
    f"select id, v, method, '{m}' as roi_type, case when json_valid(image_{m}) and json_type(image_{m}) = 'OBJECT' then image_{m} ->> '$.path' else image_{m} end as path, case when json_valid(camera_meta_{m}) then {_CAMERA(f'camera_meta_{m}::json', 'android.sensor.sensitivity')} end as iso from target" for m in ("tongue", "conjunctiva")
)

SQL |= {
    "p6_table": f"with {_FIELDS} select l.row_id, l.file_id::bigint as file_id, {', '.join(f'{_FIRST(f)} as {f}' for f in _NAMED)} from lines l left join named n using (row_id) group by l.row_id, l.file_id",
    "p6_spellings": f"with {_FIELDS} select file_id::bigint as file_id, field_name, spelling, count(*) as n, count(*) = max(count(*)) over (partition by file_id, field_name) as commonest from named group by file_id, field_name, spelling",
    "p6_found": f"with {_DRIFT} select file_id, field_name, change_kind from log",
    "p6_log": f"with {_DRIFT} select * from log",
    "participant_images": f"""with {_FIELDS}, wide as (select row_id, {_FIRST('participant_uuid')} as id, {_FIRST('cbc_hgb_g_dl')} as cbc, {_FIRST('survey_haemoglobin')} as survey, {', '.join(f"{_FIRST(f)} as {f}" for m in ('tongue', 'conjunctiva') for f in (f'image_{m}', f'camera_meta_{m}'))} from named group by row_id),
target as (select *, try_cast(coalesce(cbc, survey) as double) as v, case when cbc is not null then 'complete_blood_count' else 'survey' end as method from wide where id is not null), images as ({_IMAGES})
select roi_type, method as reference_method, count(*) as images, round(avg(v), 6) as target, count(try_cast(iso as double)) as with_iso from images where path is not null and trim(path) <> '' and v is not null and not isnan(v) group by all""",
}
SQL["p5_columns"] = " union all ".join(
    f"select '{c}' as column_name, count(*) as rows, count(*) - count({c}) as nulls, {f'null::double as low_number, null::double as high_number, min({c}) as low_text, max({c}) as high_text' if c in MEASURED else f'min({c})::double as low_number, max({c})::double as high_number, null::varchar as low_text, null::varchar as high_text'}, count(distinct {c}) as distinct_values from intake_manifest"
    for c in PROFILED
)
