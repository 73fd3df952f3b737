"""Which patient, image, acquisition, unit, digest or place a freely written identifier names.

Each function gives a canonical key as a column, null where the text names nothing.
The same steps exist as DuckDB text for side-by-side checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_match, first_match_sql, fold, fold_sql, let, number_key, number_key_sql

_DIGITS = "[oil]*[0-9][0-9oil]*"


def _tagged(tag: str) -> tuple[str, ...]:
    """Where the number of a tagged identifier stands: after the tag, before it, or alone."""
    return (
        f"(?:^|[^a-z]){tag}[^a-z0-9]*({_DIGITS})",
        f"({_DIGITS})[^a-z0-9]*{tag}(?:[^a-z]|$)",
        "^[^a-z0-9]*([0-9]+)(?:[.,]0+)?(?:[^a-z0-9.,].*)?$",
    )


_PHANTOM = "qc[^a-z0-9]*phantom[^a-z0-9]*([0-9oil]*)"


def _patient(c: Column) -> Column:
    return F.when(c.rlike(_PHANTOM), F.concat(F.lit("qc"), number_key(F.regexp_extract(c, _PHANTOM, 1)))).otherwise(F.concat(F.lit("p"), number_key(first_match(c, *_tagged("pt")))))


def patient_key(col: Column | str) -> Column:
    """``p<number>`` of a patient, ``qc<number>`` of the phantom; null and texts without a number give null."""
    return let(fold(col), _patient)


def patient_key_sql(col: str) -> str:
    c = fold_sql(col)
    return (
        f"case when regexp_matches({c}, '{_PHANTOM}') then 'qc' || {number_key_sql(f"regexp_extract({c}, '{_PHANTOM}', 1)")} "
        f"else 'p' || {number_key_sql(first_match_sql(c, *_tagged('pt')))} end"
    )


def image_key(col: Column | str) -> Column:
    """``i<number>`` of an image; null and texts without a number give null."""
    return let(fold(col), lambda c: F.concat(F.lit("i"), number_key(first_match(c, *_tagged("img")))))


def image_key_sql(col: str) -> str:
    return f"'i' || {number_key_sql(first_match_sql(fold_sql(col), *_tagged('img')))}"


_SITE_RUN = "(?:^|[^a-z])aq[^a-z0-9]*([0-9oil]{8,}|[0-9oil]+[^a-z0-9]+[0-9oil]+)", "([0-9oil]{8,}|[0-9oil]+[^a-z0-9]+[0-9oil]+)[^a-z0-9]*aq(?:[^a-z]|$)", "^[^a-z0-9]*([0-9]{8,}|[0-9]+[^a-z0-9]+[0-9]+)(?:[.,]0+)?(?:[^a-z0-9.,].*)?$"


def _acquisition(c: Column) -> Column:
    apart = c.rlike("[^0-9oil]")
    site = F.when(apart, F.regexp_extract(c, "^([0-9oil]+)", 1)).otherwise(F.substring(c, 1, 3))
    run = F.when(apart, F.regexp_extract(c, "([0-9oil]+)$", 1)).otherwise(F.regexp_extract(c, "^...(.*)$", 1))
    return F.concat(F.lit("a"), number_key(site), F.lit("-"), number_key(run))


def acquisition_key(col: Column | str) -> Column:
    """``a<site>-<running number>``; written without a separator the site has three digits. Else null."""
    return let(let(fold(col), lambda c: first_match(c, *_SITE_RUN)), _acquisition)


def acquisition_key_sql(col: str) -> str:
    c = first_match_sql(fold_sql(col), *_SITE_RUN)
    apart = f"regexp_matches({c}, '[^0-9oil]')"
    site = f"case when {apart} then regexp_extract({c}, '^([0-9oil]+)', 1) else substr({c}, 1, 3) end"
    run = f"case when {apart} then regexp_extract({c}, '([0-9oil]+)$', 1) else regexp_extract({c}, '^...(.*)$', 1) end"
    return f"'a' || {number_key_sql(f'({site})')} || '-' || {number_key_sql(f'({run})')}"


_UNIT = "(?:#|no\\.?|nr\\.?|unit|s/n|sn)[^a-z0-9]*([0-9]+)", "/[^a-z0-9]*([0-9]+)", "(?:^|[^0-9])([0-9]{6,})(?:[^0-9]|$)"


def _unit(c: Column) -> Column:
    model = F.regexp_replace(F.regexp_replace(c, "(?:#|no\\.?|nr\\.?|unit|s/n|sn|/)[^a-z0-9]*[0-9]+|[0-9]{6,}", " "), "[^a-z0-9]+", "")
    return F.concat(model, F.lit("#"), number_key(first_match(c, *_UNIT)))


def unit_key(col: Column | str) -> Column:
    """``<model words>#<number>`` of one capture unit; a text that names no unit number gives null."""
    return let(F.regexp_replace(fold(col), "_", " "), _unit)


def unit_key_sql(col: str) -> str:
    c = f"replace({fold_sql(col)}, '_', ' ')"
    model = rf"regexp_replace(regexp_replace({c}, '(?:#|no\.?|nr\.?|unit|s/n|sn|/)[^a-z0-9]*[0-9]+|[0-9]{{6,}}', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
    return f"{model} || '#' || {number_key_sql(first_match_sql(c, *_UNIT))}"


#: SHA-256 of no bytes.
EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def digest_key(col: Column | str) -> Column:
    """The 64 hexadecimal digits of a digest; null for other texts and for the digest of empty content."""
    bare = F.regexp_replace(F.regexp_replace(fold(col), "^(?:sha[^a-z0-9]?256|0x|hex)", ""), "[^0-9a-f]", "")
    return let(bare, lambda c: F.when(c.rlike("^[0-9a-f]{64}$") & (c != EMPTY_DIGEST), c))


def digest_key_sql(col: str) -> str:
    c = f"regexp_replace(regexp_replace({fold_sql(col)}, '^(?:sha[^a-z0-9]?256|0x|hex)', ''), '[^0-9a-f]', '', 'g')"
    return f"case when regexp_matches({c}, '^[0-9a-f]{{64}}$') and {c} <> '{EMPTY_DIGEST}' then {c} end"

_PLACE = "(?:^|/) *([^/]+?) */ *site[^a-z0-9/]*([0-9]+)[^/]*/([^/]+)/([^/]+)/ *im(?:g|age)[^a-z0-9/]*([0-9]+)"


def _place(parts: Column) -> Column:
    """The key of the five steps that ``_PLACE`` matches."""
    source, date = F.regexp_replace(parts[0], "[^a-z0-9]", ""), F.regexp_replace(parts[3], "[^0-9]", "")
    site, image = F.regexp_extract(parts[1], "site[^a-z0-9]*([0-9]+)", 1), F.regexp_extract(parts[4], "([0-9]+)$", 1)
    return F.when(F.length(date) == 8, F.concat(source, F.lit("|"), number_key(site), F.lit("|"), let(parts[2], _patient), F.lit("|"), date, F.lit("|"), number_key(image)))


def _climbed(c: Column) -> Column:
    """A path without ``..``: each takes back the step before it, if there is one."""
    back = lambda done, part: (part == "..") & (F.size(done) > 0) & ~F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")).isin("", "..")
    walk = lambda done, part: F.when(back(done, part), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    return F.when(c.contains("/../"), F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), walk), "/")).otherwise(c)


def path_key(col: Column | str) -> Column:
    """``source|site|patient|date|image number`` of a path below any mount root; null if it names no such place.

    Either slash, percent escapes, case, ``.``, ``..`` and repeated slashes make no difference, nor what follows the image number.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(fold(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)), r"[\\/]+", "/")
    c = let(F.regexp_replace(c, r"/(?: *\./)+", "/"), _climbed)
    return let(F.regexp_extract(c, _PLACE, 0), lambda found: F.when(found != "", let(F.split(F.ltrim(found, F.lit("/")), "/"), _place)))


def path_key_sql(col: str) -> str:
    c = f"regexp_replace({fold_sql(f"url_decode(replace({col}, '+', '%2B'))")}, '[\\\\/]+', '/', 'g')"
    c = rf"regexp_replace({c}, '/(?: *\./)+', '/', 'g')"
    # steps are pushed on a list, and ".." takes the last one off
    c = f"""list_aggregate(list_reduce(list_prepend([''], list_transform(string_split({c}, '/'), lambda x: [x])), lambda done, x: case when x = ['..'] and len(done) > 1 and done[len(done)] not in ('', '..') then done[:len(done) - 1] else list_concat(done, x) end)[2:], 'string_agg', '/')"""
    part = lambda n: f"regexp_extract({c}, '{_PLACE}', {n})"
    date = f"regexp_replace({part(4)}, '[^0-9]', '', 'g')"
    key = f"regexp_replace({part(1)}, '[^a-z0-9]', '', 'g') || '|' || {number_key_sql(part(2))} || '|' || {patient_key_sql(part(3))} || '|' || {date} || '|' || {number_key_sql(part(5))}"
    return f"case when regexp_matches({c}, '{_PLACE}') and length({date}) = 8 then {key} end"
