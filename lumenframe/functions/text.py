"""Text folding as column expressions: one spelling for many, without leaving the JVM.

Every function accepts a column (or its name) and returns a column; null stays null.
``*_sql`` variants give the same expression as DuckDB text for side-by-side checks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "К": "K", "М": "M", "Т": "T", "В": "B", "Н": "H",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
}


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str]:
    """Two strings of equal length for ``translate``: decimal digits of every script and width
    variants of ASCII become ASCII, by Unicode's own tables; look-alike letters become Latin."""
    pairs = dict(LOOKALIKES)
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if (d := unicodedata.decimal(ch, None)) is not None:
            pairs[ch] = str(d)
        elif 0xFF01 <= code <= 0xFF5E:
            pairs[ch] = unicodedata.normalize("NFKC", ch)
    keys = sorted(pairs)
    return "".join(keys), "".join(pairs[k] for k in keys)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(col: Column | str) -> Column:
    """Lower case, ASCII digits, no invisible format characters, white space trimmed and single.

    A text of white space or invisible characters only becomes the empty string; null stays null.
    """
    c = F.col(col) if isinstance(col, str) else col
    plain = F.when(c.rlike("^[ -~]*$"), c).otherwise(F.translate(F.regexp_replace(c, r"\p{Cf}", ""), *fold_tables()))
    return F.trim(F.regexp_replace(F.lower(plain), r"[\s\p{Z}\x00-\x1f]+", " "))


def fold_sql(col: str) -> str:
    a, b = (t.replace("'", "''") for t in fold_tables())
    return rf"trim(regexp_replace(lower(translate(regexp_replace({col}, '\p{{Cf}}', '', 'g'), '{a}', '{b}')), '[\s\p{{Z}}\x00-\x1f]+', ' ', 'g'))"


def first_match(col: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches with a group that isn't empty; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(col, p, 1), F.lit("")) for p in patterns))


def first_match_sql(col: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, '{p}', 1), '')" for p in patterns) + ")"


def number_key(col: Column) -> Column:
    """Digits that may hold o, i and l for 0 and 1, without leading zeros; '0' for zeros only; null for null."""
    return F.when(col.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(F.translate(col, "oil", "011"), "^0+", ""), F.lit("")), F.lit("0")))


def number_key_sql(col: str) -> str:
    return f"case when {col} is not null then coalesce(nullif(regexp_replace(translate({col}, 'oil', '011'), '^0+', ''), ''), '0') end"
