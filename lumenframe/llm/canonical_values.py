"""Freely entered values mapped to a list of permitted entries.

Labels and aliases of a field form one trie whose ends name entries. A value walks it as a
Levenshtein automaton: a state is the row of edit distances (with neighbouring letters swapped as
one edit) between the value and the path so far, and a path is left as soon as no state in its row is
within the limit. The limit grows with length (see ``allowed``). All entries within it are returned,
the nearest is taken; a tie between different entries, or none within the limit, is unmatched (entry 0).

A value is tried as written and without what people add around it: quotes, brackets, list numbers,
the field's name, remarks after a comma, slash, dash or bracket. Digits inside words may stand for
letters, a point for the rest of a word, and a word without its vowels for the word. The first reading that is an entry
letter by letter counts before all edits, edits before abbreviations.

Null, blank and invisible values, and values that are literally a label, give no row. An empty
vocabulary leaves every value unmatched. Repeated rows give repeated results. Extra columns are
ignored. A vocabulary of at most BLOCK entries goes to every task. A larger one is dealt by Spark to blocks of about BLOCK
entries; each distinct value meets each block of its field, in parts of about PART values, and the best ranks of all
blocks decide as one trie would, so results don't depend on BLOCK.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_tables
from ..plans.staging import written

BLOCK = 20_000
PART = 100_000
MEMO = 200_000

_TABLE = str.maketrans(*fold_tables())
_INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁯﻿]")
_BETWEEN = re.compile(r"[\s_\-‐-―−./\\|+]+")
_LEET = str.maketrans("013457", "oieast")
_WRAPS = re.compile(r"""^[\s"'`´‘’“”«»<>(\[{*~.,;:!?=#-]+|[\s"'`´‘’“”«»<>)\]}*~.,;:!?=#-]+$""")
_LEADS = re.compile(r"^(?:[-=]*>|\d+\s*[).]|[a-z_ ]{2,30}\s*[:=]|(?:mode|set to|is|now|was|value|type)\s)\s*")
_TRAILS = re.compile(r"\s*(?:[(\[{<].*|[,;/|].*|\s[-–—]\s.*|\s\d+/\d+|\s\*+)$")
_VOWELS = re.compile("[aeiou]")


def allowed(length: int) -> int:
    """Edits allowed for a value of so many letters."""
    return 0 if length < 3 else 1 if length < 7 else 2 if length < 12 else 3


def plain(text: str) -> str:
    text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text)).translate(_TABLE).lower()
    return " ".join(text.split())


def _words(text: str) -> str:
    return _BETWEEN.sub(" ", text).strip()


def readings(text: str) -> list[str]:
    """What a plain text may say: as it is, and without its surroundings; each with digits as letters too. Every step shortens the text, so the steps end."""
    out, seen = [], {text}
    queue = [text]
    while queue:
        t = queue.pop(0)
        out.append(t)
        for u in (_WRAPS.sub("", t), _LEADS.sub("", t), _TRAILS.sub("", t)):
            if u and u not in seen:
                seen.add(u)
                queue.append(u)
    both = [*out, *(t.translate(_LEET) for t in out if re.search("[a-z]", t) and re.search("[013457]", t))]
    return list(dict.fromkeys(filter(None, map(_words, both))))


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    entries: set[int] = field(default_factory=set)


class Trie:
    """Paths of one field: labels, aliases, and words without vowels (which only match exactly)."""

    def __init__(self, paths: Iterable[tuple[str, int]]):
        self.root, self.bare, self.ends, self.longest = Node(), {}, [], 0
        for path, entry in paths:
            node = self.root
            for ch in (words := _words(plain(path))):
                node = node.next.setdefault(ch, Node())
            if words:
                node.entries.add(entry)
                self.ends.append((words, entry))
                self.longest = max(self.longest, len(words))
                bare = words[0] + _VOWELS.sub("", words[1:])
                if len(bare) >= 4 and bare != words:
                    self.bare.setdefault(bare, set()).add(entry)

    def within(self, value: str, limit: int) -> dict[int, int]:
        """Every entry with a path within ``limit`` edits of ``value``, with its smallest distance."""
        found: dict[int, int] = {}
        if len(value) > self.longest + limit:
            return found
        stack = [(self.root, "", tuple(range(len(value) + 1)), None)]
        while stack:
            node, last, row, before = stack.pop()
            if node.entries and row[-1] <= limit:
                for e in node.entries:
                    found[e] = min(row[-1], found.get(e, row[-1]))
            for ch, child in node.next.items():
                new = [row[0] + 1]
                for j, v in enumerate(value, 1):
                    d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (v != ch))
                    if before and j > 1 and v == last and value[j - 2] == ch:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= limit or min(row) < limit:
                    stack.append((child, ch, tuple(new), row))
        return found

    def shortened(self, value: str) -> set[int]:
        """Entries of paths that ``value`` abbreviates: a point after three letters or more stands for the rest of a word,
        a dash after the first letter for what lies before the ending."""
        if m := re.fullmatch("([a-z])-([a-z]{3,})", value):
            return {e for words, e in self.ends if words[0] == m[1] and words.endswith(m[2])}
        here = [self.root]
        for token in re.findall(r"[^\s.]+\.?", value):
            word, point = token.rstrip("."), token.endswith(".")
            if point and len(word) < 3:
                return set()
            if here != [self.root]:
                here = [n.next[" "] for n in here if " " in n.next]
            for ch in word:
                here = [n.next[ch] for n in here if ch in n.next]
            if point:
                ends = []
                while here:
                    ends += here
                    here = [c for n in here for ch, c in n.next.items() if ch != " "]
                here = ends
        return {e for n in here for e in n.entries}

    def ranked(self, text: str) -> dict[int, tuple[int, int]]:
        """Every entry that a raw value may stand for, with its rank: (0, which reading) for equal letters, (1, edits), (2, 1) for abbreviations."""
        folded = plain(text)
        found: dict[int, tuple[int, int]] = {}
        for i, reading in enumerate(readings(folded)):
            near = dict.fromkeys(self.bare.get(reading, ()), 1)
            for e, d in self.within(reading, allowed(len(reading))).items():
                near[e] = min(d, near.get(e, d))
            for e, d in near.items():
                rank = (0, i) if d == 0 else (1, d)
                found[e] = min(rank, found.get(e, rank))
        if not found and ("." in folded or "-" in folded):
            found = dict.fromkeys(self.shortened(_WRAPS.sub("", folded) + "." * folded.endswith(".")), (2, 1))
        return found

    def nearest(self, text: str) -> tuple[int, int]:
        """(entry, distance) that a raw value stands for; entry 0 if none or undecided."""
        return decided(self.ranked(text))


def decided(found: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """The one entry of the least rank, with its distance; (0, 0) if there is none or more than one."""
    low = min(found.values(), default=None)
    first = [e for e, rank in found.items() if rank == low]
    return (first[0], low[1] if low[0] else 0) if len(first) == 1 else (0, 0)


ENTRIES = ("entry_id", "field_name", "entry_label", "also_called")
FOUND = "record_id long, field_name string, value string, entry_id int, distance int, is_label boolean"


def _trie(entries: Iterable[tuple[int, str, str, str | None]], name: str) -> Trie:
    return Trie((p, e) for e, f, label, more in entries if f == name for p in (label, *(more or "").split("|")) if p)


def _mapped(df: DataFrame, fields: Sequence[str], entries: list[tuple[int, str, str, str | None]]) -> DataFrame:
    labels = {f: frozenset(x for _, g, x, _ in entries if g == f) for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {f: _trie(entries, f) for f in fields}
        memo: dict[tuple[str, str], tuple[int, int, bool] | None] = {}
        for b in batches:
            for f in fields:
                coded = b.column(f).dictionary_encode()
                answers = []
                for value in coded.dictionary.to_pylist():
                    key = (f, value)
                    if key not in memo:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[key] = (*tries[f].nearest(value), value in labels[f]) if plain(value) else None
                    answers.append(memo[key])
                entry = pa.array([a and a[0] for a in answers], pa.int32()).take(coded.indices)
                keep = pa.compute.is_valid(entry)
                distance = pa.array([a and a[1] for a in answers], pa.int32()).take(coded.indices)
                label = pa.array([a and a[2] for a in answers], pa.bool_()).take(coded.indices)
                n = pa.array([f] * len(entry), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("record_id"), n, b.column(f), entry, distance, label], names=["record_id", "field_name", "value", "entry_id", "distance", "is_label"]).filter(keep)

    return df.select("record_id", *fields).mapInArrow(run, FOUND)


def _values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(record_id, field_name, value) of the fields' values."""
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(F.col("record_id").cast("long").alias("record_id"), F.explode(each).alias("v")).select("record_id", "v.*").where("value is not null")


def ranks(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field_name, value, entry_id, kind, distance, is_label) for every entry that a distinct value may stand for, over all blocks of the vocabulary.

    ``values`` is (field_name, value). Kind and distance are the rank of ``Trie.ranked``, by block: an abbreviation
    only counts where no block has a closer reading. A value without an entry has one row with null.
    """
    held = vocabulary.where("field_name is not null and entry_label is not null").select(*ENTRIES)
    distinct = written(values.distinct(), "values")
    n_blocks, n_parts = (max(1, -(-d.count() // size)) for d, size in ((held, BLOCK), (distinct, PART)))
    block = F.pmod(F.xxhash64("entry_id", "entry_label"), F.lit(n_blocks)).alias("block")
    parts = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part")
    right = held.select("*", block, parts)
    left = distinct.select("field_name", "value", F.pmod(F.xxhash64("value"), F.lit(n_parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))

    def match(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked):
            known = [(int(e), f, label, more) for e, f, label, more in entries[list(ENTRIES)].itertuples(index=False)]
            name = asked["field_name"].iloc[0]
            trie, labels = _trie(known, name), {x for _, _, x, _ in known}
            for value in asked["value"]:
                if plain(value):
                    got = trie.ranked(value).items()
                    out += [(name, value, e, *rank, value in labels) for e, rank in got] or [(name, value, None, None, None, value in labels)]
        return pd.DataFrame(out, columns=["field_name", "value", "entry_id", "kind", "distance", "is_label"]).astype({"entry_id": "Int32", "kind": "Int32", "distance": "Int32", "is_label": "boolean"})

    keys = ["field_name", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match, "field_name string, value string, entry_id int, kind int, distance int, is_label boolean")


def candidates(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field_name, value, entry_id, distance) of every entry within the limit of each distinct value, near or not; labels of the field and blank values have none."""
    found = ranks(values, vocabulary)
    best = found.groupBy("field_name", "value", "entry_id").agg(F.min(F.struct("kind", "distance")).alias("r"), F.bool_or("is_label").alias("is_label"))
    whole = best.groupBy("field_name", "value").agg(F.bool_or("is_label").alias("is_label"), F.min("r.kind").alias("kind"), F.collect_list(F.struct("entry_id", "r")).alias("all"))
    each = whole.where("not is_label").select("field_name", "value", "kind", F.explode("all").alias("x")).where("x.entry_id is not null and (x.r.kind < 2 or kind = 2)")
    return each.select("field_name", "value", "x.entry_id", F.when(F.col("x.r.kind") == 0, 0).otherwise(F.col("x.r.distance")).alias("distance"))


def map_values(df: DataFrame, fields: Sequence[str], vocabulary: DataFrame) -> DataFrame:
    """record_id, field_name, value, entry_id and distance for each value that isn't null, blank or a label."""
    few = [tuple(r) for r in vocabulary.where("field_name is not null and entry_label is not null").select(*ENTRIES).limit(BLOCK + 1).collect()]
    if len(few) <= BLOCK:
        return _mapped(df, fields, few).where("not is_label").drop("is_label")
    values = _values(df, fields)
    rank = F.struct("kind", "distance")
    least = ranks(values.drop("record_id"), vocabulary).groupBy("field_name", "value", "entry_id").agg(F.min(F.when(F.col("entry_id").isNotNull(), rank)).alias("r"), F.bool_or("is_label").alias("is_label"))
    # the least rank and its entries: a tie shows as different least and greatest entries
    low = least.groupBy("field_name", "value").agg(F.min("r").alias("low"), F.bool_or("is_label").alias("is_label"))
    ends = least.join(low.drop("is_label"), ["field_name", "value"]).where("r = low").groupBy("field_name", "value").agg(F.min("entry_id").alias("a"), F.max("entry_id").alias("b"))
    answer = low.where("not is_label").join(ends, ["field_name", "value"], "left").withColumn("one", F.coalesce(F.col("a") == F.col("b"), F.lit(False)))
    answer = answer.select("field_name", "value", F.when(F.col("one"), F.col("a")).otherwise(0).alias("entry_id"), F.when(F.col("one") & (F.col("low.kind") > 0), F.col("low.distance")).otherwise(0).alias("distance"))
    return values.join(answer, ["field_name", "value"]).select("record_id", "field_name", "value", "entry_id", "distance")
