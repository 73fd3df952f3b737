"""Records that two splits share, found by winnowed fingerprints.

A record is a sequence of identifiers. Each identifier is two 32-bit symbols (the halves of its
64-bit hash), and the sequence closes on its first identifier, so that any two identifiers of three
stand side by side. Rolling hashes run over K = 3 symbols, which always reach into two identifiers;
of each WINDOW = 2 hashes the smaller is kept. Two records with two neighbouring identifiers in
common share four symbols, K + WINDOW - 1, and so at least one kept hash at the same place.
Shared hashes are joined across splits. The seeds of a pair are chained along each diagonal (the turn that lays one
ring on the other), a chain is extended identifier by identifier to the whole alignment on its diagonal, and the
longest alignment of a pair decides: two identifiers or more are an overlap.

Hashes that very many records of both splits share would meet in one task. A bounded sample of records tells which may be; their
records are dealt to a grid of g x g cells, rows of one side to its lines, of the other to its columns, so that every pair still
meets once. The sample only decides how work is spread, never what is found.

Nulls: an identifier that is null equals nothing and breaks the sequence. Empty tables give empty
results. Records with the same id more than once count once each and give repeated pairs once.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.staging import written

K = 3
WINDOW = 2
#: Records looked at for crowded hashes, how often such a hash is seen there at least, pairs a task may make, and most lines of a grid.
SAMPLE, LEAST_SEEN, PAIRS_A_TASK, MOST_LINES = 200_000, 8, 1_000_000, 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(symbols: np.ndarray) -> np.ndarray:
    """(rows, n) symbols -> (rows, n - K + 1) polynomial hashes modulo 2**64, each from the one before."""
    with np.errstate(over="ignore"):
        first = np.zeros(len(symbols), np.uint64)
        for j in range(K):
            first = first * _BASE + symbols[:, j]
        out, top = [first], _BASE ** np.uint64(K - 1)
        for j in range(K, symbols.shape[1]):
            out.append((out[-1] - symbols[:, j - K] * top) * _BASE + symbols[:, j])
        grams = np.stack(out, axis=1)
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        return grams ^ (grams >> np.uint64(29))


def kept(grams: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which hashes winnowing keeps: in each window of whole grams the smallest, the rightmost of equals.

    A window that holds a broken gram keeps each of its whole ones, as no full window guards them.
    """
    keep = np.zeros(grams.shape, bool)
    for j in range(grams.shape[1] - WINDOW + 1):
        right = grams[:, j + 1] <= grams[:, j]
        both = whole[:, j] & whole[:, j + 1]
        keep[:, j] |= whole[:, j] & (~both | ~right)
        keep[:, j + 1] |= whole[:, j + 1] & (~both | right)
    return keep


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [b.column(f"c{j}") for j in range(b.num_columns - 2)]
        codes = [*codes, codes[0]]
        known = np.stack([np.asarray(c.is_valid()) for c in codes], axis=1)
        full = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for c in codes], axis=1)
        symbols = np.empty((len(full), 2 * full.shape[1]), np.uint64)
        symbols[:, 0::2] = full >> np.uint64(32)
        symbols[:, 1::2] = full & np.uint64(0xFFFFFFFF)
        valid = np.repeat(known, 2, axis=1)
        whole = np.stack([valid[:, j : j + K].all(axis=1) for j in range(valid.shape[1] - K + 1)], axis=1)
        grams = rolling(symbols)
        row, place = np.nonzero(kept(grams, whole))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [b.column("record_id").take(take), b.column("side").take(take), pa.array(grams[row, place].view(np.int64)), pa.array(place.astype(np.int8)), *(c.take(take) for c in codes[:-1])],
            names=["record_id", "side", "h", "place", *(f"c{j}" for j in range(len(codes) - 1))],
        )


def coded(df: DataFrame, record_id: Column, side: Column, identifiers: Sequence[Column]) -> DataFrame:
    """record_id, side and the 64-bit code of each identifier, null for none."""
    out = df.select(record_id.cast("long").alias("record_id"), side.cast("boolean").alias("side"), *(F.when(c.isNotNull(), F.xxhash64(c)).alias(f"c{j}") for j, c in enumerate(identifiers)))
    return out.where("record_id is not null and side is not null")


def fingerprints(codes: DataFrame) -> DataFrame:
    """record_id, side, h, place and the code of each identifier: one row for each kept hash of a record."""
    n = len(codes.columns) - 2
    schema = "record_id long, side boolean, h long, place byte, " + ", ".join(f"c{j} long" for j in range(n))
    return codes.mapInArrow(_fingerprints, schema)


def crowded(codes: DataFrame, records: int) -> DataFrame:
    """(h, g) of hashes that, by a sample of about SAMPLE records, have more than PAIRS_A_TASK pairs, with the side of the grid that parts them; at most SAMPLE / 2 rows."""
    fraction = min(1.0, SAMPLE / max(1, records))
    some = fingerprints(codes.sample(fraction=fraction, seed=3) if fraction < 1 else codes).select("h", "side")
    pairs = F.count_if("side").cast("double") * F.count_if(~F.col("side")) / F.lit(fraction * fraction)
    held = some.groupBy("h").agg(pairs.alias("pairs"), F.count("*").alias("n")).where((F.col("pairs") > PAIRS_A_TASK) & (F.col("n") >= LEAST_SEEN))
    return held.select("h", F.least(F.ceil(F.sqrt(F.col("pairs") / PAIRS_A_TASK)), F.lit(MOST_LINES)).cast("int").alias("g"))


def shared_records(df: DataFrame, record_id: Column, side: Column, identifiers: Sequence[Column]) -> DataFrame:
    """Pairs of a record of one side (``side`` true) and one of the other whose longest alignment covers two identifiers or more.

    Columns: record_id_a (side true), record_id_b, shared (identifiers that the alignment covers), seeds (length
    of its chain), turn (its diagonal) and coverage (share of a record's identifiers that it covers).
    """
    n, seen = len(identifiers), Observation()
    codes = written(coded(df, record_id, side, identifiers).observe(seen, F.count("*").alias("n")), "codes")
    hot = crowded(codes, seen.get["n"]).collect()
    a, b = (fingerprints(codes.where("side" if s == "a" else "not side")).select(F.col("record_id").alias(f"record_id_{s}"), "h", F.col("place").alias(f"place_{s}"), *(F.col(f"c{j}").alias(f"{s}{j}") for j in range(n))) for s in "ab")
    on = ["h"]
    if hot:
        grid = F.broadcast(codes.sparkSession.createDataFrame([tuple(r) for r in hot], "h long, g int"))
        line = lambda of: F.pmod(F.xxhash64(of), F.coalesce("g", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))
        a = a.join(grid, "h", "left").select("*", line("record_id_a").alias("line"), every.alias("column")).drop("g")
        b = b.join(grid, "h", "left").select("*", line("record_id_b").alias("column"), every.alias("line")).drop("g")
        on = ["h", "line", "column"]
    same = lambda k: sum((F.coalesce((F.col(f"a{j}") == F.col(f"b{(j + k) % n}")).cast("int"), F.lit(0)) for j in range(n)), F.lit(0))
    diagonal = F.pmod(F.col("place_b").cast("int") - F.col("place_a"), F.lit(2 * n))
    seeds = a.join(b, on).withColumn("diagonal", diagonal)
    # a turn by half an identifier lays no identifier on another
    shared = F.coalesce(*(F.when(F.col("diagonal") == 2 * k, same(k)) for k in range(n)), F.lit(0))
    place = F.expr("shiftleft(1, cast(place_a as int))")
    chains = seeds.withColumn("shared", shared).groupBy("record_id_a", "record_id_b").agg(
        F.max(F.struct("shared", (-F.col("diagonal")).alias("back"))).alias("best"), *(F.bit_or(F.when(F.col("diagonal") == 2 * k, place)).alias(f"chain{k}") for k in range(n))
    )
    chain = F.coalesce(*(F.when(F.col("best.back") == -2 * k, F.col(f"chain{k}")) for k in range(n)))
    found = chains.where("best.shared >= 2")
    return found.select("record_id_a", "record_id_b", F.col("best.shared").alias("shared"), F.bit_count(chain).alias("seeds"), (-F.col("best.back") / 2).cast("int").alias("turn"), (F.col("best.shared") / F.lit(float(n))).alias("coverage"))
