"""Records that belong together: components by hooking and shortcutting, and splits that keep them whole.

Edges join nodes. In each round every node hooks to its smallest neighbour if that is smaller, and the
parent array is shortcut, parent to parent's parent, twice a step, until all point at roots. Edges are then drawn
between roots only, which leaves few, and the next round runs on those. All of it is joins of tables
that are written between rounds; the driver sees counts, which are taken while the tables are written.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import cut, written


def _written(df: DataFrame, changed: Column) -> tuple[DataFrame, int]:
    """``df`` cut, and how many of its rows are ``changed``, counted as they are written."""
    seen = Observation()
    return cut(df.observe(seen, F.count_if(changed).alias("n"))), int(seen.get.get("n") or 0)


def _shortcut(edges: DataFrame) -> DataFrame:
    """(node, parent): every node of ``edges`` hooked to its smallest neighbour, and parents shortcut to roots."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).union(edges.select("v", "u"))
    hooked = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent"))
    parents, deep = _written(hooked, F.col("parent") < F.col("node"))
    while deep:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        top = parents.select(F.col("node").alias("above"), F.col("parent").alias("top"))
        jumped = parents.join(up, "parent").join(top, "above").select("node", F.col("top").alias("parent"), (F.col("top") < F.col("parent")).alias("moved"))
        parents, deep = _written(jumped, F.col("moved"))
        parents = parents.drop("moved")
    return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): the smallest node of its component.

    Nulls join nothing, loops join a node to itself, repeated edges count once, and an empty table gives an empty one.
    """
    edges, left = _written(edges.where("u is not null and v is not null").select("u", "v").distinct(), F.lit(True))
    labels = None
    while labels is None or left:
        parents = _shortcut(edges)
        if labels is None:
            labels = parents.withColumnRenamed("parent", "root")
        else:
            labels = cut(labels.join(parents.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        a = parents.select(F.col("node").alias("u"), F.col("parent").alias("a"))
        b = parents.select(F.col("node").alias("v"), F.col("parent").alias("b"))
        edges, left = _written(edges.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), F.lit(True))
    return labels


def grouped(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """(row_id, group_id) of every row: group_id is the smallest row_id among rows linked, directly or through others, by equal keys.

    A null key links nothing. Of each key only its smallest row becomes a node, so hot keys are one edge, not a clique.
    """
    node = written(rows.select(F.col(row_id).cast("long").alias("row_id"), *keys), "keys")
    for i, k in enumerate(keys):
        firsts = node.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("row_id").alias(f"m{i}"))
        node = node.join(firsts, k, "left")
    node = written(node.select("row_id", *(f"m{i}" for i in range(len(keys)))), "firsts")
    home = F.coalesce(*(F.col(f"m{i}") for i in range(len(keys))), F.col("row_id"))
    node = node.withColumn("home", home)
    links = None
    for i in range(len(keys)):
        e = node.where(f"m{i} is not null and m{i} <> home").select(F.col("home").alias("u"), F.col(f"m{i}").alias("v")).distinct()
        links = e if links is None else links.union(e)
    roots = components(links).withColumnRenamed("node", "home")
    return node.join(roots, "home", "left").select("row_id", F.coalesce("root", "home").alias("group_id"))


def _greedy(counts: dict[int, int], target: int) -> dict[int, int]:
    """Largest sizes first, each as often as it fits."""
    take = {}
    for size in sorted(counts, reverse=True):
        take[size] = min(counts[size], target // size)
        target -= take[size] * size
    return take


def _chosen(parts: list[tuple[int, int]], start: int, total: int, limit: int) -> list[int]:
    """Which of the parts (size, copies), added to a sum in ``start``, make ``total``: halves one after the other, so that
    few bitsets are held at once, however many parts there are."""
    if not parts:
        return []
    if len(parts) == 1:
        return [0 if start >> total & 1 else 1]
    half, reach = len(parts) // 2, start
    for size, k in parts[:half]:
        reach |= reach << size * k & limit
    after = _chosen(parts[half:], reach, total, limit)
    return _chosen(parts[:half], start, total - sum(size * k for (size, k), used in zip(parts[half:], after, strict=True) if used), limit) + after


def closest_subset(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size make a total closest to ``target``; the lesser of two equally near totals wins.

    Taking the largest sizes first often meets the target, and then nothing can be nearer. Otherwise a bitset of reachable sums
    up to twice the target, in which a multiplicity is a few powers of two, finds the nearest total, whatever the sizes.
    """
    target = max(0, target)
    take = _greedy(counts, target)
    if sum(s * n for s, n in take.items()) == target:
        return take
    unit = math.gcd(*counts) if counts else 1
    parts = []
    for size in sorted(counts):
        n, k = min(counts[size], 2 * target // size + 1), 1
        while n > 0:
            parts.append((size // unit, min(k, n)))
            n, k = n - k, 2 * k
    limit = (1 << (2 * target // unit + 2)) - 1
    reach = 1
    for size, k in parts:
        reach |= reach << size * k & limit
    low = (reach & (1 << (target // unit + 1)) - 1).bit_length() - 1
    above = reach >> target // unit + 1
    high = target // unit + 1 + (above & -above).bit_length() - 1 if above else None
    total = high if high is not None and high * unit - target < target - low * unit else low
    out = dict.fromkeys(counts, 0)
    for (size, k), used in zip(parts, _chosen(parts, 1, total, limit), strict=True):
        out[size * unit] += used * k
    return out


def split_quotas(counts: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """For each split, how many groups of each size. Splits but the one with the largest share are closed one after the other, in the order that
    leaves the least distance in all; that one takes what is left."""
    total, main = sum(s * n for s, n in counts.items()), max(shares, key=shares.get)
    best, least = {}, None
    for order in permutations(sorted((s for s in shares if s != main), key=lambda s: (shares[s], s))):
        rest, out = dict(counts), {}
        for name in order:
            out[name] = closest_subset(rest, round(total * shares[name]))
            rest = {s: n - out[name][s] for s, n in rest.items()}
        out[main] = rest
        off = sum(abs(sum(s * n for s, n in out[k].items()) - total * shares[k]) for k in shares)
        if least is None or off < least:
            best, least = out, off
        if off < len(shares):
            break  # nothing is off by a row: no order is nearer by more than rounding
    return best


def assigned(groups: DataFrame, shares: dict[str, float], per_bucket: int = 50_000) -> DataFrame:
    """(group_id, split) with split totals of rows as near to ``shares`` as whole groups allow.

    ``groups`` is (row_id, group_id). The driver gets the number of groups of each size: at most sqrt(2 rows)
    numbers. Groups of one size are ranked by hash bucket of about ``per_bucket`` groups, then within it, so that no task holds all of them.
    """
    sizes = cut(groups.groupBy("group_id").agg(F.count("*").alias("size")))
    counts = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    buckets = 1 + sum(counts.values()) // per_bucket
    quotas = split_quotas(counts, shares)
    names = [n for n in quotas if n != max(shares, key=shares.get)]
    rows = [(s, *(quotas[n][s] for n in names)) for s in counts]
    quota = groups.sparkSession.createDataFrame(rows, "size long, " + ", ".join(f"q{i} long" for i in range(len(names))))
    marked = sizes.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    starts = marked.groupBy("size", "bucket").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    rank = F.row_number().over(W.partitionBy("size", "bucket").orderBy("group_id")) + F.coalesce("start", F.lit(0))
    ranked = marked.join(starts.drop("n"), ["size", "bucket"]).withColumn("rank", rank).join(quota, "size")
    split, upto = F.lit(max(shares, key=shares.get)), F.lit(0)
    bounds = []
    for i, n in enumerate(names):
        bounds.append((n, upto, upto + F.col(f"q{i}")))
        upto = upto + F.col(f"q{i}")
    for n, low, high in bounds:
        split = F.when((F.col("rank") > low) & (F.col("rank") <= high), n).otherwise(split)
    return ranked.select("group_id", "size", split.alias("split"))
