"""Texts of varying length in containers of fixed capacity, by sum-of-squares packing.

Open containers are counted by residual gap. A text goes where the sum of squared counts becomes smallest:
into a container with some gap, or into a new one; of equals into the fullest. So no gap is left with many
containers that nothing fits. Long texts come first.

The rule looks at all open containers, so texts are dealt by hash of their id to shards, each packed on its own.
A shard is dealt SHARD_CONTAINERS containers' worth of tokens, or SHARD_TEXTS texts where these are less: its size is
bounded however many texts there are, and what its last open containers waste is a small share of it. A text of more tokens
than the capacity is cut into whole containers and a rest that is packed; no other is cut. A text without tokens goes to the first
container of its shard without passing through it. Null sizes count as none, repeated ids are packed once for each row, empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_CONTAINERS, SHARD_TEXTS = 4096, 200_000
_PIECES = "container_kind string, capacity_tokens int, container_id string, doc_id long, piece int, tokens long"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size (0 to ``capacity``), in the order given; what has no size goes to the first."""
    count = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, opened = np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        if size <= 0:
            opened = max(opened, 1)
            out[i] = -1
            continue
        rest = capacity - size
        best, gain = capacity, (0 if rest == 0 else 2 * int(count[rest]) + 1)
        held = count[size:capacity]
        if len(held):
            change = np.where(held > 0, 2 * (count[:rest] - held) + 2, np.iinfo(np.int64).max)
            if held[0] > 0:
                change[0] = 1 - 2 * held[0]
            j = int(change.argmin())
            if change[j] <= gain and held[j] > 0:
                best = size + j
        if best == capacity:
            bin_, opened = opened, opened + 1
        else:
            bin_ = waiting[best].pop()
            count[best] -= 1
        out[i] = bin_
        if gap := best - size:
            waiting[gap].append(bin_)
            count[gap] += 1
    out[out < 0] = 0
    return out


def packed(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, capacity_tokens, container_id, doc_id, piece and tokens for each piece of each text in each kind of container.

    ``sizes`` is (doc_id, tokens), ``containers`` (container_kind, capacity_tokens), a small fixed table.
    """
    total, texts = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count_if(F.col("tokens") > 0)).first()
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in containers.where("capacity_tokens > 0").distinct().orderBy("container_kind").collect()]
    if not kinds:
        return sizes.sparkSession.createDataFrame([], _PIECES)
    shards = {k: max(1, -(-total // (SHARD_CONTAINERS * c)), -(-texts // SHARD_TEXTS)) for k, c in kinds}
    known = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens"), F.lit(int(shards[k])).cast("long").alias("shards")) for k, c in kinds))
    each = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.inline(known))
    each = each.withColumns({"whole": F.when(F.col("tokens") > F.col("capacity_tokens"), F.floor((F.col("tokens") - 1) / F.col("capacity_tokens"))).otherwise(0), "shard": F.pmod(F.xxhash64("doc_id"), F.col("shards"))})
    full = each.where("whole > 0").select("container_kind", "capacity_tokens", "doc_id", F.posexplode(F.expr("sequence(1L, whole)")).alias("piece", "_"), F.col("capacity_tokens").cast("long").alias("tokens"))
    full = full.select("container_kind", "capacity_tokens", F.concat_ws("-", "container_kind", F.lit("text"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "tokens")
    rest = each.select("container_kind", "capacity_tokens", "shard", "doc_id", F.col("whole").cast("int").alias("piece"), (F.col("tokens") - F.col("whole") * F.col("capacity_tokens")).alias("tokens"))

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        bins = sum_of_squares(shard["tokens"].to_numpy(), int(shard["capacity_tokens"].iloc[0]))
        where = f"{shard['container_kind'].iloc[0]}-{shard['shard'].iloc[0]}-"
        return pd.DataFrame({"container_kind": shard["container_kind"], "capacity_tokens": shard["capacity_tokens"], "container_id": [where + str(b) for b in bins], "doc_id": shard["doc_id"], "piece": shard["piece"], "tokens": shard["tokens"]})

    empty = rest.where("tokens = 0").select("container_kind", "capacity_tokens", F.concat_ws("-", "container_kind", "shard", F.lit("0")).alias("container_id"), "doc_id", "piece", "tokens")
    return full.unionByName(empty).unionByName(rest.where("tokens > 0").groupBy("container_kind", "shard").applyInPandas(pack, _PIECES))


def fills(pieces: DataFrame) -> DataFrame:
    """Each container with its pieces, tokens and fill."""
    g = pieces.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return g.withColumn("fill", F.round(F.col("tokens") / F.col("capacity_tokens"), 6))

