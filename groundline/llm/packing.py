"""Problem 7: fixed-capacity containers by sum-of-squares packing."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 20000


def pack_block(sizes, capacity):
    """Bin number of each item (0 < size <= capacity), placed where the squared counts of open bins per gap become smallest."""
    count, bins, used, out = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0, []
    for s in sizes:
        gaps = np.flatnonzero(count[s:]) + s  # only gaps with open bins
        left = gaps - s
        cost = np.where(left > 0, 2 * count[left] + 1, 0) + 1 - 2 * count[gaps]
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        k = int(cost.argmin()) if len(gaps) else -1
        if k >= 0 and cost[k] <= fresh:
            g = int(gaps[k])
            b = bins[g].pop()
            count[g] -= 1
        else:
            g, b, used = capacity, used, used + 1
        out.append(b)
        if g - s > 0:
            count[g - s] += 1
            bins[g - s].append(b)
    return out


def pack(sizes: DataFrame, containers: DataFrame, blocks: int) -> DataFrame:
    """container_kind, container_id, doc_id, part_no, tokens. Documents over the capacity are split into full parts and a rest.

    A full part fills its container alone and is not packed, so only rests and whole documents come to a block. Documents
    without tokens need no room and stand in part 0 with no container. Blocks are hash ranges of the documents, BLOCK_ROWS on
    average, packed independently. A kind listed with several capacities is packed for each of them, with the capacity in the
    container's id; null kinds and capacities below 1 are left out.
    """
    listed = containers.select("container_kind", "capacity_tokens").filter("container_kind is not null and capacity_tokens > 0").distinct().collect()  # small and fixed
    if not listed:
        return sizes.sparkSession.createDataFrame([], "container_kind string, container_id string, doc_id bigint, part_no int, tokens bigint")
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(n).cast("bigint").alias("cap")) for k, n in listed])
    d = sizes.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).select("doc_id", "block", F.coalesce("tokens", F.lit(0)).alias("n"), F.explode(kinds).alias("c")).select("*", "c.*")
    d = d.withColumn("fulls", F.expr("n div cap").cast("int"))
    alone = d.filter("fulls > 0").select("container_kind", "cap", "doc_id", F.explode(F.sequence(F.lit(0), F.col("fulls") - 1)).alias("part_no")).select(
        "container_kind", F.concat_ws("-", "container_kind", "cap", F.lit("full"), "doc_id", "part_no").alias("container_id"), "doc_id", "part_no", F.col("cap").alias("tokens"))
    rest = d.withColumn("tokens", F.col("n") % F.col("cap")).filter("tokens > 0 or n = 0").select("container_kind", "cap", "block", "doc_id", F.col("fulls").alias("part_no"), "tokens")

    def run(key, d):
        d = d.sort_values(["doc_id", "part_no"])
        full = d.tokens > 0
        ids = pd.Series(None, index=d.index, dtype=object)
        ids[full] = [f"{key[0]}-{key[1]}-{key[2]}-{b}" for b in pack_block(d.tokens[full].tolist(), int(key[1]))]
        return pd.DataFrame({"container_kind": d.container_kind, "container_id": ids, "doc_id": d.doc_id, "part_no": d.part_no, "tokens": d.tokens})
    return alone.unionByName(rest.groupBy("container_kind", "cap", "block").applyInPandas(run, "container_kind string, container_id string, doc_id bigint, part_no int, tokens bigint"))
