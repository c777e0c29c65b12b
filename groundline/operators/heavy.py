"""Problem 3: per-key results under heavy keys, by eager aggregation through joins."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident
from ..sources.tables import materialise


def distinct_claims(claims: DataFrame) -> DataFrame:
    """claim_id, subject, object, refs (its number of evidence ids): one row per claim id; rows without id are dropped."""
    return (claims.select(ident("claim_id").alias("claim_id"), ident("subject").alias("subject"), ident("object").alias("object"),
                          F.coalesce(F.size("evidence_ids"), F.lit(0)).cast("bigint").alias("refs"))
            .filter("claim_id is not null").groupBy("claim_id").agg(F.min("subject").alias("subject"), F.min("object").alias("object"), F.max("refs").alias("refs")))


def node_types(nodes: DataFrame) -> DataFrame:
    """node_id, node_type of the last delivered row (ties: the greater type)."""
    return (nodes.select(ident("node_id").alias("node_id"), F.struct("loaded_at", "node_type").alias("s")).filter("node_id is not null")
            .groupBy("node_id").agg(F.max("s").alias("s")).select("node_id", F.col("s.node_type").alias("node_type")))


def node_results(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, node_type, n_subject, n_object, refs_subject, refs_object, n_two_hop, refs_two_hop.

    The result of joining claims to claims on object = subject and to nodes on the key, aggregated per node, without that
    join: each input is first reduced to one state per key and side (map-side partial sums take the skew), the states are
    joined, the number of claim pairs is the product of the counts, and their evidence references are n_subject *
    refs_object + n_object * refs_subject. A null end has its row under a null node_id; nodes without claims have none.
    """
    sides = distinct_claims(claims).select("refs", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("subject").alias("node_id")),
                                                                     F.struct(F.lit("o").alias("side"), F.col("object").alias("node_id")))).alias("x")).select("refs", "x.*")
    states = sides.groupBy("side", "node_id").agg(F.count("*").alias("n"), F.sum("refs").alias("refs"))
    out = states.filter("side = 's'").select("node_id", F.col("n").alias("n_subject"), F.col("refs").alias("refs_subject"))
    into = states.filter("side = 'o'").select(F.col("node_id").alias("o_id"), F.col("n").alias("n_object"), F.col("refs").alias("refs_object"))
    j = out.join(into, F.col("node_id").eqNullSafe(F.col("o_id")), "full_outer").withColumn("node_id", F.coalesce("node_id", "o_id")).drop("o_id")
    j = j.na.fill(0, ["n_subject", "n_object", "refs_subject", "refs_object"]).join(node_types(nodes), "node_id", "left")
    named = lambda c: F.when(F.col("node_id").isNotNull(), c).otherwise(F.lit(0).cast("bigint"))
    return j.select("node_id", "node_type", "n_subject", "n_object", "refs_subject", "refs_object",
                    named(F.col("n_subject") * F.col("n_object")).alias("n_two_hop"),
                    named(F.col("n_subject") * F.col("refs_object") + F.col("n_object") * F.col("refs_subject")).alias("refs_two_hop"))


def roll_up(results: DataFrame) -> DataFrame:
    """node_type, is_total, n_nodes and the sums of node_results, by type and over all (is_total 1, node_type null)."""
    sums = [F.sum(c).alias(c) for c in ("n_subject", "n_object", "refs_subject", "refs_object", "n_two_hop", "refs_two_hop")]
    return results.rollup("node_type").agg(F.grouping("node_type").cast("int").alias("is_total"), F.count("node_id").alias("n_nodes"), *sums)


def heavy_nodes(claims: DataFrame, nodes: DataFrame, share: float = 0.02) -> DataFrame:
    """side, node_id of nodes standing there in at least `share` of all distinct claims (the total of the roll-up, one row)."""
    results = materialise(node_results(claims, nodes))
    total = F.broadcast(roll_up(results).filter("is_total = 1").select(F.col("n_subject").alias("total")))
    d = results.filter("node_id is not null").select("node_id", F.explode(F.create_map(F.lit("subject"), F.col("n_subject"), F.lit("object"), F.col("n_object"))).alias("side", "n"))
    return d.join(total, (F.col("n") > 0) & (F.col("n") >= share * F.col("total"))).select("side", "node_id")
