"""Problem 5: changes between full snapshots by Merkle digests over hash ranges."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code, ident, strip
from ..sources.tables import materialise

FAN_BITS, LEAF_ROWS = 4, 256


def _json(c):
    s = strip(c)
    v = F.try_parse_json(s)
    return F.coalesce(F.to_json(v), s)


def _ser(*cols):
    return F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"})


def rows_of(nodes: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """table_name, snapshot_id, record_id, at, body: a digest of the compared content, in one writing."""
    parts = [
        ("nodes", nodes, "node_id", _ser(code("node_type"), F.col("name"), F.array_sort(F.array_distinct("aliases")), _json("attributes"))),
        ("claims", claims, "claim_id", _ser(ident("subject"), code("predicate"), ident("object"), code("assertion_kind"), code("review_status"),
                                            F.transform("evidence_ids", strip))),
        ("evidence", evidence, "evidence_id", _ser(strip("revision"), F.regexp_replace(F.lower(strip("content_hash")), "^sha256:", ""))),
    ]
    return reduce(DataFrame.union, [d.select(F.lit(t).alias("table_name"), ident("snapshot_id").alias("snapshot_id"), ident(k).alias("record_id"),
                                             F.col("delivered_at").alias("at"), F.sha2(b, 256).alias("body")) for t, d, k, b in parts])


def current_rows(rows: DataFrame, manifest: DataFrame) -> tuple:
    """One row per (table, snapshot, record), written once: table_name, i (place of the snapshot by seq), record_id, body, hash; and the names by place.

    The last delivery counts (ties: the greater content). Null ids and snapshots unknown to the manifest, which is small and
    fixed, are left out.
    """
    names = [r.snapshot_id for r in manifest.select(ident("snapshot_id").alias("snapshot_id"), "seq").filter("snapshot_id is not null").groupBy("snapshot_id").agg(F.min("seq").alias("seq"))
             .orderBy("seq", "snapshot_id").collect()]
    seqs = F.broadcast(rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(names)], "snapshot_id string, i int"))
    last = rows.select("table_name", "snapshot_id", "record_id", "at", "body").filter("record_id is not null").join(seqs, "snapshot_id").groupBy("table_name", "i", "record_id").agg(F.max(F.struct("at", "body")).alias("m"))
    return materialise(last.select("table_name", "i", "record_id", F.col("m.body").alias("body"), F.xxhash64("record_id").alias("hash"))), names


def leaf_bits(n_rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Bits of the hash ranges so that a leaf holds some leaf_rows rows, in whole steps of FAN_BITS."""
    bits = 0
    while bits < 48 and (n_rows >> bits) > leaf_rows:
        bits += FAN_BITS
    return bits


def digests(last: DataFrame, bits: int) -> DataFrame:
    """table_name, i, leaf, d1, d2: per snapshot and hash range the digests of its rows. Two sums of hashes, so order does not count."""
    leaf = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("bigint")
    return last.groupBy("table_name", "i", leaf.alias("leaf")).agg(F.bit_xor(F.xxhash64("record_id", "body")).alias("d1"), F.bit_xor(F.xxhash64("body", "record_id", F.lit(7))).alias("d2"))


def differing_leaves(leaves: DataFrame, n_snapshots: int, bits: int) -> DataFrame:
    """table_name, i (the later snapshot of a step), leaf: top-down, from one digest per snapshot to the leaves below those that differ."""
    steps = F.explode(F.filter(F.array(F.struct(F.col("i").alias("step"), F.lit(1).alias("new")), F.struct((F.col("i") + 1).alias("step"), F.lit(0).alias("new"))),
                               lambda x: x["step"].between(1, n_snapshots - 1)))
    sides = leaves.select("table_name", "leaf", "d1", "d2", steps.alias("x")).select("table_name", "leaf", "d1", "d2", "x.*")
    differ = None
    for b in range(0, bits + 1, FAN_BITS):
        level = sides.withColumn("at", F.shiftright("leaf", bits - b))
        if differ is not None:
            level = level.withColumn("up", F.shiftright("at", FAN_BITS)).join(F.broadcast(differ) if b == FAN_BITS else differ, ["table_name", "step", "up"], "left_semi")
        side = lambda new, c: F.bit_xor(F.when(F.col("new") == new, F.xxhash64("leaf", c)))
        g = level.groupBy("table_name", "step", "at").agg(*[side(k, c).alias(f"{c}_{k}") for k in (0, 1) for c in ("d1", "d2")])
        differ = g.filter("not (d1_0 <=> d1_1 and d2_0 <=> d2_1)").select("table_name", "step", F.col("at").alias("up"))
    return differ.select("table_name", F.col("step").alias("i"), F.col("up").alias("leaf"))


def snapshot_changes(rows: DataFrame, manifest: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """table_name, record_id, from_snapshot, to_snapshot, change_kind.

    Rows are diffed only in hash ranges whose digests differ; the number of ranges follows the number of rows, so a leaf stays
    as small at any size. The digests are computed once per snapshot and stand for it on both of its steps. Fewer than two
    snapshots, or empty ones, give no rows.
    """
    last, names = current_rows(rows, manifest)
    bits = leaf_bits(last.count() // max(1, len(names)), leaf_rows)
    leaves = materialise(digests(last, bits))
    near = materialise(differing_leaves(leaves, len(names), bits))
    leaf = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("bigint")
    side = last.withColumn("leaf", leaf)
    new = side.join(near, ["table_name", "i", "leaf"], "left_semi").select("table_name", "record_id", "i", F.lit(1).alias("new"), "body")
    old = side.withColumn("i", F.col("i") + 1).join(near, ["table_name", "i", "leaf"], "left_semi").select("table_name", "record_id", "i", F.lit(0).alias("new"), "body")
    body = lambda k: F.max(F.when(F.col("new") == k, F.col("body")))
    d = new.union(old).groupBy("table_name", "record_id", "i").agg(body(0).alias("a"), body(1).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    at = lambda i: F.element_at(F.array(*map(F.lit, names)) if names else F.array(F.lit("")), i)
    return d.filter("not (a <=> b)").select("table_name", "record_id", at(F.col("i")).alias("from_snapshot"), at(F.col("i") + 1).alias("to_snapshot"), kind.alias("change_kind"))
