"""Problem 1: parent-child links to full hierarchies by pointer doubling."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import accepted, code, ident
from ..sources.tables import discard, materialise
from .skew import ROWS_PER_SALT, salted_join


def _counting(claims: DataFrame) -> DataFrame:
    return (claims.filter((code("predicate") == "CONTAINS") & accepted())
            .select(ident("object").alias("child"), ident("subject").alias("parent")).filter("child is not null and parent is not null"))


def contains_edges(claims: DataFrame) -> DataFrame:
    """(child, parent) of the counting CONTAINS claims; null or blank ends give no edge. Of several parents the least counts."""
    return _counting(claims).groupBy("child").agg(F.min("parent").alias("parent"))


def second_parents(claims: DataFrame) -> DataFrame:
    """node_id, parent_id: the further containers of a node, which contains_edges does not follow."""
    d = _counting(claims)
    least = d.groupBy("child").agg(F.min("parent").alias("kept"), F.max("parent").alias("top")).filter("kept < top").select("child", "kept")
    return d.join(least, "child").filter("parent <> kept").select(F.col("child").alias("node_id"), F.col("parent").alias("parent_id")).distinct()


def hierarchy(edges: DataFrame, rows: int = ROWS_PER_SALT) -> DataFrame:
    """node_id, root_id, depth, path (array root..node), one row per end of an edge.

    A pointer is (node_id, anc, jump, seg): the ancestor jump levels up and the path segment from below it to the node; a
    root points to itself and is done. A round joins every open pointer with its ancestor's pointer: jumps add up, segments
    are put together, and a pointer to a done one is done. After round k all nodes of depth below 2^k are done; depths on a
    chain have no gaps, so a round that finishes nothing leaves only nodes on or below a loop: root_id CYCLE, depth -1, path
    null. A hot ancestor is salted. An empty input gives no rows; a child must have one parent (contains_edges sees to it).
    """
    ends = edges.select(F.col("child").alias("node_id")).union(edges.select("parent")).distinct()
    long = lambda x: F.lit(x).cast("bigint")
    done = [materialise(ends.join(edges, ends.node_id == edges.child, "left_anti").select(
        "node_id", F.col("node_id").alias("anc"), long(0).alias("jump"), F.array("node_id").alias("seg"), F.lit(True).alias("done")))]
    open_ = materialise(edges.select(F.col("child").alias("node_id"), F.col("parent").alias("anc"), long(1).alias("jump"),
                                     F.array("child").alias("seg"), F.lit(False).alias("done")))
    while True:
        pointers = reduce(DataFrame.union, [*done, open_]).select(
            F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("jump").alias("jump2"), F.col("seg").alias("seg2"), F.col("done").alias("done2"))
        new = materialise(salted_join(open_, pointers, ["anc"], "inner", "node_id", rows).select(
            "node_id", F.col("anc2").alias("anc"), (F.col("jump") + F.col("jump2")).alias("jump"), F.concat("seg2", "seg").alias("seg"), F.col("done2").alias("done")))
        if new.filter("done").isEmpty():
            break
        discard(open_)  # the first one only: later ones are parts of what was found
        done.append(new.filter("done"))
        open_ = new.filter("not done")
    discard(new)
    return reduce(DataFrame.union, done).select("node_id", F.col("anc").alias("root_id"), F.col("jump").alias("depth"), F.col("seg").alias("path")).union(
        open_.select("node_id", F.lit("CYCLE"), long(-1), F.lit(None).cast("array<string>")))


def descendants(h: DataFrame) -> DataFrame:
    """ancestor_id, node_id, distance: every node under every ancestor, from the paths."""
    return (h.filter("path is not null").select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
            .filter("pos < depth").select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance")))
