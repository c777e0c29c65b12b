"""Expressions for showing a snapshot to people: groups, short labels, what a search marks, and the line of figures."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import accepted

# Lengths of labels, and how many boundaries are shown at once.
NAME, BOUNDARY, SHOWN = 26, 92, 200


def group_of(node_type):
    """Data, Contract or Resource, from words in the type."""
    return F.when(node_type.rlike("(?i)dataset|column|table|view"), "Data").when(node_type.rlike("(?i)contract|marker|invariant|sla"), "Contract").otherwise("Resource")


def short(text, most: int):
    """The text, or its beginning and an ellipsis: three characters less than `most` are kept of longer ones."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)


def marked_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name, type or an alias contains the query, without regard to case; an empty query marks all."""
    return nodes.filter(F.contains(F.lower(F.concat_ws(" ", "name", "node_type", "aliases")), F.lit(query.strip().lower())))


def marked_claims(claims: DataFrame, query: str) -> DataFrame:
    return claims.filter(F.contains(F.lower(F.concat_ws(" ", "predicate", "subject", "object")), F.lit(query.strip().lower())))


def shown_boundaries(unresolved: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first boundaries by id, with a label; how many there are stands in figures()."""
    label = short(F.concat_ws(": ", "reason", "target_hint"), BOUNDARY)
    return unresolved.orderBy("unresolved_id").limit(most).select("unresolved_id", label.alias("label"))


def figures(r) -> DataFrame:
    """One row: nodes, accepted, candidates (claims not accepted), evidence and boundaries."""
    c = r.claims.agg(F.count_if(F.coalesce(accepted(), F.lit(False))).alias("accepted"), F.count_if(~F.coalesce(accepted(), F.lit(False))).alias("candidates"))
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return c.crossJoin(F.broadcast(one(r.nodes, "nodes"))).crossJoin(F.broadcast(one(r.evidence, "evidence"))).crossJoin(F.broadcast(one(r.unresolved, "boundaries")))
