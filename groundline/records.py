"""The four record tables in canonical form, from delivered tables."""
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import code, ident, strip
from .sources.tables import materialise, table


def _last(d: DataFrame, key: str, cols: dict) -> DataFrame:
    """One row per id, of its last delivery (null load times first; ties: the greatest content). Rows without id are left out."""
    s = F.struct(F.col("loaded_at"), *[c.alias(n) for n, c in cols.items()])
    return d.select(ident(key).alias(key), s.alias("s")).filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("s").alias("s")).select(key, *[F.col(f"s.{n}").alias(n) for n in cols])


@dataclass
class Records:
    """nodes, claims, evidence and unresolved of a folder of delivered tables, one row per id; lazily planned, so a query reads what it uses."""

    spark: object
    folder: str

    def written(self, *tables) -> "Records":
        """The same with the named tables written once, for plans that read them many times."""
        r = Records(self.spark, self.folder)
        r.__dict__.update({t: materialise(getattr(self, t)) for t in tables})
        return r

    @cached_property
    def nodes(self):
        return _last(table(self.spark, self.folder, "nodes"), "node_id", {"node_type": strip("node_type"), "name": strip("name"), "aliases": F.col("aliases"), "attributes": F.col("attributes")})

    @cached_property
    def claims(self):
        return _last(table(self.spark, self.folder, "claims"), "claim_id", {
            "subject": ident("subject"), "predicate": code("predicate"), "object": ident("object"), "assertion_kind": code("assertion_kind"), "review_status": code("review_status"),
            "evidence_ids": F.transform("evidence_ids", strip), "scope": F.col("scope"), "attributes": F.col("attributes"), "valid_from": strip("valid_from"), "valid_to": strip("valid_to")})

    @cached_property
    def evidence(self):
        return _last(table(self.spark, self.folder, "evidence"), "evidence_id", {
            c: strip(c) for c in ("source_type", "source_name", "revision", "path", "locator", "content_hash", "extractor", "environment", "attributes")})

    @cached_property
    def unresolved(self):
        return _last(table(self.spark, self.folder, "unresolved"), "unresolved_id", {
            "source_node_id": ident("source_node_id"), "reason": strip("reason"), "target_hint": strip("target_hint"), "evidence_ids": F.transform("evidence_ids", strip), "attributes": F.col("attributes")})
