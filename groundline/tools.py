"""The seven read-only operations on a snapshot, with results as plain objects."""
import json

from pyspark.sql import functions as F

from .bundle import Bundle
from .operators import search
from .operators import traversal as t

ANSWERED, UNKNOWN = "ANSWERED", "UNKNOWN"
REASON = "Nothing accepted and evidenced was found. UNKNOWN means unproven in this snapshot, not that no relation exists."
NOTE = "Only accepted claims of this snapshot count; look at the unresolved boundaries before a change."


def plain(row) -> dict:
    d = row.asDict(recursive=True)
    return {k: json.loads(v or "{}") if k in ("attributes", "scope") else ([] if k in ("aliases", "evidence_ids") and v is None else v) for k, v in d.items()}


class Graph:
    """Questions to one snapshot. Traversals are capped, so their results are small; the snapshot itself stays distributed."""

    def __init__(self, bundle: Bundle):
        self.bundle, self.edges = bundle, t.lineage_edges(bundle.claims)

    def _envelope(self, found, **more) -> dict:
        return {"status": ANSWERED if found else UNKNOWN, "reason": None if found else REASON, "snapshot_id": self.bundle.snapshot_id} | more

    def _node(self, node_id) -> dict:
        return plain(self.bundle.nodes.filter(F.col("node_id") == node_id).first())

    def _boundaries(self, visited) -> list:
        return sorted((plain(r) for r in t.boundaries(self.bundle.unresolved, visited).collect()), key=lambda u: u["unresolved_id"])

    def health(self) -> dict:
        return self.bundle.doctor()

    def find(self, query: str, node_type: str | None = None, limit: int = 10) -> dict:
        rows = [plain(r) for r in search.find(self.bundle.nodes, query, node_type, limit).collect()]
        return self._envelope(rows, query=query.strip(), node_type=node_type, matches=rows)

    def _traversal(self, node_id, max_hops, upstream) -> dict:
        b = self.bundle
        t.check(b.nodes, node_id, max_hops=max_hops)
        found = t.traverse(self.edges, node_id, max_hops, upstream)
        order = lambda r: (r["hops"], *[x for p in zip((s["predicate"] for s in r["steps"]), r["node_ids"][1:], r["claim_ids"]) for x in p])
        paths = sorted((r.asDict(recursive=True) for r in t.packed_paths(found, b.claims).collect()), key=order)
        nodes = {r.node_id: plain(r) for r in found.select("node_id").join(b.nodes, "node_id").collect()}
        results = [nodes[p["node_id"]] | {"hops": p["hops"], "via_claim_id": p["claim_ids"][-1]} for p in paths if p["node_id"] in nodes]
        visited = found.select("node_id").union(b.spark.createDataFrame([(node_id,)], "node_id string"))
        return self._envelope(paths, direction="upstream" if upstream else "downstream", origin=self._node(node_id), max_hops=max_hops, results=results,
                              paths=[{k: v for k, v in p.items() if k != "node_id"} for p in paths], unresolved_boundaries=self._boundaries(visited))

    def upstream(self, node_id: str, max_hops: int = 6) -> dict:
        return self._traversal(node_id, max_hops, True)

    def downstream(self, node_id: str, max_hops: int = 6) -> dict:
        return self._traversal(node_id, max_hops, False)

    def path(self, source_node_id: str, target_node_id: str, max_hops: int = 8, max_paths: int = t.PATH_CAP) -> dict:
        """Shortest paths down the flow. From a node to itself there is one of no hops, and max_hops is not echoed."""
        t.check(self.bundle.nodes, source_node_id, target_node_id, max_hops=max_hops)
        p, seen = t.shortest_paths(self.edges, source_node_id, target_node_id, max_hops, max_paths)
        ends = {"source": self._node(source_node_id), "target": self._node(target_node_id), "unresolved_boundaries": self._boundaries(seen)}
        if source_node_id == target_node_id:
            return self._envelope(True, paths=[{"hops": 0, "node_ids": [source_node_id], "claim_ids": [], "evidence_ids": [], "steps": []}], **ends)
        rows = t.packed_paths(p.withColumn("node_id", F.array_join("path_claims", " ")), self.bundle.claims).drop("node_id").collect()
        order = lambda r: [x for s, n, c in zip(r["steps"], r["node_ids"][1:], r["claim_ids"]) for x in (s["predicate"], n, c)]
        rows = sorted((r.asDict(recursive=True) for r in rows), key=order)
        return self._envelope(rows, max_hops=max_hops, paths=rows, **ends)

    def impact(self, node_id: str, change_type: str = "unspecified", max_hops: int = 6) -> dict:
        r = self.downstream(node_id, max_hops)
        direct, kinds = sum(n["hops"] == 1 for n in r["results"]), [n["node_type"] for n in r["results"]]
        return r | {"change_type": change_type, "interpretation": NOTE,
                    "impact_summary": {"direct": direct, "transitive": len(kinds) - direct, "total": len(kinds), "by_node_type": {k: kinds.count(k) for k in sorted(set(kinds))}}}

    def claim_evidence(self, claim_id: str) -> dict:
        """The evidence of a claim, accepted or not, in the claim's order; what is missing is skipped."""
        claim = self.bundle.claims.filter(F.col("claim_id") == claim_id).first()
        if claim is None:
            return self._envelope([], claim_id=claim_id, evidence=[])
        c = plain(claim)
        there = {r.evidence_id: plain(r) for r in self.bundle.evidence.filter(F.col("evidence_id").isin(c["evidence_ids"])).collect()}
        rows = [there[e] for e in c["evidence_ids"] if e in there]
        return self._envelope(rows, claim=c, evidence=rows)


#: The names under which the operations are served, and the arguments each takes with their kinds and defaults.
TOOLS = {
    "graph_health": (Graph.health, {}),
    "find_entity": (Graph.find, {"query": (str, ""), "node_type": (str, None), "limit": (int, 10)}),
    "get_upstream": (Graph.upstream, {"node_id": (str, ""), "max_hops": (int, 6)}),
    "get_downstream": (Graph.downstream, {"node_id": (str, ""), "max_hops": (int, 6)}),
    "find_dependency_path": (Graph.path, {"source_node_id": (str, ""), "target_node_id": (str, ""), "max_hops": (int, 8)}),
    "assess_change_impact": (Graph.impact, {"node_id": (str, ""), "change_type": (str, "unspecified"), "max_hops": (int, 6)}),
    "get_claim_evidence": (Graph.claim_evidence, {"claim_id": (str, "")}),
}


def call(graph: Graph, tool: str, arguments: dict) -> dict:
    """Runs one operation by name; absent arguments get their defaults, unknown ones raise ValueError."""
    if tool not in TOOLS:
        raise ValueError(f"there is no tool {tool!r}")
    run, takes = TOOLS[tool]
    if unknown := sorted(set(arguments) - set(takes)):
        raise ValueError(f"{tool} takes no " + ", ".join(unknown))
    given = {k: arguments.get(k, default) for k, (_, default) in takes.items()}
    return run(graph, **{k: v if v is None else takes[k][0](v) for k, v in given.items()})
