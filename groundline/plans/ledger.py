"""Candidate ledgers from an extractor's graph document: never accepted, kept apart from snapshots."""
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import file_hash
from ..functions.canonical import dumps
from ..sources import jsonl
from ..sources.jsonl import BundleError

SCHEMA, ADAPTER = "groundline.candidate-ledger/v1", "1"
# Relations that may become claims, and the predicate each proposes.
PROPOSED = {"calls": "INVOKES", "contains": "CONTAINS", "depends_on": "REQUIRES", "imports": "REQUIRES", "reads_from": "READS_FROM", "writes_to": "WRITES_TO"}
TABLES = {"nodes": ("candidate-nodes", "candidate_id"), "claims": ("candidate-claims", "candidate_claim_id"), "evidence": ("candidate-evidence", "evidence_id"), "unresolved": ("unresolved", "candidate_id")}


def candidate_id(repository: str, revision: str, raw):
    """candidate:extractor: and the SHA-256 of repository, revision and the extractor's id, joined by NUL."""
    return F.concat(F.lit("candidate:extractor:"), F.sha2(F.concat_ws("\0", F.lit(repository), F.lit(revision), raw), 256))


def proposed(relation):
    """The predicate that a raw relation proposes; null if it proposes none."""
    return F.create_map(*[F.lit(x) for kv in PROPOSED.items() for x in kv])[F.lower(relation)]


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id: ends of edges (source, target) that are no id of nodes, each once."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).filter("id is not null").distinct()
    return ends.join(nodes.select("id").distinct(), "id", "left_anti")


def candidate_nodes(nodes: DataFrame, edges: DataFrame, repository: str, revision: str) -> DataFrame:
    """candidate_id, extractor_id, label, raw_type, source_file, source_locator, resolution_status of the nodes and of dangling ends."""
    none = F.lit(None).cast("string")
    located = F.when(F.coalesce("source_file", F.lit("")) == "", None).otherwise(F.replace("source_file", F.lit("\\"), F.lit("/")))
    d = nodes.select("id", F.coalesce(F.when(F.col("label") != "", F.col("label")), "id").alias("label"), F.coalesce(F.when(F.col("file_type") != "", F.col("file_type")), F.lit("unknown")).alias("raw_type"),
                     located.alias("source_file"), F.col("source_location").alias("source_locator"), F.lit(False).alias("added"))
    d = d.unionByName(dangling(edges, nodes).select("id", F.col("id").alias("label"), F.lit("unknown").alias("raw_type"), none.alias("source_file"), none.alias("source_locator"), F.lit(True).alias("added")))
    return d.select(candidate_id(repository, revision, F.col("id")).alias("candidate_id"), F.col("id").alias("extractor_id"), "label", "raw_type", "source_file", "source_locator",
                    F.when(F.col("source_file").isNull(), "UNRESOLVED").otherwise("SOURCE_LOCATED").alias("resolution_status"), "added")


def candidate_claims(edges: DataFrame, evidence_id, repository: str, revision: str) -> DataFrame:
    """The claims that edges (source, target, relation, confidence) propose; all are CANDIDATE. Eligible are those with predicate and evidence."""
    raw = F.lower(F.coalesce(F.when(F.col("relation") != "", F.col("relation")), F.lit("unknown")))
    return edges.select(candidate_id(repository, revision, F.col("source")).alias("subject_candidate_id"), candidate_id(repository, revision, F.col("target")).alias("object_candidate_id"), raw.alias("raw_relation"),
                        proposed(raw).alias("proposed_predicate"), F.lit("CANDIDATE").alias("review_status"),
                        F.upper(F.coalesce(F.when(F.col("confidence") != "", F.col("confidence")), F.lit("UNKNOWN"))).alias("assertion_kind"),
                        F.array_compact(F.array(evidence_id)).alias("evidence_ids"), (proposed(raw).isNotNull() & evidence_id.isNotNull()).alias("promotion_eligible"))


def _read(spark, graph: dict) -> tuple:
    parts = {}
    for k, fields in (("nodes", "id label file_type source_file source_location"), ("edges", "source target relation confidence source_file source_location")):
        if not isinstance(graph.get(k), list):
            raise BundleError(f"the graph must hold a list of {k}")
        d = jsonl.from_rows(spark, graph[k], k)
        kinds = {f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")) for f in ("id", "source", "target")}
        need = ["id"] if k == "nodes" else ["source", "target"]
        d = d.select(*[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in fields.split()], *[(F.coalesce(kinds[f] == "STRING", F.lit(False))).alias(f"_{f}") for f in need])
        for f in need:
            if not d.filter(~F.col(f"_{f}") | (F.col(f) == "")).isEmpty():
                raise BundleError(f"every one of the {k} needs a text as {f}")
        parts[k] = d.drop(*[f"_{f}" for f in need])
    return parts["nodes"], parts["edges"]


def adapt(spark, graph: dict, repository: str, revision: str, root, version: str) -> dict:
    """The ledger of a graph document as four tables and its head. Token counts must be 0, the revision a full commit id, files below root."""
    if not repository.strip():
        raise BundleError("the repository is required")
    if len(revision) != 40 or set(revision) - set("0123456789abcdef"):
        raise BundleError("the revision must be 40 lower-case hex digits")
    if graph.get("input_tokens", 0) or graph.get("output_tokens", 0):
        raise BundleError("a ledger of code must not come from a language model")
    nodes, edges = _read(spark, graph)
    if twice := nodes.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise BundleError(f"the node {twice[0].id} is there twice")
    root, files = Path(root).resolve(), {}
    for r in edges.select("source_file").union(nodes.select("source_file")).filter("source_file <> ''").distinct().toLocalIterator():
        p = r[0].replace("\\", "/")
        if p.startswith("/") or ".." in p.split("/"):
            raise BundleError(f"the source file {r[0]!r} must stay in the repository")
    for r in edges.select("source_file").filter("source_file <> ''").distinct().toLocalIterator():
        p = r[0].replace("\\", "/")
        if not (root / p).resolve().is_relative_to(root) or not (root / p).is_file():
            raise BundleError(f"there is no source file {p}")
        files[r[0]] = (p, "sha256:" + file_hash(root / p))
    known = spark.createDataFrame([(k, *v) for k, v in files.items()], "source_file string, path string, content_hash string")
    e = edges.join(F.broadcast(known), "source_file", "left")
    fields = {"content_hash": F.col("content_hash"), "extractor": F.lit(f"extractor/{version}"), "locator": F.coalesce(F.when(F.col("source_location") != "", F.col("source_location")), F.lit("UNKNOWN")),
              "path": F.col("path"), "repository": F.lit(repository), "revision": F.lit(revision)}
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    e = e.withColumns({**{f"_{k}": c for k, c in fields.items()}, "evidence_id": F.when(F.col("path").isNotNull(), F.concat(F.lit("candidate-evidence:"), F.sha2(body, 256)))})
    evidence = e.filter("evidence_id is not null").select("evidence_id", *[F.col(f"_{k}").alias(k) for k in fields]).dropDuplicates(["evidence_id"])
    claims = candidate_claims(e, F.col("evidence_id"), repository, revision)
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(claims.columns)]), {"ignoreNullFields": "false"})
    claims = claims.withColumn("candidate_claim_id", F.concat(F.lit("candidate-claim:"), F.sha2(text, 256)))
    n = candidate_nodes(nodes, edges, repository, revision)
    unresolved = n.filter("source_file is null").select("candidate_id", F.when(F.col("added"), "DANGLING_EXTRACTOR_ENDPOINT").otherwise("NO_SOURCE_LOCATION").alias("reason"))
    return {"nodes": n.drop("added"), "claims": claims, "evidence": evidence, "unresolved": unresolved,
            "head": {"schema_version": SCHEMA, "adapter_version": ADAPTER, "extractor": "graph-document", "extractor_version": version, "repository": repository, "revision": revision}}


def write(ledger: dict, out) -> dict:
    """Writes the four tables in order of their ids and the manifest into an empty folder; the manifest."""
    out = Path(out).resolve()
    if out.exists() and any(out.iterdir()):
        raise FileExistsError(f"{out} is not empty")
    out.mkdir(parents=True, exist_ok=True)
    files, counts, whole = {}, {}, hashlib.sha256()
    for k, (name, key) in TABLES.items():
        h, counts[k] = hashlib.sha256(), 0
        with open(out / f"{name}.jsonl", "wb") as f:
            for r in jsonl.lines(ledger[k].orderBy(*sorted({key, *ledger[k].columns} - {"evidence_ids"}, key=lambda c: (c != key, c)))).toLocalIterator():
                f.write(line := (r.line + "\n").encode())
                h.update(line)
                counts[k] += 1
        files[f"{name}.jsonl"] = "sha256:" + h.hexdigest()
        whole.update(h.digest())
    m = ledger["head"] | {"candidate_digest": "sha256:" + whole.hexdigest(), "counts": counts, "accepted_claim_count": 0, "files": files}
    (out / "manifest.json").write_text(dumps(m) + "\n", encoding="utf-8")
    return m


def load_graph(path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
