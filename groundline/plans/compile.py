"""From a reviewed specification and its evidence files to a snapshot."""
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import Bundle, is_pinned
from ..functions.canonical import dumps, stable_id, with_defaults, with_overrides
from ..sources import jsonl
from ..sources.files import document, evidence_files, locator_valid
from ..sources.jsonl import BundleError
from ..sources.tables import materialise
from . import gates

EXTRACTOR = "groundline build"


def vocabularies(spec: dict, base: Path) -> tuple:
    """(entity types, relations, summary) of the two documents a specification names; any fault raises."""
    named = spec.get("ontology")
    if not isinstance(named, dict):
        raise BundleError("the specification must name its entities and relations documents")
    docs, hashes = {}, {}
    for k in ("entities", "relations"):
        rel = named.get(k)
        if not isinstance(rel, str) or not rel.strip() or Path(rel).is_absolute() or not (base / rel).is_file():
            raise BundleError(f"the ontology's {k} must be a relative path to a document")
        docs[k] = document(base / rel)
        raw = (base / rel).read_bytes()
        hashes[f"{k}_sha256"] = "sha256:" + hashlib.sha256(raw if b"\0" in raw else raw.replace(b"\r\n", b"\n")).hexdigest()
    types, relations = docs["entities"].get("entity_types"), docs["relations"].get("relations")
    if not isinstance(types, dict) or not types or not isinstance(relations, dict) or not relations:
        raise BundleError("entity_types and relations must be objects that are not empty")
    for n, t in types.items():
        if not isinstance(t, dict) or not isinstance(t.get("identity"), list) or not t["identity"]:
            raise BundleError(f"the entity type {n} must name the fields of its identity")
    out = {}
    for n, r in relations.items():
        direction = str(r.get("dependency_direction", "")).lower() if isinstance(r, dict) else ""
        if direction not in (gates.FORWARD, gates.BACK):
            raise BundleError(f"the relation {n} has no valid dependency_direction")
        if not isinstance(r.get("include_in_lineage"), bool):
            raise BundleError(f"the relation {n} must say whether it is in lineage")
        out[str(n).upper()] = (r.get("category"), direction, r["include_in_lineage"])
    same = [tuple(str(docs[k].get(f) or "").strip() for k in docs) for f in ("name", "version")]
    if any(not a or a != b for a, b in same):
        raise BundleError("both vocabularies must have the same name and version")
    return {str(n): [str(f) for f in t["identity"]] for n, t in types.items()}, out, {"name": same[0][0], "version": same[1][0], **hashes}


def project(spec: dict) -> tuple:
    p = spec.get("project")
    if not isinstance(p, dict):
        raise BundleError("the specification must describe its project")
    name, revision = str(p.get("name") or "").strip(), str(p.get("revision") or "").strip()
    namespace = str(p.get("namespace") or name).strip()
    if not name or not namespace or not is_pinned(revision):
        raise BundleError("the project needs a name, a namespace and a revision that cannot move")
    return name, namespace, revision


def _embedded(spec: dict) -> tuple:
    """All evidence entries, wherever they stand, with owner and position; ids stay as references."""
    entries, refs = [], []
    for e in spec.get("evidence") or []:
        entries.append((None, None, None, e))
    for kind in ("claims", "unresolved"):
        for i, c in enumerate(spec.get(kind) or []):
            if not isinstance(c, dict):
                raise BundleError(f"every entry of {kind} must be an object")
            es = c.get("evidence", c.get("evidence_ids", []))
            for k, e in enumerate([es] if isinstance(es, str) else es):
                if isinstance(e, str):
                    refs.append((kind, i, k, e))
                else:
                    entries.append((kind, i, k, e))
    if any(not isinstance(e[3], dict) for e in entries):
        raise BundleError("evidence must be an id or an object")
    return entries, refs


def evidence_rows(spark, entries: list, root, repository: str, revision: str, extractor: str = EXTRACTOR) -> DataFrame:
    """kind, i, k (who names it) and the evidence record, its hash and locator checked against the file. A hash that differs raises."""
    for e in entries:
        if not str(e[3].get("path") or "").strip() or not str(e[3].get("locator") or e[3].get("symbol") or "").strip():
            raise BundleError("embedded evidence needs a path and a locator")
    text = lambda v: None if v is None else str(v)
    rows = [(kind, i, k, text(e.get("evidence_id", e.get("id"))), str(e.get("source_type") or "source"), str(e.get("repository") or repository), str(e.get("revision") or revision),
             e["path"].strip(), str(e.get("locator") or e.get("symbol")).strip(), str(e.get("content_hash", e.get("sha256")) or "").removeprefix("sha256:").lower(), str(e.get("extractor") or extractor),
             text(e.get("environment")), dumps({**(e.get("attributes") or {}), **({"note": str(e["note"])} if e.get("note") is not None else {})}),
             dumps({f: e[f] for f in ("observed_at", "artifact_uri", "excerpt") if e.get(f) is not None})) for kind, i, k, e in entries]
    d = spark.createDataFrame(rows, "kind string, i int, k int, given string, source_type string, source_name string, revision string, path string, locator string, said string, extractor string, "
                                    "environment string, attributes string, extra string")
    d = d.join(evidence_files(spark, root, sorted({r[7] for r in rows})), "path")
    if wrong := d.filter("said <> '' and said <> content_hash").select("path").limit(1).collect():
        raise BundleError(f"the hash of {wrong[0].path} is not the one given")
    verified = F.to_json(F.struct(locator_valid(F.col("locator"), F.col("n_lines")).alias("locator_verified")))
    made = stable_id("evidence", repository=F.col("source_name"), revision=F.col("revision"), path=F.col("path"), locator=F.col("locator"), content_hash=F.col("content_hash"))
    return d.select("kind", "i", "k", F.coalesce("given", made).alias("evidence_id"), "source_type", "source_name", "revision", "path", "locator", F.concat(F.lit("sha256:"), "content_hash").alias("content_hash"),
                    "extractor", "environment", with_defaults(with_overrides("attributes", verified), "extra").alias("attributes"))


EVIDENCE = ["evidence_id", "source_type", "source_name", "revision", "path", "locator", "content_hash", "extractor", "environment", "attributes"]


def compile_spec(spark, path) -> tuple:
    """(bundle, metadata) of a specification. The first broken gate raises with the records that break it."""
    path = Path(path).expanduser().resolve()
    spec = document(path)
    if spec.get("version", 1) not in (1, "1"):
        raise BundleError(f"the version {spec.get('version')!r} of the specification is unknown")
    name, namespace, revision = project(spec)
    types, relations, summary = vocabularies(spec, path.parent)
    entities = spec.get("entities", spec.get("nodes"))
    if not isinstance(entities, list) or not isinstance(spec.get("claims"), list) or not all(isinstance(spec.get(k, []), list) for k in ("evidence", "unresolved")):
        raise BundleError("entities, claims, evidence and unresolved must be lists")
    nodes = materialise(jsonl.normalised(jsonl.from_rows(spark, entities, "entities"), "nodes"))
    _none(gates.identity_gate(nodes, gates.entity_table(spark, types)), lambda r: f"node {r.node_id} of type {r.node_type}: " + (f"lacks {r.missing}" if r.missing else "the type is unknown"))
    entries, refs = _embedded(spec)
    rows = materialise(evidence_rows(spark, entries, path.parent, name, revision))
    _none(gates.collisions(rows, "evidence_id", F.struct(*[F.coalesce(c, F.lit("\0")) for c in EVIDENCE])), lambda r: f"evidence id collision: {r.evidence_id}")
    evidence = rows.select(*EVIDENCE).dropDuplicates(["evidence_id"])
    named = rows.select("kind", "i", "k", "evidence_id").unionByName(spark.createDataFrame(refs, "kind string, i int, k int, evidence_id string"))
    ids = named.filter("kind is not null").groupBy("kind", "i").agg(F.array_sort(F.collect_list(F.struct("k", "evidence_id")))["evidence_id"].alias("ids"))

    claims = [{**c, "scope": {"namespace": namespace, "revision": revision, **(c.get("scope") or {})}, "claim_id": c.get("claim_id", c.get("id")) or f"_{i}"} for i, c in enumerate(spec["claims"])]
    unresolved = [{**u, "unresolved_id": u.get("unresolved_id", u.get("id")) or f"_{i}"} for i, u in enumerate(spec.get("unresolved") or [])]
    c = _with_ids(jsonl.normalised(jsonl.from_rows(spark, claims, "claims"), "claims"), "claim_id", claims, ids.filter("kind = 'claims'"), spark)
    c = c.withColumn("claim_id", F.when(F.col("claim_id").rlike("^_[0-9]+$"), jsonl.claim_id()).otherwise(F.col("claim_id")))
    u = _with_ids(jsonl.normalised(jsonl.from_rows(spark, unresolved, "unresolved"), "unresolved"), "unresolved_id", unresolved, ids.filter("kind = 'unresolved'"), spark)
    made = stable_id("unresolved", source_node_id=F.col("source_node_id"), target_hint=F.col("target_hint"), reason=F.col("reason"))
    u = u.withColumn("unresolved_id", F.when(F.col("unresolved_id").rlike("^_[0-9]+$"), made).otherwise(F.col("unresolved_id")))
    c, u = materialise(c), materialise(u)
    known = gates.relation_table(spark, relations)
    _none(gates.unknown_predicates(c, known), lambda r: f"the predicate {r.predicate!r} is not in the vocabulary")
    _none(gates.unverified(c, evidence), lambda r: f"claim {r.claim_id} is AUTO_VERIFIED, but the lines of {r.evidence_id} are not")
    bundle = Bundle(spark, nodes, evidence, materialise(gates.by_vocabulary(c, known)), u)
    bundle.require()
    return bundle, {"project": name, "namespace": namespace, "source_revision": revision, "spec": path.name, "method": "evidence-bounded-static-analysis", "ontology": summary}


def _with_ids(d: DataFrame, key: str, items: list, ids: DataFrame, spark) -> DataFrame:
    """Puts the collected evidence ids of the i-th item into its record."""
    place = spark.createDataFrame([(str(x[key]).strip(), i) for i, x in enumerate(items)], f"{key} string, i int")
    return d.drop("evidence_ids").join(place, key).join(ids.select("i", "ids"), "i", "left").withColumn("evidence_ids", F.coalesce("ids", F.array().cast("array<string>"))).drop("i", "ids").select(*d.columns)


def _none(rows: DataFrame, say) -> None:
    """Raises if there are rows, with up to 20 of them in words."""
    if bad := rows.limit(20).collect():
        raise BundleError(*map(say, bad))


def build(spark, spec, out, snapshot_id: str | None = None) -> Bundle:
    """Compiles, writes, and loads what was written with all checks."""
    bundle, metadata = compile_spec(spark, spec)
    bundle.write(out, snapshot_id, metadata)
    return Bundle.load(spark, out)


def write_vocabularies(folder) -> dict:
    """Writes the default vocabulary as two JSON documents and returns how a specification names them."""
    folder = Path(folder)
    head = {"name": "groundline-default", "version": "1"}
    (folder / "entities.json").write_text(json.dumps(head | {"entity_types": {k: {"identity": v} for k, v in gates.ENTITY_TYPES.items()}}, indent=1) + "\n")
    (folder / "relations.json").write_text(json.dumps(head | {"relations": {k: {"category": c, "dependency_direction": d, "include_in_lineage": i} for k, (c, d, i) in gates.RELATIONS.items()}}, indent=1) + "\n")
    return {"entities": "entities.json", "relations": "relations.json"}
