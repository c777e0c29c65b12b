"""First start of a project: an existing snapshot, one built from a specification, or a starter that claims nothing; and a demonstration."""
import fcntl
import hashlib
import subprocess
from contextlib import contextmanager
from pathlib import Path

from ..bundle import Bundle
from ..functions.canonical import dumps
from ..sources.files import NO_SNAPSHOT, folder_digest
from ..sources.jsonl import BundleError
from . import compile as compiler
from . import gates

# Where a specification is looked for, in this order.
SPEC_NAMES = ("groundline-context-graph.yaml", "groundline-context-graph.yml", "groundline-context-graph.json", ".groundline/context-graph.yaml", ".groundline/context-graph.yml", ".groundline/context-graph.json")
HINT, WHY = "accepted_pipeline_context", "No specification was found; the relations of the pipelines stay unproven until one is built."


def _hash(value) -> str:
    return "sha256:" + hashlib.sha256(dumps(value).encode()).hexdigest()


def find_spec(root) -> Path | None:
    return next((Path(root) / n for n in SPEC_NAMES if (Path(root) / n).is_file()), None)


def revision_of(root) -> str:
    """The commit of a git project, else the digest of its files (without the folders of tools)."""
    try:
        r = subprocess.run(["git", "-C", str(root), "rev-parse", "--verify", "HEAD"], check=True, capture_output=True, text=True, timeout=10).stdout.strip().lower()
        if len(r) == 40 and not set(r) - set("0123456789abcdef"):
            return r
    except (OSError, subprocess.SubprocessError):
        pass
    return folder_digest(root, NO_SNAPSHOT | {".groundline"})


@contextmanager
def only_one(out: Path):
    """Holds the lock beside the output folder, so that of two starts at once the second waits."""
    out.parent.mkdir(parents=True, exist_ok=True)
    with open(out.parent / f".{out.name}.bootstrap.lock", "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def starter(spark, root, out) -> Bundle:
    """One repository node, no claim, one unresolved boundary."""
    root = Path(root).resolve()
    if not root.is_dir():
        raise BundleError(f"{root} is no folder")
    name, revision = root.name or "project", revision_of(root)
    node = f"urn:groundline:bootstrap:{hashlib.sha256(f'{name}{chr(0)}{revision}'.encode()).hexdigest()[:20]}:repository"
    b = Bundle.of(spark, {"nodes": [{"node_id": node, "node_type": "Repository", "name": name, "attributes": {"bootstrap": True}}],
                          "unresolved": [{"source_node_id": node, "target_hint": HINT, "reason": WHY, "attributes": {"bootstrap": True}}]})
    b.write(out, metadata={"project": name, "source_revision": revision, "method": "fail-closed-project-bootstrap", "ontology": {
        "name": "groundline-bootstrap", "version": "1", "entities_sha256": _hash({"Repository": ["name"]}), "relations_sha256": _hash({"CONTAINS": gates.RELATIONS["CONTAINS"]})}})
    return Bundle.load(spark, out)


def bootstrap(spark, root, out, spec=None) -> dict:
    """The state of health of the project's snapshot with bootstrap_mode: existing, spec or starter. A folder with other files is refused."""
    root = Path(root).expanduser().resolve()
    out = (root / Path(out).expanduser()).resolve()
    with only_one(out):
        source = None
        if (out / "manifest.json").is_file():
            mode, b = "existing", Bundle.load(spark, out)
        else:
            if out.exists() and any(out.iterdir()):
                raise BundleError(f"{out} is neither empty nor a whole snapshot")
            source = find_spec(root) if spec is None else (root / Path(spec).expanduser()).resolve()
            if source is not None and not source.is_file():
                raise BundleError(f"there is no specification {source}")
            mode, b = ("starter", starter(spark, root, out)) if source is None else ("spec", compiler.build(spark, source, out))
    return b.doctor() | {"bootstrap_mode": mode, "bundle_dir": str(out), "source_spec": source and str(source)}


def demo(spark, out) -> Bundle:
    """A small snapshot to look at: six nodes, five claims with evidence, one boundary."""
    ns, oriented = "urn:groundline:demo:", {p: {"lineage_orientation": d, "include_in_lineage": i} for p, (_, d, i) in gates.RELATIONS.items()}
    nodes = [("trigger:nightly", "Trigger", "nightly"), ("job:read-sales", "Job", "read_sales"), ("dataset:sales-raw", "PhysicalDataset", "sales_raw"), ("job:sum-sales", "Job", "sum_sales"),
             ("dataset:sales-daily", "PhysicalDataset", "sales_daily"), ("service:sales-page", "Service", "sales_page")]
    claims = [("trigger:nightly", "TRIGGERS", "job:read-sales"), ("job:read-sales", "WRITES_TO", "dataset:sales-raw"), ("job:sum-sales", "READS_FROM", "dataset:sales-raw"),
              ("job:sum-sales", "WRITES_TO", "dataset:sales-daily"), ("service:sales-page", "READS_FROM", "dataset:sales-daily")]
    evidence = [{"evidence_id": f"evidence:demo-{k}", "source_type": "source", "repository": "demo", "revision": "demo-v1", "path": "flows/sales.py", "locator": f"L{k}", "extractor": "demo",
                 "content_hash": hashlib.sha256(str(k).encode()).hexdigest(), "attributes": {"locator_verified": True}} for k in range(1, 6)]
    b = Bundle.of(spark, {
        "nodes": [{"node_id": ns + i, "node_type": t, "name": n} for i, t, n in nodes], "evidence": evidence,
        "claims": [{"subject": ns + s, "predicate": p, "object": ns + o, "review_status": "AUTO_VERIFIED", "evidence_ids": [f"evidence:demo-{k}"], "attributes": oriented[p]} for k, (s, p, o) in enumerate(claims, 1)],
        "unresolved": [{"source_node_id": ns + "service:sales-page", "target_hint": "mail_receiver", "reason": "DYNAMIC_TARGET", "evidence_ids": ["evidence:demo-5"]}]})
    b.write(out, metadata={"project": "demo", "source_revision": "demo-v1", "ontology": {"name": "groundline-default", "version": "1", "entities_sha256": _hash(gates.ENTITY_TYPES), "relations_sha256": _hash(gates.RELATIONS)}})
    return Bundle.load(spark, out)
