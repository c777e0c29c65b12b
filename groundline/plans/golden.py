"""Expected answers: a set of questions with the status and node each must bring."""
from ..bundle import Bundle
from ..sources.files import document
from ..sources.jsonl import BundleError
from ..tools import Graph, call

# What a question may call and expect.
ASKABLE = ("find_entity", "get_upstream", "get_downstream", "find_dependency_path", "assess_change_impact")
EXPECTABLE = {"status", "contains_node_id"}


def holds(value, text: str) -> bool:
    """Whether a value, or any value within it, is the text; keys do not count."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, (list, tuple)):
            todo += x
        elif x == text:
            return True
    return False


def questions(spec: dict) -> list:
    """The (id, tool, arguments, expectation) of a set; raises on the first fault of its form."""
    if spec.get("version") not in (1, "1"):
        raise BundleError("the version of the set must be 1")
    items = spec.get("questions")
    if not isinstance(items, list) or not items:
        raise BundleError("the set must hold a question")
    out = {}
    for i, q in enumerate(items, 1):
        if not isinstance(q, dict):
            raise BundleError(f"question {i} must be an object")
        name, tool, args, want = str(q.get("id") or f"question-{i}"), str(q.get("tool") or ""), q.get("arguments") or {}, q.get("expect") or {}
        if name in out:
            raise BundleError(f"the question id {name} is there twice")
        if tool not in ASKABLE:
            raise BundleError(f"question {name} calls the unknown tool {tool!r}")
        if not isinstance(args, dict) or not isinstance(want, dict):
            raise BundleError(f"question {name}: arguments and expect must be objects")
        if unknown := sorted(set(want) - EXPECTABLE):
            raise BundleError(f"question {name} expects unknown things: " + ", ".join(unknown))
        if "status" not in want:
            raise BundleError(f"question {name} must expect a status")
        out[name] = (name, tool, args, want)
    return list(out.values())


def evaluate(spark, bundle_path, golden_path) -> dict:
    """Asks all questions; a case passes if status and node are as expected. An error of the call is a failed case of status ERROR."""
    asked = questions(document(golden_path))
    g, cases = Graph(Bundle.load(spark, bundle_path)), []
    for name, tool, args, want in asked:
        errors = []
        try:
            got = call(g, tool, args)
            if want["status"] is not None and got["status"] != want["status"]:
                errors.append(f"expected the status {want['status']}, got {got['status']}")
            if want.get("contains_node_id") is not None and not holds(got, str(want["contains_node_id"])):
                errors.append(f"the node {want['contains_node_id']} is not in the result")
            status = got["status"]
        except (KeyError, ValueError) as e:
            status, errors = "ERROR", [str(e)]
        cases.append({"id": name, "tool": tool, "status": "FAIL" if errors else "PASS", "errors": errors, "actual_status": status})
    good = sum(not c["errors"] for c in cases)
    return {"status": "PASS" if good == len(cases) else "FAIL", "snapshot_id": g.bundle.snapshot_id, "golden_file": str(golden_path),
            "summary": {"passed": good, "failed": len(cases) - good, "total": len(cases)}, "cases": cases}
