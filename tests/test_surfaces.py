import io
import json
import threading
import urllib.request

import pytest

from groundline import cli, serve
from groundline.bundle import Bundle, BundleError
from groundline.functions import viewer
from groundline.plans import bootstrap, golden, ledger
from groundline.tools import Graph

D = "urn:groundline:demo:"


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    return bootstrap.demo(spark, tmp_path_factory.mktemp("demo") / "graph")


GRAPH = {"nodes": [{"id": "mod", "label": "mod.py", "file_type": "code", "source_file": "src/mod.py", "source_location": "L1"}, {"id": "fn", "label": "", "file_type": "code", "source_file": "src\\mod.py"},
                   {"id": "other", "source_file": "src/mod.py"}, {"id": "external_table", "label": "t"}],
         "edges": [{"source": "mod", "target": "fn", "relation": "Contains", "confidence": "extracted", "source_file": "src/mod.py", "source_location": "L1"},
                   {"source": "fn", "target": "other", "relation": "calls", "confidence": "inferred", "source_file": "src/mod.py"}, {"source": "fn", "target": "external_table", "relation": "mentions"}],
         "input_tokens": 0, "output_tokens": 0}


def test_ledger(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "mod.py").write_text("def fn(): pass\n")
    make = lambda g: ledger.adapt(spark, g, "shop", "a" * 40, tmp_path, "1.2")
    x = make(GRAPH)
    claims = x["claims"].collect()
    assert {c.proposed_predicate for c in claims if c.promotion_eligible} == {"CONTAINS", "INVOKES"} and {c.review_status for c in claims} == {"CANDIDATE"}
    assert [(r.reason) for r in x["unresolved"].collect()] == ["NO_SOURCE_LOCATION"] and x["nodes"].count() == 4
    m = ledger.write(x, tmp_path / "out")
    assert m["counts"] == {"nodes": 4, "claims": 3, "evidence": 2, "unresolved": 1} and m["accepted_claim_count"] == 0
    assert ledger.write(make(GRAPH), tmp_path / "again") == m
    with pytest.raises(FileExistsError):
        ledger.write(x, tmp_path / "out")
    lost = json.loads(json.dumps(GRAPH))
    lost["edges"][1]["target"] = "unknown_id"
    assert {r.reason for r in make(lost)["unresolved"].collect()} == {"NO_SOURCE_LOCATION", "DANGLING_EXTRACTOR_ENDPOINT"}
    for change, word in (({"input_tokens": 1}, "language model"), ({"nodes": GRAPH["nodes"] * 2}, "twice"), ({"edges": None}, "list"), ({"edges": [{"source": 3, "target": "fn"}]}, "needs a text"),
                         ({"nodes": [{"id": "a", "source_file": "/etc/x"}]}, "stay")):
        with pytest.raises(BundleError, match=word):
            make(GRAPH | change)
    with pytest.raises(BundleError, match="hex"):
        ledger.adapt(spark, GRAPH, "shop", "main", tmp_path, "1.2")


def test_golden(spark, demo, tmp_path):
    q = lambda i, tool, args, **want: {"id": i, "tool": tool, "arguments": args, "expect": want}
    good = [q("a", "find_entity", {"query": "sum_sales"}, status="ANSWERED", contains_node_id=D + "job:sum-sales"), q("b", "get_downstream", {"node_id": D + "service:sales-page"}, status="UNKNOWN"),
            q("c", "find_dependency_path", {"source_node_id": D + "trigger:nightly", "target_node_id": D + "service:sales-page"}, status="ANSWERED")]
    ask = lambda qs, v=1: ((tmp_path / "g.json").write_text(json.dumps({"version": v, "questions": qs})), golden.evaluate(spark, demo.folder, tmp_path / "g.json"))[1]
    r = ask(good)
    assert r["status"] == "PASS" and r["summary"] == {"passed": 3, "failed": 0, "total": 3}
    r = ask([q("a", "get_upstream", {"node_id": "nothing"}, status="ANSWERED"), q("b", "get_upstream", {"node_id": D + "job:sum-sales"}, status="UNKNOWN", contains_node_id="zz")])
    assert [c["actual_status"] for c in r["cases"]] == ["ERROR", "ANSWERED"] and r["status"] == "FAIL" and len(r["cases"][1]["errors"]) == 2
    for bad, word in (([], "hold a question"), (good[:1] * 2, "twice"), ([q("a", "graph_health", {}, status="x")], "unknown tool"), ([q("a", "find_entity", {}, statuss="x")], "unknown things"),
                      ([q("a", "find_entity", {})], "expect a status"), (["x"], "object")):
        with pytest.raises(BundleError, match=word):
            ask(bad)
    with pytest.raises(BundleError, match="version"):
        ask(good, 2)


def test_bootstrap_modes(spark, tmp_path):
    root = tmp_path / "shop"
    root.mkdir()
    (root / "a.txt").write_text("x")
    first = bootstrap.bootstrap(spark, root, ".groundline/graph")
    again = bootstrap.bootstrap(spark, root, ".groundline/graph")
    assert (first["bootstrap_mode"], again["bootstrap_mode"]) == ("starter", "existing") and first["bundle_digest"] == again["bundle_digest"]
    assert first["counts"] == {"nodes": 1, "claims": 0, "accepted_claims": 0, "review_queue": 0, "evidence": 0, "unresolved": 1} and first["status"] == "PASS"
    modes, out = [], root / "two" / "graph"
    threads = [threading.Thread(target=lambda: modes.append(bootstrap.bootstrap(spark, root, out)["bootstrap_mode"])) for _ in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(modes) == ["existing", "starter"]
    (root / "part").mkdir()
    (root / "part" / "nodes.jsonl").write_text("")
    for call in (lambda: bootstrap.bootstrap(spark, root, "part"), lambda: bootstrap.bootstrap(spark, root, "new", spec="none.json")):
        with pytest.raises(BundleError):
            call()
    assert bootstrap.find_spec(root) is None
    (root / ".groundline" / "context-graph.json").write_text("{}")
    assert bootstrap.find_spec(root).name == "context-graph.json"


def test_command_line(spark, demo, tmp_path, capsys):
    def run(*args):
        code = cli.main(list(map(str, args)), spark)
        return code, json.loads(capsys.readouterr().out)
    assert run("doctor", demo.folder)[0] == 0 and run("doctor", tmp_path)[0] == 2
    code, r = run("impact", demo.folder, D + "job:read-sales", "--max-hops", 4)
    assert code == 0 and r["impact_summary"]["total"] == 4 and r["impact_summary"]["direct"] == 1
    assert run("downstream", demo.folder, "nothing")[0] == 2
    (tmp_path / "g.json").write_text(json.dumps({"version": 1, "questions": [{"tool": "find_entity", "arguments": {"query": "zz zz"}, "expect": {"status": "ANSWERED"}}]}))
    assert run("eval", demo.folder, tmp_path / "g.json")[0] == 1
    code, r = run("example", tmp_path / "ex")
    assert code == 0 and r["extraction"]["dags"] == 3 and r["extraction"]["tasks"] == 8
    code, r = run("path", tmp_path / "ex", "urn:groundline:example/task/sales_load/read", "urn:groundline:example/task/sales_report/report")
    assert code == 0 and r["status"] == "ANSWERED" and r["paths"][0]["hops"] == 7


def test_json_rpc(demo):
    g, out = Graph(demo), io.StringIO()
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
             {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_downstream", "arguments": {"node_id": D + "dataset:sales-daily"}}},
             {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "get_downstream", "arguments": {"node_id": "zz", "max_hops": 0}}}, {"jsonrpc": "2.0", "id": 5, "method": "zz"}]
    serve.stdio(g, [json.dumps(a) for a in asked] + ["{", ""], out)
    r = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x.get("id") for x in r] == [1, 2, 3, 4, 5, None] and len(r[1]["result"]["tools"]) == 7
    assert r[2]["result"]["structuredContent"]["results"][0]["node_id"] == D + "service:sales-page" and r[3]["result"]["isError"] and "error" in r[4] and "error" in r[5]
    with pytest.raises(ValueError):
        serve.http(g, "0.0.0.0")
    s = serve.http(g, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    assert json.load(urllib.request.urlopen(url + "/"))["status"] == "PASS"
    post = urllib.request.Request(url + "/mcp", json.dumps(asked[2]).encode(), {"Content-Type": "application/json"})
    assert len(json.load(urllib.request.urlopen(post))["result"]["tools"]) == 7
    s.shutdown()


def test_viewer(spark, demo):
    d = spark.createDataFrame([("PhysicalDataset", "a" * 27), ("SLA", "b" * 26), ("Job", ""), (None, None)], "t string, n string")
    got = [tuple(r) for r in d.select(viewer.group_of(d.t), viewer.short(d.n, viewer.NAME)).collect()]
    assert got == [("Data", "a" * 23 + "…"), ("Contract", "b" * 26), ("Resource", ""), ("Resource", None)]
    assert viewer.marked_nodes(demo.nodes, " SALES_ ").count() == 3 and viewer.marked_nodes(demo.nodes, "").count() == 6 and viewer.marked_claims(demo.claims, "reads_from").count() == 2
    assert viewer.figures(demo).first().asDict() == {"nodes": 6, "accepted": 5, "candidates": 0, "evidence": 5, "boundaries": 1} and viewer.shown_boundaries(demo.unresolved, 1).count() == 1
    assert Bundle.load(spark, demo.folder).snapshot_id == demo.snapshot_id
