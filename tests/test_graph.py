import random
from collections import deque

import pytest

from groundline.operators import search, traversal, validation

EDGE = "up string, down string, claim_id string, predicate string"


def graph(seed, n=9, m=26):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", f"c{i:02}", rnd.choice("PQ")) for i in range(m)]


def sorted_out(edges):
    out = {}
    for u, v, c, p in edges:
        out.setdefault(u, []).append((p, v, c))
    return {u: sorted(x) for u, x in out.items()}


def fifo_reach(edges, start, hops, cap):
    adj, queue, found, known = sorted_out(edges), deque([(start, [start], [])]), [], {start}
    while queue and len(found) < cap:
        u, nodes, claims = queue.popleft()
        if len(claims) == hops:
            continue
        for _, v, c in adj.get(u, []):
            if v not in known:
                known.add(v)
                found.append((v, len(claims) + 1, c, nodes + [v], claims + [c]))
                queue.append((v, nodes + [v], claims + [c]))
    return found


def fifo_paths(edges, s, t, hops, cap):
    adj, queue, found, best = sorted_out(edges), deque([([s], [])]), [], None
    while queue and len(found) < cap:
        nodes, claims = queue.popleft()
        if len(claims) >= hops or best is not None and len(claims) >= best:
            continue
        for _, v, c in adj.get(nodes[-1], []):
            if v in nodes:
                continue
            if v == t:
                best = len(claims) + 1
                found.append((nodes + [v], claims + [c]))
            else:
                queue.append((nodes + [v], claims + [c]))
    return found


@pytest.mark.parametrize("seed,cap,up", [(1, 500, False), (2, 3, False), (3, 4, True), (4, 1, False)])
def test_traverse_equals_a_queue(spark, seed, cap, up):
    edges = graph(seed)
    want = fifo_reach([(v, u, c, p) for u, v, c, p in edges] if up else edges, "n0", 4, cap)
    got = [(r.node_id, r.hops, r.via_claim_id, r.path_nodes, r.path_claims) for r in traversal.traverse(spark.createDataFrame(edges, EDGE), "n0", 4, up, cap).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed,cap", [(5, 10), (6, 1), (7, 2), (8, 3)])
def test_shortest_paths_equal_a_queue(spark, seed, cap):
    edges = graph(seed, 7, 24)
    want = fifo_paths(edges, "n0", "n3", 5, cap)
    p, _ = traversal.shortest_paths(spark.createDataFrame(edges, EDGE), "n0", "n3", 5, cap)
    assert sorted((r.path_nodes, r.path_claims) for r in p.collect()) == sorted(want)


def test_ends_of_paths(spark):
    e = spark.createDataFrame([("a", "b", "c1", "P")], EDGE)
    p, seen = traversal.shortest_paths(e, "a", "a")
    assert [tuple(r) for r in p.collect()] == [(0, ["a"], [])] and seen.count() == 1
    p, seen = traversal.shortest_paths(e, "b", "a")
    assert p.count() == 0 and seen.count() == 1
    assert traversal.traverse(e, "b", 3).count() == 0
    nodes = spark.createDataFrame([("a",)], "node_id string")
    with pytest.raises(KeyError):
        traversal.check(nodes, "z")
    for hops in (0, 21):
        with pytest.raises(ValueError):
            traversal.check(nodes, "a", max_hops=hops)


def claim_rows(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, subject string, predicate string, object string, assertion_kind string, review_status string, evidence_ids array<string>, "
                                       "scope string, attributes string, valid_from string, valid_to string")


def test_orientation_and_exclusion(spark):
    c = lambda i, p, a, kind="DECLARED", status="AUTO_VERIFIED": (i, "s", p, "o", kind, status, ["e"], None, a, None, None)
    rows = [c("1", "NEXT", None), c("2", "READS_FROM", "{}"), c("3", "READS_FROM", '{"lineage_orientation": "Forward"}'), c("4", "NEXT", '{"lineage_orientation": "reverse"}'),
            c("5", "NEXT", '{"include_in_lineage": false}'), c("6", "NEXT", '{"include_in_lineage": "false"}'), c("7", "NEXT", "{}", "INFERRED"), c("8", "NEXT", "{}", status="CANDIDATE"),
            c("9", "WAITS_FOR", "not json"), (None, "s", "NEXT", "o", "DECLARED", "AUTO_VERIFIED", None, None, None, None, None), c("A", "NEXT", None)[:1] + (None,) + c("A", "NEXT", None)[2:]]
    got = {(r.claim_id, r.up) for r in traversal.lineage_edges(claim_rows(spark, rows)).collect()}
    assert got == {("1", "s"), ("2", "o"), ("3", "s"), ("4", "o"), ("6", "s"), ("9", "s")}
    packed = traversal.packed_paths(traversal.traverse(traversal.lineage_edges(claim_rows(spark, rows[:1])), "s", 2), claim_rows(spark, rows)).first()
    assert packed.node_ids == ["s", "o"] and packed.evidence_ids == ["e"] and packed.steps[0].confidence == 1.0 and packed.steps[0].from_node == "s"


def test_find_tiers(spark):
    n = [("urn:a:orders", "Job", "orders_daily", ["Daily Orders"]), ("urn:a:x", "Table", "orders", None), ("urn:a:y", "Table", "my_orders", []), ("urn:a:z", "Orders", "stuff", []),
         ("urn:a:w", "Job", "order", []), ("urn:a:v", "Job", "Straße", []), ("urn:a:u", None, None, None)]
    d = spark.createDataFrame(n, "node_id string, node_type string, name string, aliases array<string>")
    got = {r.node_id: r.score for r in search.find(d, " ORDERS ").collect()}
    assert got == {"urn:a:x": 100.0, "urn:a:orders": 85.0, "urn:a:y": 70.0, "urn:a:z": 50.0, "urn:a:w": 54.545}
    assert [r.node_id for r in search.find(d, "orders", limit=2).collect()] == ["urn:a:x", "urn:a:orders"]
    assert [r.score for r in search.find(d, "STRASSE").collect()] == [100.0] and search.find(d, "orders", node_type="TABLE").count() == 2
    assert search.find(d, "zzzzzz").count() == 0
    for bad in (dict(query=" "), dict(query="a", limit=0), dict(query="a", limit=101)):
        with pytest.raises(ValueError):
            search.find(d, **bad)


def test_fold_equals_casefold(spark):
    words = ["ß", "ΣΑΣ", "σας", "ſtop", "İ", "ı", "Straße", "ÀÉ", "ﬁn", "Ǆ", "ŉ", "Ж"]
    d = spark.createDataFrame([(w,) for w in words], "w string").select("w", search.fold("w").alias("f"))
    assert {r.w: r.f for r in d.collect()} == {w: w.casefold() for w in words}


def test_pinned_revisions(spark):
    no = ["main", "origin/main", "refs/heads/release-1", "tip", "production", "stable", "", " HEAD ", None, "Prd", "working-tree"]
    yes = ["retail-demo-v1", "snapshot:0123456789abcdef", "abcdef1", "sha256:" + "a" * 64, "deadbeef", "v²"]
    d = spark.createDataFrame([(x,) for x in no + yes], "r string").select("r", validation.pinned("r").alias("p"))
    assert {r.r: r.p for r in d.collect()} == dict.fromkeys(no, False) | dict.fromkeys(yes, True)
    paths = {"/etc/x": False, "C:\\x": False, "c:/x": False, "\\\\host\\s": False, "a/../b": False, "a\\..\\b": False, "a/b..c": True, "a.py": True, "..": False}
    d = spark.createDataFrame([(x,) for x in paths], "p string")
    assert {r[0]: r[1] for r in d.select("p", validation.portable(d.p)).collect()} == paths
    local = {"/Users/ann/x": True, "see /home/bob/ now": True, "C:\\Users\\eve\\x": True, "https://a/home/b": False, "s3://bucket/x": False, "/private/tmp/y": True, "flows/a.py": False, "D:\\x": True}
    d = spark.createDataFrame([(x,) for x in local], "p string")
    assert {r[0]: r[1] for r in d.select("p", validation.local_path(d.p)).collect()} == local
