import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from groundline.operators import heavy, hierarchy, intervals, orphans, snapshots, timestamps
from groundline.operators.skew import salted_join
from groundline.plans import problems
from groundline.sources import tables
from groundline.sources.versions import Versions

EDGE = "child string, parent string"
CLAIM = "claim_id string, subject string, predicate string, object string, assertion_kind string, review_status string, evidence_ids array<string>, loaded_at timestamp_ntz"


# problem 1

@pytest.mark.parametrize("rows", [1, 100_000])
def test_hierarchy_chain_and_loop(spark, rows):
    e = [(f"n{i + 1}", f"n{i}") for i in range(9)] + [("a", "b"), ("b", "a"), ("c", "a"), ("s", "s")] + [(f"leaf{i}", "n9") for i in range(5)]
    got = {r.node_id: (r.root_id, r.depth, r.path) for r in hierarchy.hierarchy(spark.createDataFrame(e, EDGE), rows).collect()}
    chain = [f"n{i}" for i in range(10)]
    want = {f"n{i}": ("n0", i, chain[:i + 1]) for i in range(10)} | {x: ("CYCLE", -1, None) for x in "abcs"} | {f"leaf{i}": ("n0", 10, chain + [f"leaf{i}"]) for i in range(5)}
    assert got == want


def test_hierarchy_empty_and_only_loops(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], EDGE)).count() == 0
    only = spark.createDataFrame([("a", "b", "x", 1), ("b", "a", "x", 2)], EDGE + ", node_id string, jump int")  # extra columns of inner names
    h = hierarchy.hierarchy(only)
    assert {tuple(r)[:3] for r in h.collect()} == {("a", "CYCLE", -1), ("b", "CYCLE", -1)} and hierarchy.descendants(h).count() == 0


def test_counting_claims(spark):
    ok = ("CONTAINS", "DECLARED", "AUTO_VERIFIED")
    rows = [("1", " p ", *ok, "c"), ("2", "p", *ok, "c"), ("3", "q", *ok, "c"), ("4", None, *ok, "d"), ("5", "p", *ok, " "), ("6", "p", " contains", "OBSERVED", "human_approved ", "e"),
            ("7", "p", "CONTAINS", "INFERRED", "AUTO_VERIFIED", "f"), ("8", "p", "CONTAINS", None, "AUTO_VERIFIED", "g"), ("9", "p", None, "DECLARED", "AUTO_VERIFIED", "h"), ("10", "x" * 10_000, *ok, "i")]
    c = spark.createDataFrame([(i, s, p, o, k, r) for i, s, p, k, r, o in rows], "claim_id string, subject string, predicate string, object string, assertion_kind string, review_status string")
    assert {tuple(r) for r in hierarchy.contains_edges(c).collect()} == {("c", "p"), ("e", "p"), ("i", "x" * 10_000)}
    assert [tuple(r) for r in hierarchy.second_parents(c).collect()] == [("c", "q")]


def test_descendants(spark):
    h = hierarchy.hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], EDGE))
    assert {tuple(r) for r in hierarchy.descendants(h).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


# problem 2

CASES = {("2024-03-31T02:30:00", "Europe/Berlin"): "2024-03-31T01:30:00", ("2024-10-27 02:30:00", "Europe/Berlin"): "2024-10-27T00:30:00", ("1704067200", "UTC"): "2024-01-01T00:00:00",
         ("Jan 1, 2024 12:05:00 AM EST", "UTC"): "2024-01-01T05:05:00", ("01.02.2024 10:15", "UTC"): "2024-02-01T10:15:00", ("2024-W01-1T00:00:00", "UTC"): "2024-01-01T00:00:00",
         ("2024-060T00:00:00", "UTC"): "2024-02-29T00:00:00", ("Mon, 1 Jan 2024 09:00:00 +0900", "UTC"): "2024-01-01T00:00:00", ("2024-02-30", "UTC"): None, ("0000-00-00 00:00:00", "UTC"): None,
         ("n/a", "UTC"): None, ("2024-01-01T00:00:00+05:30[Asia/Kolkata]", "UTC"): "2023-12-31T18:30:00", ("2024-01-01T00:00:00Z", "Asia/Tokyo"): "2024-01-01T00:00:00", ("2024-02-30T00:00:00Z", "UTC"): None,
         ("0000-01-01T00:00:00Z", "UTC"): None, ("9" * 5000, "UTC"): None, ("2024-01-01T10:00:00.1234567Z", "UTC"): "2024-01-01T10:00:00"}
KEYED = "raw string, zone string, source string"


def test_times(spark, tmp_path):
    d, _ = timestamps.dictionary(spark.createDataFrame([(r, z, "t") for r, z in CASES] + [(None, "UTC", "t"), ("", "UTC", "t")], KEYED), str(tmp_path))
    got = {(r.raw, r.zone): r.t for r in d.selectExpr("raw", "zone", "date_format(timestamp_micros(instant_us), \"yyyy-MM-dd'T'HH:mm:ss\") t").collect()}
    assert got == CASES


def test_the_dictionary_is_kept_and_only_new_pairs_are_parsed(spark, tmp_path, monkeypatch):
    parsed = []
    real = timestamps.parsed
    monkeypatch.setattr(timestamps, "parsed", lambda d: (parsed.append(sorted(r.raw for r in d.collect())), real(d))[1])
    rows = lambda *raws: spark.createDataFrame([(r, "UTC", "claims.valid_from", str(i)) for i, r in enumerate(raws)], KEYED + ", record_id string")
    a = {r.record_id: r.instant_us for r in timestamps.normalised(rows("2024", "2024-01-01", "2024-01-01", "n/a"), str(tmp_path), rows=1).collect()}  # rows=1: every repeated text is salted
    b = {r.record_id: r.instant_us for r in timestamps.normalised(rows("2024-01-01", "2024-01-02", "n/a"), str(tmp_path)).collect()}
    timestamps.normalised(rows("2024-01-02", "n/a"), str(tmp_path)).collect()
    day = 1704067200 * 10 ** 6
    assert a == {"0": 2024 * 10 ** 6, "1": day, "2": day} and b == {"0": day, "1": day + 86400 * 10 ** 6}
    assert parsed == [["2024", "2024-01-01", "n/a"], ["2024-01-02"]] and len(Versions(spark, str(tmp_path)).paths()) == 2
    other = spark.createDataFrame([("2024-01-01", "UTC", "evidence.observed_at", "9", 5)], KEYED + ", record_id string, instant_us int")  # another source is another key; a column of the result's name gives way
    assert [r.instant_us for r in timestamps.normalised(other, str(tmp_path)).collect()] == [day] and parsed[-1] == ["2024-01-01"]
    assert timestamps.normalised(rows().limit(0), str(tmp_path)).count() == 0


def test_two_additions_at_once_leave_each_pair_once(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/d")
    tries = []

    def make(there):
        d = spark.range(3).join(v.read("id bigint", there), "id", "left_anti") if there else spark.range(3)
        if not tries:
            tries.append(1)
            v.add(lambda _: spark.range(2))  # another run comes first
        return d
    assert len(v.add(make)) == 2 and sorted(r.id for r in v.read("id bigint").collect()) == [0, 1, 2]


def test_time_values_of_odd_tables(spark, tmp_path):
    env = spark.createDataFrame([("x", "Asia/Tokyo"), ("x", "Asia/Tokyo"), (None, "UTC"), ("y", None)], "environment string, tz_name string")
    c = spark.createDataFrame([("c1", '{"environment": " x "}', "2024-01-01 09:00:00", None, 1), ("c1 ", '{"environment": "x"}', "2024-01-01T00:00:00.000Z", None, 1), (None, "no json", "2024-01-01", "2024-01-01", 1),
                               ("c2", None, " ", "2024-01-02 ", 1)], "claim_id string, scope string, observed_at string, valid_from string, raw int")
    e = spark.createDataFrame([("e1", "y", "2024-01-01")], "evidence_id string, environment string, observed_at string")
    v = timestamps.time_values(c, e, env)
    day = 1704067200 * 10 ** 6
    assert {tuple(r) for r in timestamps.instants(v, str(tmp_path)).collect()} == {("claims", "observed_at", "c1", day), ("claims", "valid_from", "c2", day + 86400 * 10 ** 6), ("evidence", "observed_at", "e1", day)}
    assert timestamps.instants(timestamps.time_values(c.limit(0), e.limit(0), env.limit(0)), str(tmp_path)).count() == 0


# problem 3

def test_heavy_nodes_against_brute_force(spark):
    rnd = random.Random(1)
    ends = ["h", "h", "h", None, *"abcd"]
    claims = [(f"c{i}", rnd.choice(ends), "P", rnd.choice(ends), "DECLARED", "CANDIDATE", ["e"] * (i % 3) if i % 5 else None, None) for i in range(60)]
    nodes = [("h", "Old", dt.datetime(2024, 1, 1)), (" h", "New", dt.datetime(2025, 1, 1)), ("a", None, None), (None, "X", None), ("unused", "Y", None)]
    c = spark.createDataFrame(claims + claims[:9] + [(None, "h", "P", "h", None, None, None, None)], CLAIM)
    n = spark.createDataFrame(nodes, "node_id string, node_type string, loaded_at timestamp_ntz")
    refs = {x[0]: len(x[6] or []) for x in claims}
    got = {r.node_id: r for r in heavy.node_results(c, n).collect()}
    for k in "habcd":
        out, into = [x for x in claims if x[1] == k], [x for x in claims if x[3] == k]
        pairs = [(a, b) for a in into for b in out]
        assert (got[k].n_subject, got[k].n_object, got[k].n_two_hop, got[k].refs_two_hop) == (len(out), len(into), len(pairs), sum(refs[a[0]] + refs[b[0]] for a, b in pairs))
    assert got["h"].node_type == "New" and got[None].n_two_hop == 0 and "unused" not in got
    share = 0.2
    want = {(s, k) for s, i in (("subject", 1), ("object", 3)) for k in "habcd" if sum(x[i] == k for x in claims) >= share * len(claims)}
    assert {tuple(r) for r in heavy.heavy_nodes(c, n, share).collect()} == want and want
    total = heavy.roll_up(heavy.node_results(c, n)).filter("is_total = 1").first()
    assert (total.n_subject, total.n_object, total.n_nodes) == (60, 60, 5)
    assert heavy.heavy_nodes(c.limit(0), n.limit(0)).count() == 0


def test_salted_join_equals_the_plain_one(spark):
    rnd = random.Random(2)
    many = spark.createDataFrame([(rnd.choice(["hot"] * 9 + ["x", "y", None]), str(i)) for i in range(300)], "k string, id string")
    one = spark.createDataFrame([("hot", 1), ("x", 2), (None, 3)], "k string, v int")
    for how in ("inner", "left"):
        plain = sorted(map(str, many.join(one, "k", how).collect()))
        assert sorted(map(str, salted_join(many, one, ["k"], how, "id", rows=7).collect())) == plain == sorted(map(str, salted_join(many, one, ["k"], how, "id").collect()))


# problem 4

def spans_of(rows):
    want = set()
    for s in {r[0] for r in rows if r[0] is not None}:
        runs = []
        for a, b in sorted((a, b) for t, a, b in rows if t == s and None not in (a, b) and a < b):
            if runs and runs[-1][1] >= a:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        want |= {(s, "period", a, b) for a, b in runs} | {(s, "gap", p[1], q[0]) for p, q in zip(runs, runs[1:])}
    return want


@pytest.mark.parametrize("levels", [(2, 4), (3, 7), (4, 5)])
def test_spans_against_brute_force(spark, levels):
    rnd = random.Random(levels[0])
    schema = "subject string, start_us bigint, end_us bigint, a int, runs string"
    rows = [(f"s{k}", a := rnd.randrange(-60, 300), a + rnd.choice([rnd.randrange(-3, 9), rnd.randrange(0, 30), rnd.randrange(0, 200)])) for k in range(30) for _ in range(rnd.choice([1, 3, 7, 20]))]
    rows += [(None, 1, 2), ("w", None, 3), ("w", 3, None), ("w", 5, 5), ("w", 9, 5), ("v", 1, 2), ("v", 1, 2), ("v", 2, 3), ("u", 0, 10 ** 6), ("u", 16, 32)]
    got = [tuple(r) for r in intervals.spans(spark.createDataFrame([(*r, 0, "x") for r in rows], schema), levels).collect()]
    assert set(got) == spans_of(rows) and len(got) == len(set(got))


def test_spans_of_real_times(spark):
    rows = [("x", -10 ** 15, 5), ("x", 253402214400000000 - 1, intervals.OPEN_US), ("x", 1 << 34, (1 << 44) + 7), ("x", (1 << 44) + 7, 1 << 53), ("y", (1 << 53) + 1, (1 << 53) + 2), ("y", (1 << 53) + 3, intervals.OPEN_US)]
    assert {tuple(r) for r in intervals.spans(spark.createDataFrame(rows, "subject string, start_us bigint, end_us bigint")).collect()} == spans_of(rows)
    assert intervals.spans(spark.createDataFrame([], "subject string, start_us bigint, end_us bigint")).count() == 0


def test_bitmaps_are_bounded_and_united(spark):
    rows = [("hot", i * 1000, i * 1000 + 999) for i in range(3000)] + [("hot", 0, 10)] * 50
    m = intervals.bitmaps(spark.createDataFrame(rows, "subject string, start_us bigint, end_us bigint"), (12, 22)).collect()
    assert len(m) > 700 and max(len(r.runs) for r in m) <= 1024
    for r in m:
        assert all(x.a < x.b for x in r.runs) and all(x.b < y.a for x, y in zip(r.runs, r.runs[1:]))


# problem 5

@pytest.mark.parametrize("leaf_rows", [1, 16, 1000])
def test_changes_against_brute_force(spark, leaf_rows):
    rnd = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    names, state, rows, want, before = ["s3", "s1", "s2", "s0"], {}, [], set(), None
    for k, s in enumerate(names):
        for i in range(60):
            if rnd.random() < 0.1:
                state.pop(f"r{i}", None)
            elif rnd.random() < 0.2 or k == 0:
                state[f"r{i}"] = rnd.choice("abc")
        for r, b in state.items():
            rows += [("t", s, r, day, "old"), ("t", s, r, day + dt.timedelta(1), b), ("t", s, r, day + dt.timedelta(1), b)]
        if before is not None:
            for r in set(state) | set(before[1]):
                x, y = before[1].get(r), state.get(r)
                if x != y:
                    want.add(("t", r, before[0], s, "added" if x is None else "removed" if y is None else "changed"))
        before = (s, dict(state))
    rows += [("t", "s1", None, day, "a"), ("t", "unknown", "r1", day, "a"), ("t", None, "r1", day, "a"), ("u", "s3", "only", None, None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "table_name string, snapshot_id string, record_id string, at timestamp_ntz, body string, i int")
    m = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(names[0], 0), (None, 9)], "snapshot_id string, seq int")
    got = [tuple(r) for r in snapshots.snapshot_changes(d.fillna("", ["body"]), m, leaf_rows).collect()]
    assert {g for g in got if g[0] == "t"} == want and ("u", "only", "s3", "s1", "removed") in got and len(got) == len(set(got)) == len(want) + 1
    assert snapshots.snapshot_changes(d.limit(0), m).count() == 0 and snapshots.snapshot_changes(d, m.limit(0)).count() == 0


def test_content_in_other_writing_is_the_same(spark):
    n = spark.createDataFrame([("s", "a", "job ", "A", ["x", "y", "x"], '{"a": 1, "b": [1, 2]}', None), ("s", "b", "JOB", "A", ["y", "x"], '{"b":[1,2],"a":1}', None), ("s", "c", "Job", None, None, "no json", None)],
                              "snapshot_id string, node_id string, node_type string, name string, aliases array<string>, attributes string, delivered_at timestamp_ntz")
    c = spark.createDataFrame([], "snapshot_id string, claim_id string, subject string, predicate string, object string, assertion_kind string, review_status string, evidence_ids array<string>, delivered_at timestamp_ntz")
    e = spark.createDataFrame([("s", "e", "v1", "sha256:AB", None), ("s", "f", " v1", "ab", None)], "snapshot_id string, evidence_id string, revision string, content_hash string, delivered_at timestamp_ntz")
    b = {r.record_id: r.body for r in snapshots.rows_of(n, c, e).collect()}
    assert b["a"] == b["b"] != b["c"] and b["e"] == b["f"]


def test_leaves_follow_the_rows():
    assert [snapshots.leaf_bits(n) for n in (0, 256, 257, 1 << 20, 1 << 40)] == [0, 0, 4, 12, 32]


# problem 6

def test_any_split_into_loads_gives_the_batch_result(spark):
    rnd = random.Random(6)
    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    refs = [("claims", rnd.choice(["subject", "object"]), f"c{i}", "nodes", rnd.choice(["n0"] * 6 + [f"n{k}" for k in range(9)]), t(rnd.randrange(100))) for i in range(60)]
    rows = [("nodes", f"n{rnd.randrange(7)}", t(a := rnd.randrange(-20, 90)), rnd.choice([None, t(a + rnd.randrange(1, 60))])) for _ in range(14)] + [("evidence", "n8", t(0), None)]

    def state_of(r):
        own = [(a, d) for p, k, a, d in rows if (p, k) == (r[3], r[4])]
        if any(a <= r[5] and (d is None or d > r[5]) for a, d in own):
            return None
        return "missing" if not own else "deleted" if any(a <= r[5] for a, _ in own) else "late"
    want = sorted((r[0], r[1], r[2], r[4], s, r[5].strftime("%Y-%m")) for r in refs if (s := state_of(r)))
    R, P = "table_name string, field_name string, record_id string, parent string, ref_id string, at timestamp_ntz, spans int", "parent string, ref_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, more int"
    for loads in (1, 3, 5):
        s = orphans.OrphanState(spark, rows=5)
        mine, theirs = [[] for _ in range(loads)], [[] for _ in range(loads)]
        for r in refs:
            mine[rnd.randrange(loads)].append((*r, 0))  # in no order at all
        for r in rows:
            theirs[rnd.randrange(loads)].append((*r, 0))
        for k in range(loads):
            s.advance(spark.createDataFrame(mine[k], R), spark.createDataFrame(theirs[k], P), t(200))
        assert sorted(tuple(r) for r in s.found().collect()) == want and {w[4] for w in want} == {"missing", "deleted", "late"}


def test_arrival_resolves_and_deletion_opens_again(spark):
    t = lambda m: dt.datetime(2024, m, 1)
    R, P = "table_name string, field_name string, record_id string, parent string, ref_id string, at timestamp_ntz", "parent string, ref_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
    refs = spark.createDataFrame([("claims", "subject", "c", "nodes", "n", t(1)), ("claims", "subject", "d", "nodes", "never", t(2)), ("claims", "object", "d", "nodes", "m", None)], R)
    rows = spark.createDataFrame([("nodes", "n", dt.datetime(2024, 2, 15), dt.datetime(2024, 3, 15)), ("nodes", "n", dt.datetime(2024, 4, 15), None)], P)
    state, counts = orphans.run_loads(refs, rows, "month")
    by = {r.until: (r.n_orphans, r.n_open, r.n_resolved, r.n_reopened) for r in counts.collect()}
    assert by == {"2024-02-01": (1, 1, 0, 0), "2024-03-01": (2, 1, 1, 0), "2024-05-01": (2, 1, 1, 0)}
    assert sorted((r.record_id, r.ref_state) for r in state.found().collect()) == [("c", "late"), ("d", "missing")]
    s = orphans.OrphanState(spark)
    s.advance(refs.limit(1), rows.limit(0), t(2))
    s.advance(refs.limit(0), rows.limit(1), t(3))
    s.advance(refs.limit(0), rows.limit(0), t(4))
    assert s.counts("x").first().n_reopened == 1 and s.counts("x").first().n_open == 1
    none = orphans.run_loads(refs.limit(0), rows.limit(0))
    assert none[0].found().count() == 0 and none[1].count() == 0


def test_references_of_odd_rows(spark):
    d = dt.datetime
    c = spark.createDataFrame([("c", " a", "P", "b", None, None, [" e", "e", None, ""], d(2024, 2, 1)), ("c ", "a", "P", "b", None, None, ["e"], d(2024, 1, 1)), (None, "a", "P", "b", None, None, None, d(2024, 1, 1)),
                               ("k", None, None, " ", None, None, None, None)], CLAIM)
    u = spark.createDataFrame([("u", "a", d(2024, 3, 1)), ("u", "a", None)], "unresolved_id string, source_node_id string, loaded_at timestamp_ntz")
    got = {(r.table_name, r.field_name, r.record_id, r.parent, r.ref_id, r["at"]) for r in orphans.references(c, u).collect()}
    assert got == {("claims", "subject", "c", "nodes", "a", d(2024, 1, 1)), ("claims", "object", "c", "nodes", "b", d(2024, 1, 1)), ("claims", "evidence_ids", "c", "evidence", "e", d(2024, 1, 1)),
                   ("unresolved", "source_node_id", "u", "nodes", "a", d(2024, 3, 1))}


# the shared folder

def test_written_tables_go_where_the_context_says(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", tables.shared_dir)
    assert tables.shared_dir(spark)
    d = tables.materialise(spark.range(3))
    path = d._written_at
    assert path.startswith(tables.scratch_dir(spark)) and d.count() == 3
    tables.discard(d)
    p, fs = tables.hadoop_path(spark, path)
    assert not fs.exists(p)


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class _Fake:
    """A session as shared_dir sees it."""

    def __init__(self, master, conf=None, folder=None):
        self.conf, self.sparkContext, self.set = _Conf(conf), self, None
        self.master, self.folder, self._jsc = master, folder, self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return self.folder is not None

    def get(self):
        return self.folder

    def setCheckpointDir(self, d):
        self.set = d


def test_no_local_folder_on_a_cluster():
    assert tables.shared_dir(_Fake("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert tables.shared_dir(_Fake("yarn", None, "hdfs://c/d")) == "hdfs://c/d"
    f = _Fake("local[4]")
    assert tables.shared_dir(f).startswith("file:") and f.set
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            tables.shared_dir(_Fake(master))


def test_registered_queries_run_on_the_smallest_tables(spark):
    for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"):
        assert problems.QUERIES[name](spark, "/root/testdata/sf0.001").select(F.count("*")).first()[0] > 0
