"""Registered queries of the general problems, over whole tables."""
from pyspark.sql import functions as F

from ..functions.instants import parsed
from ..functions.text import ident, strip
from ..operators import heavy, hierarchy, intervals, orphans, snapshots, timestamps
from ..sources.tables import spread, table
from . import time_sql


def p1_hierarchy(spark, d):
    h = hierarchy.hierarchy(hierarchy.contains_edges(table(spark, d, "claims")))
    return h.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p1_found(spark, d):
    return hierarchy.hierarchy(hierarchy.contains_edges(table(spark, d, "claims"))).select("node_id", "root_id", "depth")


def p1_descendants(spark, d):
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.contains_edges(table(spark, d, "claims"))))


def p1_second_containers(spark, d):
    return hierarchy.second_parents(table(spark, d, "claims"))


def _values(spark, d):
    return timestamps.time_values(*(table(spark, d, t) for t in ("claims", "evidence", "environments")))


def p2_found(spark, d):
    return timestamps.instants(timestamps.odd(_values(spark, d)), timestamps.kept_folder(spark, d))


def p2_instants(spark, d):
    return timestamps.instants(_values(spark, d), timestamps.kept_folder(spark, d))


def p3_found(spark, d):
    return heavy.heavy_nodes(table(spark, d, "claims"), table(spark, d, "nodes"))


def p3_node_results(spark, d):
    return heavy.node_results(table(spark, d, "claims"), table(spark, d, "nodes")).filter("node_id is not null")


def p3_type_results(spark, d):
    return heavy.roll_up(heavy.node_results(table(spark, d, "claims"), table(spark, d, "nodes")))


def p4_found(spark, d):
    tz = F.broadcast(table(spark, d, "environments").select(strip("environment").alias("env"), "tz_name").dropDuplicates(["env"]))
    c = table(spark, d, "claims").filter(ident("claim_id").isNotNull()).select(ident("subject").alias("subject"), strip("valid_from").alias("raw"), strip("valid_to").alias("to"),
                                                                              strip(F.get_json_object("scope", "$.environment")).alias("env"))
    # deliveries of one claim hold one interval, and a union does not change by repetition: no need to make claims distinct
    c = parsed(spread(c.filter("subject is not null and raw <> ''")).join(tz, "env", "left").withColumn("zone", F.coalesce("tz_name", F.lit("UTC"))))
    end = F.when(F.coalesce("to", F.lit("")) == "", F.lit(intervals.OPEN_US)).otherwise(F.unix_micros(F.col("to").try_cast("timestamp")))
    # the coalesce moves no row: it keeps parsing and cutting in two pieces of generated code, which together pass the JVM's limit
    return intervals.spans(c.select("subject", F.col("instant_us").alias("start_us"), end.alias("end_us")).coalesce(1 << 20))


def p5_found(spark, d):
    rows = snapshots.rows_of(*(table(spark, d, f"{t}_snapshots") for t in ("node", "claim", "evidence")))
    return snapshots.snapshot_changes(rows, table(spark, d, "manifest"))


def _loads(spark, d):
    t = {n: table(spark, d, n) for n in ("claims", "unresolved", "nodes", "evidence")}
    return orphans.run_loads(orphans.references(t["claims"], t["unresolved"]), orphans.parents(t["nodes"], t["evidence"]))


def p6_found(spark, d):
    return _loads(spark, d)[0].found()


def p6_counts(spark, d):
    return p6_found(spark, d).groupBy("table_name", "field_name", "ref_state", "load_month").agg(F.count("*").alias("n_references"))


def p6_load_counts(spark, d):
    return _loads(spark, d)[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_second_containers, p2_found, p2_instants, p3_found, p3_node_results, p3_type_results, p4_found, p5_found,
                                   p6_found, p6_counts, p6_load_counts)}
S = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_c = f"(select {S.format('claim_id')} id, min({S.format('subject')}) subject, min({S.format('object')}) object from claims group by 1)"
_null = lambda c: f"nullif({S.format(c)}, '')"
_ok = f"upper({S.format('review_status')}) in ('AUTO_VERIFIED', 'HUMAN_APPROVED') and upper({S.format('assertion_kind')}) <> 'INFERRED'"
_tree = f"""with recursive d as (select {_null('object')} c, {_null('subject')} p from claims where upper({S.format('predicate')}) = 'CONTAINS' and {_ok}),
e as (select c, min(p) p from d where c is not null and p is not null group by 1), n as (select c id from e union select p from e),
t(id, root, depth, path) as (select id, id, 0, [id] from n where id not in (select c from e) union all select e.c, t.root, t.depth + 1, list_append(t.path, e.c) from t join e on e.p = t.id),
h as (select id node_id, root root_id, depth::bigint depth, path from t union all select id, 'CYCLE', -1, null from n where id not in (select id from t))
"""
_c3 = f"(select {S.format('claim_id')} id, min({_null('subject')}) s, min({_null('object')}) o, max(coalesce(len(evidence_ids), 0))::bigint r from claims group by 1)"
_nodes3 = f"""with c as {_c3}, o as (select s node_id, count(*) n, sum(r)::bigint r from c group by 1), i as (select o node_id, count(*) n, sum(r)::bigint r from c group by 1),
ty as (select {S.format('node_id')} node_id, max(struct_pack(l := loaded_at, t := node_type)).t node_type from nodes group by 1),
res as (select coalesce(o.node_id, i.node_id) node_id, coalesce(o.n, 0) n_subject, coalesce(i.n, 0) n_object, coalesce(o.r, 0) refs_subject, coalesce(i.r, 0) refs_object
        from o full join i on o.node_id is not distinct from i.node_id),
p as (select c2.o is not null as x, c1.o node_id, count(*) n, sum(c1.r + c2.r)::bigint r from c c1 join c c2 on c1.o = c2.s group by 1, 2),
q as (select node_id, sum(n)::bigint n, sum(r)::bigint r from p group by 1),
r as (select res.*, ty.node_type, coalesce(q.n, 0) n_two_hop, coalesce(q.r, 0) refs_two_hop from res left join q using (node_id) left join ty using (node_id))
"""
_sums3 = ", ".join(f"sum({c})::bigint {c}" for c in ("n_subject", "n_object", "refs_subject", "refs_object", "n_two_hop", "refs_two_hop"))
ORACLE = {
    "p3_found": f"with c as {_c}, s as (select 'subject' side, subject node_id from c union all select 'object', object from c) "
                "select side, node_id from s where node_id <> '' group by 1, 2 having count(*) >= 0.02 * (select count(*) from c)",
    "p3_node_results": _nodes3 + "select * from r where node_id is not null",
    "p3_type_results": _nodes3 + f"select node_type, grouping(node_type)::int is_total, count(node_id) n_nodes, {_sums3} from r group by rollup (node_type)",
    "p1_found": _tree + "select node_id, root_id, depth from h",
    "p1_hierarchy": _tree + "select node_id, root_id, depth, array_to_string(path, ' > ') path from h",
    "p1_descendants": _tree + "select path[k] ancestor_id, node_id, depth - k + 1 distance from (select *, unnest(range(1, depth + 1)) k from h where depth > 0)",
    "p1_second_containers": f"with d as (select distinct {_null('object')} c, {_null('subject')} p from claims where upper({S.format('predicate')}) = 'CONTAINS' and {_ok}) "
                            "select c node_id, p parent_id from d where c is not null and p > (select min(p) from d e where e.c = d.c)",
}


def _first(t, key, refs):
    return f"select {S.format(key)} id, min(loaded_at) tm, {', '.join(f'min({c}) {c}' for c in refs)} from {t} group by 1"


_claims = _first("claims", "claim_id", ["subject", "object", "evidence_ids"])
_gaps = _first("unresolved", "unresolved_id", ["source_node_id"])
_strip_ref = S.format("ref")
ORACLE["p6_found"] = f"""with c as ({_claims}), u as ({_gaps}), r0 as (
select 'claims' table_name, 'subject' field_name, id record_id, 'n' p, subject ref, tm from c union all select 'claims', 'object', id, 'n', object, tm from c
union all select 'claims', 'evidence_ids', id, 'e', unnest(evidence_ids), tm from c union all select 'unresolved', 'source_node_id', id, 'n', source_node_id, tm from u),
r as (select distinct table_name, field_name, record_id, p, {_strip_ref} ref_id, tm from r0 where {_strip_ref} <> ''),
k as (select 'n' p, {S.format('node_id')} ref_id, loaded_at l, deleted_at d from nodes union all select 'e', {S.format('evidence_id')}, loaded_at, deleted_at from evidence),
j as (select table_name, field_name, record_id, r.ref_id, tm, count(k.l) n, count(*) filter (l <= tm) early, count(*) filter (l <= tm and (d is null or d > tm)) live
from r left join k on k.p = r.p and k.ref_id = r.ref_id group by 1, 2, 3, 4, 5)
select table_name, field_name, record_id, ref_id, case when n = 0 then 'missing' when early > 0 then 'deleted' else 'late' end ref_state, strftime(tm, '%Y-%m') load_month from j where live = 0"""

_sn = lambda t, key, body: (f"select '{t}s' table_name, {S.format('snapshot_id')} snap, {S.format(key)} record_id, delivered_at, {body} body from {t}_snapshots") if t != "evidence" else (
    f"select 'evidence' table_name, {S.format('snapshot_id')} snap, {S.format(key)} record_id, delivered_at, {body} body from evidence_snapshots")
_up = lambda c: f"upper({S.format(c)})"
# a JSON value as the sorted list of its paths, kinds and atoms
_js = ("coalesce((select string_agg(fullkey || '=' || case when type in ('OBJECT', 'ARRAY') then type else coalesce(atom::varchar, 'null') end, chr(1) order by fullkey) "
       "from json_tree(attributes::json)), 'NULL')")
_part = lambda xs: "concat_ws(chr(2), " + ", ".join(f"coalesce(({x})::varchar, chr(3))" for x in xs) + ")"
_bodies = " union all ".join([
    _sn("node", "node_id", _part([_up("node_type"), "name", "list_sort(list_distinct(aliases))", _js])),
    _sn("claim", "claim_id", _part([S.format("subject"), _up("predicate"), S.format("object"), _up("assertion_kind"), _up("review_status"),
                                    f"list_transform(evidence_ids, lambda x: {S.format('x')})"])),
    _sn("evidence", "evidence_id", _part([S.format("revision"), f"regexp_replace(lower({S.format('content_hash')}), '^sha256:', '')"]))])
ORACLE["p5_found"] = f"""with b as ({_bodies}), m as (select {S.format('snapshot_id')} snap, row_number() over (order by min(seq)) i from manifest group by 1),
l as (select table_name, i, record_id, max(struct_pack(d := delivered_at, b := body)).b body from b join m using (snap) group by 1, 2, 3),
st as (select a.snap f, z.snap t, a.i from m a join m z on z.i = a.i + 1),
o as (select table_name, record_id, f, t, body from l join st using (i)), n as (select table_name, record_id, f, t, body from l join st on l.i = st.i + 1)
select table_name, record_id, f from_snapshot, t to_snapshot, case when o.body is null then 'added' when n.body is null then 'removed' else 'changed' end change_kind
from o full join n using (table_name, record_id, f, t) where o.body is distinct from n.body"""
ORACLE["p6_counts"] = f"select table_name, field_name, ref_state, load_month, count(*) n_references from ({ORACLE['p6_found']}) group by 1, 2, 3, 4"
ORACLE |= {"p2_found": time_sql.P2_FOUND, "p2_instants": time_sql.P2_INSTANTS, "p4_found": time_sql.P4_FOUND}

# the state after each yearly load: an orphan waits from its own load on, and is open while no span that is known by then covers the end of the load
ORACLE["p6_load_counts"] = f"""with c as ({_claims}), u as ({_gaps}), r0 as (
select 'claims' table_name, 'subject' field_name, id record_id, 'n' p, subject ref, tm from c union all select 'claims', 'object', id, 'n', object, tm from c
union all select 'claims', 'evidence_ids', id, 'e', unnest(evidence_ids), tm from c union all select 'unresolved', 'source_node_id', id, 'n', source_node_id, tm from u),
r as (select distinct table_name, field_name, record_id, p, {_strip_ref} ref_id, tm from r0 where {_strip_ref} <> ''),
k as (select 'n' p, {S.format('node_id')} ref_id, loaded_at l, deleted_at d from nodes union all select 'e', {S.format('evidence_id')}, loaded_at, deleted_at from evidence),
o as (select r.* from r where tm is not null and not exists (select 1 from k where k.p = r.p and k.ref_id = r.ref_id and l <= tm and (d is null or d > tm))),
t as (select distinct year(x) + 1 y from (select tm x from r union all select l from k) where x is not null), e as (select make_timestamp(y, 1, 1, 0, 0, 0) until from t),
s as (select o.*, until, exists (select 1 from k where k.p = o.p and k.ref_id = o.ref_id and l < until and l <= until - interval 1 microsecond and (d is null or d > until - interval 1 microsecond)) live
  from o join e on tm < until),
w as (select *, lag(live) over (partition by table_name, field_name, record_id, ref_id order by until) was from s),
v as (select *, sum(case when was and not live then 1 else 0 end) over (partition by table_name, field_name, record_id, ref_id order by until) again from w)
select strftime(until, '%Y-%m-%d') until, table_name, field_name, count(*) n_orphans, count(*) filter (not live) n_open, count(*) filter (live) n_resolved, count(*) filter (again > 0) n_reopened from v group by 1, 2, 3"""
