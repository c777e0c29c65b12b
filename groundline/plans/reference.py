"""Registered queries of the dependency-graph operators, over whole tables."""
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import sources
from ..functions import viewer
from ..functions.canonical import canonical, stable_id
from ..functions.text import accepted, ident
from ..operators import search, validation
from ..operators import traversal as t
from ..records import Records
from ..sources import dags, jsonl
from ..sources.tables import scratch_dir, table
from . import gates, ledger
from . import graph_sql as g

START, END = "urn:tarn:shared:repository:mono-flows", "urn:tarn:shared:logicaldataset:tenant-directory"
TOPK_QUERY, FUZZY_QUERY = "shared ledger job", "ledgr clsoe"


def accepted_claims(spark, d):
    return Records(spark, d).claims.filter(accepted()).select("claim_id", "subject", "predicate", "object")


def claims_by_predicate(spark, d):
    return Records(spark, d).claims.groupBy("predicate").agg(F.count("*").alias("n_claims"))


def unresolved_by_reason(spark, d):
    return Records(spark, d).unresolved.groupBy("reason").agg(F.count("*").alias("n_unresolved"))


def nodes_by_type(spark, d):
    return Records(spark, d).nodes.groupBy("node_type").agg(F.count("*").alias("n_nodes"))


def dup_ids(spark, d):
    return reduce(DataFrame.unionByName, [validation.duplicate_ids(table(spark, d, name).select(ident(key).alias("record_id")), "record_id").withColumn("table_name", F.lit(name))
                                          for name, key in validation.TABLES.values()])


def review_queue(spark, d):
    return validation.review_queue(Records(spark, d).claims).select("claim_id")


def lineage_edges(spark, d):
    return t.lineage_edges(Records(spark, d).claims)


def _walk(spark, d, **how):
    r = Records(spark, d)
    t.check(r.nodes, START, max_hops=4)
    return r, t.traverse(t.lineage_edges(r.claims), START, 4, **how)


def _flat(found, nodes):
    return t.enriched(found, nodes).select("node_id", "node_type", "name", "hops", "via_claim_id", F.array_join("path_nodes", ">").alias("path_nodes"), F.array_join("path_claims", ">").alias("path_claims"))


def downstream_h4(spark, d):
    r, f = _walk(spark, d, cap=None)
    return _flat(f, r.nodes)


def upstream_h4(spark, d):
    r, f = _walk(spark, d, upstream=True, cap=None)
    return _flat(f, r.nodes)


def traversal_capped_500(spark, d):
    r, f = _walk(spark, d)
    return _flat(f, r.nodes)


def traversal_capped_20(spark, d):
    r, f = _walk(spark, d, cap=20)
    return _flat(f, r.nodes)


def downstream_hops_only(spark, d):
    t.check(Records(spark, d).nodes, START, max_hops=4)
    return t.reach(lineage_edges(spark, d), START, 4)


def path_evidence(spark, d):
    r, f = _walk(spark, d)
    return t.packed_paths(f, r.claims).select("node_id", F.col("hops").cast("int").alias("hops"), F.array_join("evidence_ids", ",").alias("evidence_ids"),
                                              F.array_join(F.transform("steps", lambda s: F.concat_ws("|", s["from_node"], s["predicate"], s["to_node"], s["review_status"])), ",").alias("steps"))


def impact_summary(spark, d):
    r, f = _walk(spark, d)
    return t.impact(f, r.nodes)[0]


def impact_by_type(spark, d):
    r, f = _walk(spark, d)
    return t.impact(f, r.nodes)[1]


def unresolved_boundaries(spark, d):
    r, f = _walk(spark, d)
    visited = f.select("node_id").union(spark.createDataFrame([(START,)], "node_id string"))
    return t.boundaries(r.unresolved, visited).select("unresolved_id", "source_node_id", "reason", "target_hint")


def _paths(spark, d, cap):
    r = Records(spark, d)
    t.check(r.nodes, START, END, max_hops=4)
    p, _ = t.shortest_paths(t.lineage_edges(r.claims), START, END, 4, cap)
    return p.select("hops", F.array_join("path_nodes", ">").alias("path_nodes"), F.array_join("path_claims", ">").alias("path_claims"))


def shortest_paths(spark, d):
    return _paths(spark, d, t.PATH_CAP)


def shortest_paths_first(spark, d):
    return _paths(spark, d, 1)


def claim_evidence_lookup(spark, d):
    r = Records(spark, d)
    refs = r.claims.select("claim_id", F.posexplode("evidence_ids").alias("position", "evidence_id"))
    return refs.join(r.evidence.select("evidence_id", "source_name", "revision", "path", "locator"), "evidence_id").select("claim_id", "position", "evidence_id", "source_name", "revision", "path", "locator")


def _tier(spark, d, query, keep):
    return search.scored(Records(spark, d).nodes, query, fuzzy=False).filter(keep).select("score", "node_id", "node_type", "name")


def find_exact(spark, d):
    return _tier(spark, d, "Mono-Flows", "score = 100").unionByName(_tier(spark, d, START, "score = 100"))


def find_prefix(spark, d):
    return _tier(spark, d, "harbor_", "score = 85")


def find_contains(spark, d):
    return _tier(spark, d, "clean", "score = 70")


def find_token(spark, d):
    return _tier(spark, d, "shared service lantern", "score < 70")


def find_ranked_topk(spark, d):
    return search.find(Records(spark, d).nodes.filter(F.col("node_type").isNotNull()), TOPK_QUERY, limit=25).select("score", "node_id", "node_type", "name")


def find_fuzzy(spark, d):
    return search.scored(Records(spark, d).nodes, FUZZY_QUERY).filter("score < 45").select("score", "node_id", "node_type", "name")


def missing_endpoints(spark, d):
    return validation.missing_endpoints(Records(spark, d))


def missing_evidence(spark, d):
    r = Records(spark, d)
    return validation.missing_evidence(r.claims, "claim_id", r.evidence)


def unresolved_missing_source(spark, d):
    r = Records(spark, d)
    return validation.missing(r.unresolved, "source_node_id", r.nodes, "node_id").select("unresolved_id", "source_node_id")


def unresolved_missing_evidence(spark, d):
    r = Records(spark, d)
    return validation.missing_evidence(r.unresolved, "unresolved_id", r.evidence)


def unused_evidence(spark, d):
    return validation.unused_evidence(Records(spark, d))


def dup_accepted_edges(spark, d):
    return validation.duplicate_edges(Records(spark, d).claims)


def bundle_counts(spark, d):
    return validation.counts(Records(spark, d))


def pinned_revision(spark, d):
    return Records(spark, d).evidence.select("evidence_id", "revision", validation.pinned("revision").alias("is_pinned"))


def evidence_path_portable(spark, d):
    return Records(spark, d).evidence.select("evidence_id", validation.portable(F.col("path")).alias("is_portable"))


def canonical_orientation(spark, d):
    return validation.messages(Records(spark, d)).filter("rule in ('V5', 'V6')").select("rule", "record_id")


def record_faults(spark, d):
    return validation.record_faults(Records(spark, d)).select("record_id", "message")


def validation_messages(spark, d):
    return validation.messages(Records(spark, d).written("nodes", "claims", "evidence", "unresolved")).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def identity_gate(spark, d):
    return gates.identity_gate(Records(spark, d).nodes, gates.entity_table(spark))


def ontology_gate(spark, d):
    return gates.ontology_gate(Records(spark, d).claims, gates.relation_table(spark))


def by_vocabulary(spark, d):
    c = gates.by_vocabulary(Records(spark, d).claims, gates.relation_table(spark))
    return c.select("claim_id", *[F.get_json_object("attributes", f"$.{k}").alias(k) for k in ("lineage_orientation", "include_in_lineage", "relation_category")])


def unverified_evidence(spark, d):
    r = Records(spark, d)
    return gates.unverified(r.claims, r.evidence)


def evidence_collisions(spark, d):
    e = Records(spark, d).evidence
    return gates.collisions(e.withColumn("locus_id", _evidence_locus()), "locus_id", F.struct(*[F.coalesce(c, F.lit("\0")) for c in ("source_type", "extractor", "environment")]))


def _evidence_locus():
    return stable_id("evidence", repository=F.col("source_name"), revision=F.col("revision"), path=F.col("path"), locator=F.col("locator"), content_hash=F.col("content_hash"))


def promotion_gate(spark, d):
    r = Records(spark, d)
    return gates.endpoint_gate(r.claims, r.nodes)


def sensor_resolution(spark, d):
    """WAITS_FOR claims as sensors that name their target by type and name: resolved to its node, or to none."""
    r = Records(spark, d)
    tasks = r.nodes.select(F.col("node_type").alias("dag"), F.col("name").alias("task"), "node_id").groupBy("dag", "task").agg(F.min("node_id").alias("node_id"))
    named = r.nodes.select(F.col("node_id").alias("object"), F.col("node_type").alias("dag"), F.col("name").alias("task"))
    sensors = r.claims.filter("predicate = 'WAITS_FOR'").select("claim_id", "object").join(named, "object", "left").select("claim_id", "dag", "task")
    return gates.resolved_sensors(sensors, tasks).select("claim_id", "target_id")


def stable_evidence_ids(spark, d):
    return Records(spark, d).evidence.select("evidence_id", _evidence_locus().alias("made_id"))


def stable_unresolved_ids(spark, d):
    return Records(spark, d).unresolved.select("unresolved_id", stable_id("unresolved", source_node_id=F.col("source_node_id"), target_hint=F.col("target_hint"), reason=F.col("reason")).alias("made_id"))


def stable_claim_ids(spark, d):
    c = Records(spark, d).claims.withColumn("scope", F.coalesce(canonical("scope"), F.lit("{}")))
    return c.select(F.col("claim_id").alias("given"), *[x for x in c.columns if x != "claim_id"]).select(F.col("given").alias("claim_id"), jsonl.claim_id().alias("made_id"))


def manifest_sources(spark, d):
    return sources("graph-spec", "snapshot:0123456789abcdef", Records(spark, d).evidence)


def used_evidence(spark, d):
    return validation.used_evidence(Records(spark, d))


def _edges_of_an_extractor(spark, d):
    """The claims as an extractor's edges: the relation in lower case, the evidence as source file."""
    return Records(spark, d).claims.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.lower("predicate").alias("relation"), F.lower("assertion_kind").alias("confidence"),
                                           F.get(F.col("evidence_ids"), 0).alias("source_file")).distinct()


def ledger_candidates(spark, d):
    c = ledger.candidate_claims(_edges_of_an_extractor(spark, d), F.col("source_file"), "tables", "0" * 40)
    return c.select("subject_candidate_id", "object_candidate_id", "raw_relation", "proposed_predicate", "assertion_kind", F.array_join("evidence_ids", ",").alias("evidence_ids"), "promotion_eligible")


def dangling_endpoints(spark, d):
    return ledger.dangling(_edges_of_an_extractor(spark, d), Records(spark, d).nodes.select(F.col("node_id").alias("id")))


def ledger_counts(spark, d):
    return ledger_candidates(spark, d).groupBy("raw_relation", "promotion_eligible").agg(F.count("*").alias("n"))


def node_groups(spark, d):
    return Records(spark, d).nodes.select("node_id", viewer.group_of(F.col("node_type")).alias("node_group"), viewer.short(F.col("name"), 12).alias("label"))


def marked_nodes(spark, d):
    return viewer.marked_nodes(Records(spark, d).nodes, "Lantern").select("node_id")


def marked_claims(spark, d):
    return viewer.marked_claims(Records(spark, d).claims, "waits_for").select("claim_id")


def explorer_figures(spark, d):
    return viewer.figures(Records(spark, d))


def shown_boundaries(spark, d):
    return viewer.shown_boundaries(Records(spark, d).unresolved)


def _through_lines(spark, d, kind):
    """The records written as JSON lines and read again through the loader's rules."""
    path = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    jsonl.lines(getattr(Records(spark, d), kind)).write.text(path)
    return jsonl.normalised(jsonl.read_lines(spark, path), kind)


def jsonl_nodes(spark, d):
    return _through_lines(spark, d, "nodes").select("node_id", "node_type", "name", F.array_join("aliases", ",").alias("aliases"))


def jsonl_claims(spark, d):
    return _through_lines(spark, d, "claims").select("claim_id", "subject", "predicate", "object", "assertion_kind", "review_status", F.array_join("evidence_ids", ",").alias("evidence_ids"), "valid_to")


def jsonl_evidence(spark, d):
    return _through_lines(spark, d, "evidence").select("evidence_id", "source_type", "source_name", "revision", "path", "locator", "content_hash", "extractor", "environment")


def jsonl_unresolved(spark, d):
    return _through_lines(spark, d, "unresolved").select("unresolved_id", "source_node_id", "reason", "target_hint", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def dag_extract(spark, d):
    """The code cells of the notebooks read as DAG sources: facts by kind and reason."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", F.explode("cells").alias("c")).filter("upper(trim(c.cell_kind)) = 'CODE'")
    code_ = F.expr("substring(text, c.start_pos + 1, c.end_pos - c.start_pos)")
    files = docs.select(F.concat_ws("#", "path", F.col("c.cell_no").cast("string")).alias("path"), F.encode(code_, "UTF-8").alias("content")).withColumn("sha256", F.sha2("content", 256))
    return dags.extracted(files).groupBy("kind", "detail").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    identity_gate, ontology_gate, by_vocabulary, unverified_evidence, evidence_collisions, promotion_gate, sensor_resolution, stable_evidence_ids, stable_unresolved_ids, stable_claim_ids, manifest_sources,
    used_evidence, ledger_candidates, dangling_endpoints, ledger_counts, node_groups, marked_nodes, marked_claims, explorer_figures, shown_boundaries, jsonl_nodes, jsonl_claims, jsonl_evidence, jsonl_unresolved, dag_extract, accepted_claims, claims_by_predicate, unresolved_by_reason, nodes_by_type, dup_ids, review_queue, lineage_edges, downstream_h4, upstream_h4, traversal_capped_500, traversal_capped_20,
    downstream_hops_only, path_evidence, impact_summary, impact_by_type, unresolved_boundaries, shortest_paths, shortest_paths_first, claim_evidence_lookup, find_exact, find_prefix, find_contains,
    find_token, find_ranked_topk, find_fuzzy, missing_endpoints, missing_evidence, unresolved_missing_source, unresolved_missing_evidence, unused_evidence, dup_accepted_edges, bundle_counts,
    pinned_revision, evidence_path_portable, canonical_orientation, record_faults, validation_messages)}

_R, _ok = g.RECORDS, g.accepted()
_walk_sql = lambda up, cap: g.levels(START, 4, up, cap)
_flat_sql = f" select node_id, node_type, name, {g.PATH_COLUMNS.replace('{start}', START)} from found left join r_nodes using (node_id)"
_down500 = _walk_sql(False, t.FOUND_CAP)
_many = 1 << 60
_dups = " union all ".join(f"select '{n}' table_name, {g.ident(k)} record_id, count(*) n_rows from {n} group by 2 having count(*) > 1" for n, k in validation.TABLES.values())
_pinned = (r"regexp_matches(v, '^[0-9a-fA-F]{7,64}$') or regexp_matches(v, '^(sha256:)?[0-9a-fA-F]{64}$') or regexp_matches(v, '[\p{Nd}]')")
_moving = ", ".join(f"'{x}'" for x in validation.MOVING)
_ev = lambda d, k: f"select {k}, evidence_id from (select distinct {k}, unnest(evidence_ids) evidence_id from {d}) where evidence_id not in (select evidence_id from r_evidence)"
_used = "select unnest(evidence_ids) from r_claims union select unnest(evidence_ids) from r_unresolved"
ORACLE = {
    "accepted_claims": f"{_R} select claim_id, subject, predicate, object from r_claims where {_ok}",
    "claims_by_predicate": f"{_R} select predicate, count(*) n_claims from r_claims group by 1",
    "unresolved_by_reason": f"{_R} select reason, count(*) n_unresolved from r_unresolved group by 1",
    "nodes_by_type": f"{_R} select node_type, count(*) n_nodes from r_nodes group by 1",
    "dup_ids": _dups,
    "review_queue": f"{_R} select claim_id from r_claims where not coalesce({_ok}, false) and review_status is distinct from 'REJECTED'",
    "lineage_edges": f"{g.EDGES} select * from edges",
    "downstream_h4": _walk_sql(False, _many) + _flat_sql,
    "upstream_h4": _walk_sql(True, _many) + _flat_sql,
    "traversal_capped_500": _down500 + _flat_sql,
    "traversal_capped_20": _walk_sql(False, 20) + _flat_sql,
    "downstream_hops_only": _walk_sql(False, _many) + " select node_id, hops from found",
    "path_evidence": _down500 + """, st as (select node_id, hops, i, path[3 * i] claim_id, path[3 * i - 1] to_node, case when i = 1 then '""" + START + """' else path[3 * i - 4] end from_node
        from (select *, unnest(range(1, hops + 1)) i from found)), j as (select * from st join r_claims using (claim_id)),
        ev as (select node_id, string_agg(x, ',' order by x) evidence_ids from (select distinct node_id, unnest(evidence_ids) x from j) group by 1)
        select node_id, hops, any_value(evidence_ids) evidence_ids, string_agg(from_node || '|' || predicate || '|' || to_node || '|' || review_status, ',' order by i) steps
        from (select j.* exclude (evidence_ids), ev.evidence_ids from j left join ev using (node_id)) group by 1, 2""",
    "impact_summary": _down500 + " select count(*) filter (hops = 1) direct, count(*) filter (hops > 1) transitive, count(*) total from found",
    "impact_by_type": _down500 + " select node_type, count(*) n_nodes from found left join r_nodes using (node_id) group by 1",
    "unresolved_boundaries": _down500 + f" select unresolved_id, source_node_id, reason, target_hint from r_unresolved where source_node_id = '{START}' or source_node_id in (select node_id from found)",
    "shortest_paths": g.shortest(START, END, 4, t.PATH_CAP),
    "shortest_paths_first": g.shortest(START, END, 4, 1),
    "claim_evidence_lookup": f"""{_R} select claim_id, i - 1 as position, evidence_id, source_name, revision, path, locator
        from (select claim_id, unnest(range(1, len(evidence_ids) + 1)) i, evidence_ids[i] evidence_id from r_claims) join r_evidence using (evidence_id)""",
    "find_exact": g.find("Mono-Flows", "score = 100") + " union all (" + g.find(START, "score = 100") + ")",
    "find_prefix": g.find("harbor_", "score = 85"),
    "find_contains": g.find("clean", "score = 70"),
    "find_token": g.find("shared service lantern", "score < 70"),
    "find_ranked_topk": g.find(TOPK_QUERY, "node_type is not null") + " order by score desc, node_type, name, node_id limit 25",
    "missing_endpoints": f"""{_R} select * from (select claim_id, 'subject' side, subject node_id from r_claims union all select claim_id, 'object', object from r_claims)
        where node_id is not null and node_id not in (select node_id from r_nodes)""",
    "missing_evidence": f"{_R} {_ev('r_claims', 'claim_id')}",
    "unresolved_missing_source": f"{_R} select unresolved_id, source_node_id from r_unresolved where source_node_id is not null and source_node_id not in (select node_id from r_nodes)",
    "unresolved_missing_evidence": f"{_R} {_ev('r_unresolved', 'unresolved_id')}",
    "unused_evidence": f"{_R} select evidence_id from r_evidence where evidence_id not in (select * from ({_used}) u(x) where x is not null)",
    "dup_accepted_edges": f"""{_R} select * from (select subject, predicate, object, lag(claim_id) over (partition by subject, predicate, object order by claim_id) previous_id, claim_id
        from r_claims where {_ok}) where previous_id is not null""",
    "bundle_counts": f"""{_R} select 'nodes' metric, count(*) "value" from r_nodes union all select 'evidence', count(*) from r_evidence union all select 'unresolved', count(*) from r_unresolved
        union all select 'claims', count(*) from r_claims union all select 'accepted_claims', count(*) from r_claims where {_ok}
        union all select 'review_queue', count(*) from r_claims where not coalesce({_ok}, false) and review_status is distinct from 'REJECTED'""",
    "pinned_revision": f"""{_R} select evidence_id, revision, coalesce(v <> '' and lower(v) not in ({_moving}) and not regexp_matches(lower(v), '^(refs/heads/|origin/|remotes/)') and ({_pinned}), false) is_pinned
        from (select *, revision v from r_evidence)""",
    "evidence_path_portable": f"""{_R} select evidence_id, not coalesce(path[1] = '/' or regexp_matches(path, '^([A-Za-z]:[\\\\/]|[\\\\/]{{2}})')
        or list_contains(string_split_regex(path, '[\\\\/]'), '..'), false) is_portable from r_evidence""",
    "canonical_orientation": f"""{_R} select 'V5' "rule", claim_id record_id from r_claims where {_ok} and coalesce(attributes::json ->> '$.lineage_orientation', '') not in ('subject_to_object', 'object_to_subject')
        union all select 'V6', claim_id from r_claims where {_ok} and coalesce(json_type(attributes::json, '$.include_in_lineage'), '') <> 'BOOLEAN'""",
}

_j = lambda c: f"case when {c} is null then 'null' else to_json({c})::varchar end"
_id = lambda prefix, fields: f"'{prefix}:' || substr(sha256('{{' || " + " || ',' || ".join(f"'\"{k}\":' || {e}" for k, e in sorted(fields.items())) + " || '}'), 1, 24)"
_locus = _id("evidence", {"repository": _j("source_name"), "revision": _j("revision"), "path": _j("path"), "locator": _j("locator"), "content_hash": _j("content_hash")})
_scope = "case when scope is null then '{}' else '{' || array_to_string(list_sort(list_transform(json_keys(scope::json), lambda k: to_json(k)::varchar || ':' || (scope::json -> k)::varchar)), ',') || '}' end"
_types = ", ".join(f"('{k}', {v})" for k, v in gates.ENTITY_TYPES.items())
_rels = ", ".join(f"('{k}', '{c}', '{d}', {str(i).lower()})" for k, (c, d, i) in gates.RELATIONS.items())
_voc = f"rel(predicate, category, direction, in_lineage) as (values {_rels})"
_cand = lambda c: f"'candidate:extractor:' || sha256('tables' || chr(0) || repeat('0', 40) || chr(0) || {c})"
_prop = "case raw " + " ".join(f"when '{k}' then '{v}'" for k, v in ledger.PROPOSED.items()) + " end"
_xe = "xe as (select distinct subject source, object target, lower(predicate) raw, upper(lower(assertion_kind)) kind, evidence_ids[1] f from r_claims)"
_led = f"""{_R}, {_xe} select {_cand('source')} subject_candidate_id, {_cand('target')} object_candidate_id, raw raw_relation, {_prop} proposed_predicate, kind assertion_kind, coalesce(f, '') evidence_ids,
  {_prop} is not null and f is not null promotion_eligible from xe"""
ORACLE |= {
    "identity_gate": f"""{_R}, ty(node_type, identity) as (values {_types}), j as (select n.*, identity, list_filter(identity, lambda k: coalesce(trim(case when k = 'name' then name else attributes::json ->> ('$.' || k) end), '') = '') gone
        from r_nodes n left join ty using (node_type)) select node_id, node_type, array_to_string(gone, ',') missing from j where identity is null or len(gone) > 0""",
    "ontology_gate": f"""{_R}, {_voc}, j as (select *, {g._bool('$.include_in_lineage')} flag, attributes::json ->> '$.lineage_orientation' said from r_claims left join rel using (predicate)),
        k as (select claim_id, predicate, case when direction is null then 'unknown predicate' when said <> direction then 'other orientation' when flag <> in_lineage then 'other lineage flag' end problem from j)
        select * from k where problem is not null""",
    "by_vocabulary": f"""{_R}, {_voc} select claim_id, coalesce(direction, attributes::json ->> '$.lineage_orientation') lineage_orientation,
        coalesce(in_lineage::varchar, attributes::json ->> '$.include_in_lineage') include_in_lineage, coalesce(category, attributes::json ->> '$.relation_category') relation_category from r_claims left join rel using (predicate)""",
    "unverified_evidence": f"""{_R}, ev as (select {g.ident('evidence_id')} evidence_id, max_by(json_type(attributes::json, '$.locator_verified') = 'BOOLEAN' and attributes::json ->> '$.locator_verified' = 'true', loaded_at) ok from evidence group by 1)
        select claim_id, evidence_id from (select distinct claim_id, unnest(evidence_ids) evidence_id from r_claims where review_status = 'AUTO_VERIFIED') left join ev using (evidence_id) where not coalesce(ok, false)""",
    "evidence_collisions": f"""{_R} select {_locus} locus_id, count(distinct (coalesce(source_type, chr(0)), coalesce(extractor, chr(0)), coalesce(environment, chr(0)))) n_contents from r_evidence group by 1
        having count(distinct (coalesce(source_type, chr(0)), coalesce(extractor, chr(0)), coalesce(environment, chr(0)))) > 1""",
    "promotion_gate": f"""{_R}, h as (select node_id, node_type, attributes::json ->> '$.orchestrator' home from r_nodes),
        j as (select claim_id, case when a.node_id is null or b.node_id is null then 'missing end' when a.node_type <> 'Task' or b.node_type <> 'Task' then 'other kind of end'
          when predicate = 'NEXT' and a.home is distinct from b.home then 'other orchestrator' end problem from r_claims left join h a on a.node_id = subject left join h b on b.node_id = object where predicate in ('NEXT', 'WAITS_FOR'))
        select * from j where problem is not null""",
    "sensor_resolution": f"""{_R}, ta as (select node_type, name, min(node_id) target_id from r_nodes group by 1, 2) select claim_id, target_id from r_claims c left join r_nodes n on n.node_id = c.object
        left join ta on ta.node_type = n.node_type and ta.name = n.name where predicate = 'WAITS_FOR'""",
    "stable_evidence_ids": f"{_R} select evidence_id, {_locus} made_id from r_evidence",
    "stable_unresolved_ids": f"{_R} select unresolved_id, " + _id("unresolved", {"source_node_id": _j("source_node_id"), "target_hint": _j("target_hint"), "reason": _j("reason")}) + " made_id from r_unresolved",
    "stable_claim_ids": f"""with r_claims as (select claim_id, unnest(s) from (select {g.ident('claim_id')} claim_id, max_by(struct_pack(subject := {g.ident('subject')}, predicate := {g.code('predicate')}, object := {g.ident('object')},
        assertion_kind := {g.code('assertion_kind')}, scope := scope, valid_from := {g.strip('valid_from')}, valid_to := {g.strip('valid_to')}), loaded_at) s from claims group by 1) where claim_id is not null) select claim_id, """
        + _id("claim", {"subject": _j("subject"), "predicate": _j("predicate"), "object": _j("object"), "assertion_kind": _j("assertion_kind"), "valid_from": _j("valid_from"), "valid_to": _j("valid_to"), "scope": _scope}) + " made_id from r_claims",
    "manifest_sources": f"{_R} select source_name name, revision from r_evidence union select 'graph-spec', 'snapshot:0123456789abcdef'",
    "used_evidence": f"{_R} select * from ({_used}) u(evidence_id) where evidence_id is not null",
    "ledger_candidates": _led,
    "ledger_counts": f"select raw_relation, promotion_eligible, count(*) n from ({_led}) group by 1, 2",
    "dangling_endpoints": f"{_R}, {_xe} select distinct id from (select source id from xe union all select target from xe) where id is not null and id not in (select node_id from r_nodes)",
    "node_groups": f"""{_R} select node_id, case when regexp_matches(node_type, '(?i)dataset|column|table|view') then 'Data' when regexp_matches(node_type, '(?i)contract|marker|invariant|sla') then 'Contract' else 'Resource' end node_group,
        case when length(name) > 12 then substr(name, 1, 9) || '…' else name end as label from r_nodes""",
    "marked_nodes": f"{_R} select node_id from r_nodes where contains(lower(concat_ws(' ', name, node_type, array_to_string(aliases, ' '))), 'lantern')",
    "marked_claims": f"{_R} select claim_id from r_claims where contains(lower(concat_ws(' ', predicate, subject, object)), 'waits_for')",
    "explorer_figures": f"""{_R} select (select count(*) from r_nodes) nodes, (select count(*) from r_evidence) evidence, (select count(*) from r_unresolved) boundaries,
        count(*) filter (coalesce({_ok}, false)) accepted, count(*) filter (not coalesce({_ok}, false)) candidates from r_claims""",
    "shown_boundaries": f"""{_R} select unresolved_id, case when length(l) > 92 then substr(l, 1, 89) || '…' else l end as label from (select *, concat_ws(': ', reason, target_hint) l from r_unresolved) order by unresolved_id limit 200""",
}

_list = lambda c: f"array_to_string(list_filter({c}, lambda x: {g.strip('x')} <> ''), ',')"
ORACLE |= {
    "jsonl_nodes": f"{_R} select node_id, node_type, name, coalesce(array_to_string(list_transform(list_filter(aliases, lambda x: {g.strip('x')} <> ''), lambda x: {g.strip('x')}), ','), '') aliases from r_nodes",
    "jsonl_claims": _R + f", vt as (select {g.ident('claim_id')} claim_id, max_by({g.strip('valid_to')}, loaded_at) valid_to from claims group by 1) "
                    f"select claim_id, subject, predicate, object, assertion_kind, review_status, coalesce({_list('evidence_ids')}, '') evidence_ids, valid_to from r_claims left join vt using (claim_id)",
    "jsonl_evidence": f"""{_R} select evidence_id, source_type, source_name, revision, path, locator, case when starts_with(lower(content_hash), 'sha256:') then lower(content_hash) else 'sha256:' || lower(content_hash) end content_hash,
        extractor, environment from r_evidence""",
    "jsonl_unresolved": f"{_R} select unresolved_id, source_node_id, reason, target_hint, coalesce({_list('evidence_ids')}, '') evidence_ids from r_unresolved",
}
_blank = lambda c: f"coalesce({g.strip(c)} = '', true)"
_noid = lambda c: f"(coalesce({g.strip(c)} = '', true) or regexp_matches({c}, '[\\s\\p{{Z}}]'))"
_rep = lambda c: f"coalesce(len(list_distinct({c})) < len(list_filter({c}, lambda x: x is not null)), false)"
_pin = lambda c: f"coalesce((select v <> '' and lower(v) not in ({_moving}) and not regexp_matches(lower(v), '^(refs/heads/|origin/|remotes/)') and ({_pinned}) from (select {g.strip(c)} v)), false)"
_faults = {
    "node": [(_noid("node_id"), "node_id is missing or holds white space"), (_blank("node_type"), "node_type is required"), (_blank("name"), "name is required"),
             ("coalesce(list_contains(aliases, node_id), false)", "an alias equals the node''s own id"), (_rep("aliases"), "aliases repeat")],
    "evidence": [(_noid("evidence_id"), "evidence_id is missing or holds white space"), *[(_blank(c), f"{c} is required") for c in ("source_type", "source_name", "path", "locator")], (f"not {_pin('revision')}", "revision can move"),
                 ("not coalesce(regexp_matches(content_hash, '^(sha256:)?[0-9a-fA-F]{64}$'), false)", "content_hash is no SHA-256")],
    "claim": [*[(_noid(c), f"{c} is missing or holds white space") for c in ("claim_id", "subject", "object")], ("coalesce(subject = object, false)", "subject and object are one node"), (_blank("predicate"), "predicate is required"),
              ("not coalesce(assertion_kind in ('DECLARED', 'OBSERVED', 'INFERRED', 'HUMAN_APPROVED'), false)", "assertion_kind is unknown"),
              ("not coalesce(review_status in ('AUTO_VERIFIED', 'CANDIDATE', 'HUMAN_APPROVED', 'REJECTED'), false)", "review_status is unknown"),
              ("coalesce(not try_cast(attributes::json ->> '$.confidence' as double) between 0 and 1, false)", "confidence is outside 0 to 1"), ("coalesce(len(evidence_ids), 0) = 0", "no evidence is named"),
              (_rep("evidence_ids"), "evidence_ids repeat"), (f"(scope::json ->> '$.revision') is not null and not {_pin('(scope::json ->> $$$.revision$$)')}", "the revision of the scope can move")],
    "unresolved": [(_noid("unresolved_id"), "unresolved_id is missing or holds white space"), (_noid("source_node_id"), "source_node_id is missing or holds white space"), (_blank("reason"), "reason is required"), (_rep("evidence_ids"), "evidence_ids repeat")],
}
_v1 = " union all ".join(f"select {validation.TABLES[k][1]} record_id, 'invalid {k} record: {m}' message from r_{validation.TABLES[k][0]} where {c}" for k, cs in _faults.items() for c, m in cs)
_part = lambda rule, key, sev="ERROR": f"select '{rule}' \"rule\", '{sev}' severity, count(*) n from ({ORACLE[key]})"
ORACLE |= {
    "record_faults": f"{_R} {_v1}",
}
ORACLE["validation_messages"] = "select * from (" + " union all ".join([
    _part("V1", "record_faults"), _part("V3", "missing_endpoints"), _part("V4", "missing_evidence"), f"select \"rule\", 'ERROR', count(*) from ({ORACLE['canonical_orientation']}) group by 1", _part("V7", "dup_accepted_edges"),
    f"select 'V8', 'ERROR', count(*) from ({ORACLE['evidence_path_portable']}) where not is_portable", _part("V10", "unresolved_missing_source"), _part("V11", "unresolved_missing_evidence"),
    _part("W1", "unused_evidence", "WARNING"), f"select 'W2', 'WARNING', case when count(*) = 0 then 1 else 0 end from ({ORACLE['accepted_claims']})"]) + ") where n > 0"
