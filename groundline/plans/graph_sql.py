"""The SQL that the queries of the dependency graph are checked against."""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def ident(c: str) -> str:
    return f"nullif({strip(c)}, '')"


def code(c: str) -> str:
    return f"upper({strip(c)})"


def accepted(prefix: str = "") -> str:
    return f"{prefix}review_status in ('AUTO_VERIFIED', 'HUMAN_APPROVED') and {prefix}assertion_kind <> 'INFERRED'"


_COLS = {
    "nodes": ("node_id", {"node_type": strip("node_type"), "name": strip("name"), "aliases": "aliases", "attributes": "attributes"}),
    "claims": ("claim_id", {"subject": ident("subject"), "predicate": code("predicate"), "object": ident("object"), "assertion_kind": code("assertion_kind"), "review_status": code("review_status"),
                            "evidence_ids": f"list_transform(evidence_ids, lambda x: {strip('x')})", "scope": "scope", "attributes": "attributes"}),
    "evidence": ("evidence_id", {c: strip(c) for c in ("source_type", "source_name", "revision", "path", "locator", "content_hash", "extractor", "environment")}),
    "unresolved": ("unresolved_id", {"source_node_id": ident("source_node_id"), "reason": strip("reason"), "target_hint": strip("target_hint"),
                                     "evidence_ids": f"list_transform(evidence_ids, lambda x: {strip('x')})"}),
}


def _record(t: str) -> str:
    key, cols = _COLS[t]
    pack = ", ".join(f"{n} := {e}" for n, e in cols.items())
    return (f"r_{t} as materialized (select {key}, unnest(s) from (select {ident(key)} {key}, max_by(struct_pack({pack}), loaded_at) s from {t} group by 1) where {key} is not null)")


RECORDS = "with " + ", ".join(map(_record, _COLS))
_bool = lambda path: f"case when json_type(attributes::json, '{path}') = 'BOOLEAN' then attributes::json ->> '{path}' = 'true' end"
_ori = "lower(coalesce(attributes::json ->> '$.lineage_orientation', ''))"
_rev = "'READS_FROM', 'CONSUMES', 'DEPENDS_ON', 'REQUIRES', 'GATED_BY', 'SUBSCRIBES_TO', 'QUERIES'"
EDGES = RECORDS + f""", e0 as (select *, {_ori} in ('object_to_subject', 'reverse') or ({_ori} not in ('subject_to_object', 'forward') and predicate in ({_rev})) back
  from r_claims where {accepted()} and coalesce({_bool('$.include_in_lineage')}, true)),
edges as materialized (select case when back then object else subject end up, case when back then subject else object end down, claim_id, predicate from e0 where subject is not null and object is not null)"""


def levels(start: str, hops: int, upstream: bool, cap: int) -> str:
    """EDGES and `found`: node_id, hops, path (flat list of predicate, node, claim), level by level."""
    a, b = ("down", "up") if upstream else ("up", "down")
    out = [EDGES, f"l0 as (select '{start}' node_id, []::varchar[] path)", "s0 as (select node_id from l0)", "f0 as (select 0 n)"]
    for h in range(1, hops + 1):
        out.append(f"""c{h} as materialized (select e.{b} node_id, min(list_concat(l.path, [e.predicate, e.{b}, e.claim_id])) path from l{h - 1} l join edges e on e.{a} = l.node_id
  where e.{b} not in (select node_id from s{h - 1}) group by 1)""")
        out.append(f"p{h} as (select path[:{3 * h - 3}] pp, count(*) n from c{h} group by 1)")
        out.append(f"k{h} as (select pp, sum(n) over (order by pp) - n + (select n from f{h - 1}) before from p{h})")
        out.append(f"l{h} as materialized (select c.node_id, c.path from c{h} c join k{h} k on c.path[:{3 * h - 3}] = k.pp where before < {cap})")
        out.append(f"s{h} as materialized (select node_id from s{h - 1} union all select node_id from l{h})")
        out.append(f"f{h} as (select count(*) - 1 n from s{h})")
    out.append("found as (" + " union all ".join(f"select node_id, {h} hops, path from l{h}" for h in range(1, hops + 1)) + ")")
    return ", ".join(out)


PATH_COLUMNS = ("hops, path[-1] via_claim_id, array_to_string(list_prepend('{start}', [path[i] for i in range(2, len(path) + 1, 3)]), '>') path_nodes, "
                "array_to_string([path[i] for i in range(3, len(path) + 1, 3)], '>') path_claims")


def shortest(source: str, target: str, max_hops: int, cap: int) -> str:
    """All shortest paths at whatever length up to max_hops, with the soft cap, by unrolled joins without repeated nodes."""
    out = [EDGES, f"w0 as (select '{source}' node_id, []::varchar[] path)"]
    for h in range(1, max_hops + 1):
        done = " union all ".join(f"select 1 from w{k} where node_id = '{target}'" for k in range(1, h)) or "select 1 where false"
        out.append(f"""w{h} as materialized (select e.down node_id, list_concat(w.path, [e.predicate, e.down, e.claim_id]) path from w{h - 1} w join edges e on e.up = w.node_id
  where not list_contains(w.path, e.down) and e.down <> '{source}' and not exists ({done}))""")
    out.append("hit as (" + " union all ".join(f"select {h} hops, path, path[:{3 * h - 3}] pp from w{h} where node_id = '{target}'" for h in range(1, max_hops + 1)) + ")")
    out.append("pre as (select pp, sum(count(*)) over (order by pp) - count(*) before from hit group by pp)")
    return ", ".join(out) + f""" select hops, array_to_string(list_prepend('{source}', [path[i] for i in range(2, len(path) + 1, 3)]), '>') path_nodes,
  array_to_string([path[i] for i in range(3, len(path) + 1, 3)], '>') path_claims from hit join pre using (pp) where before < {cap}"""


_fields = "list_concat([node_id, name], coalesce(aliases, []))"
_folded = f"list_transform(list_filter({_fields}, lambda x: x is not null), lambda x: lower(x))"


def find(query: str, tiers: str) -> str:
    """score, node_id, node_type, name of the nodes whose tier is among `tiers` (a condition on score)."""
    q = query.lower()
    words = sorted(set(q.replace(":", " ").replace("/", " ").split()))
    toks = f"list_distinct(string_split_regex(trim(regexp_replace(translate(lower(concat_ws(' ', array_to_string({_fields}, ' '), node_type)), ':/', '  '), '\\s+', ' ', 'g')), ' '))"
    return RECORDS + f""", f as (select *, {_folded} fs, len(list_intersect({toks}, {words})) n from r_nodes),
m as (select node_id, node_type, name, case when list_contains(fs, '{q}') then 100.0 when len(list_filter(fs, lambda x: starts_with(x, '{q}'))) > 0 then 85.0
  when len(list_filter(fs, lambda x: contains(x, '{q}'))) > 0 then 70.0 when n > 0 then 45.0 + 5 * least(n, 4) end::double score from f)
select score, node_id, node_type, name from m where score is not null and {tiers}"""
