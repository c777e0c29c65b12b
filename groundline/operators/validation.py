"""Rules a snapshot must hold, each as rows of rule, severity, record_id and message."""
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accepted, strip
from .traversal import json_flag

# Kinds and statuses of claims, and names of revisions that move.
KINDS = ["DECLARED", "OBSERVED", "INFERRED", "HUMAN_APPROVED"]
STATUSES = ["AUTO_VERIFIED", "CANDIDATE", "HUMAN_APPROVED", "REJECTED"]
MOVING = ["current", "develop", "dev", "head", "latest", "main", "master", "prd", "prod", "production", "stage", "stg", "tip", "trunk", "working-tree"]
HASH = r"^(?:sha256:)?[0-9a-fA-F]{64}$"
TABLES = {"node": ("nodes", "node_id"), "evidence": ("evidence", "evidence_id"), "claim": ("claims", "claim_id"), "unresolved": ("unresolved", "unresolved_id")}


def pinned(c):
    """Whether a revision text cannot move: a hash, or a text with a digit that is no branch name; null is not pinned."""
    v = strip(c)
    low = F.lower(v)
    moves = (v == "") | low.isin(MOVING) | low.rlike("^(?:refs/heads/|origin/|remotes/)")
    return F.coalesce(~moves & (v.rlike(r"^[0-9a-fA-F]{7,64}$") | v.rlike(HASH) | v.rlike(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")), F.lit(False))


def portable(path):
    """Whether an evidence path stays within its repository under both path syntaxes."""
    outside = path.rlike(r"^/") | path.rlike(r"^(?:[A-Za-z]:[\\/]|[\\/]{2})") | F.array_contains(F.split(path, r"[\\/]"), "..")
    return ~F.coalesce(outside, F.lit(False))


def local_path(text):
    """Whether a text is, or holds, a path of one machine."""
    return (strip(text).rlike(r"^/|^[A-Za-z]:[\\/]|^[\\/]{2}[^\\/]+[\\/]") | text.rlike(r"(?<![A-Za-z0-9_.-])/(?:Users|home)/[^/\s]+(?:/|$)|(?<![A-Za-z0-9_.-])/private/(?:tmp|var)(?:/|$)")
            | text.rlike(r"(?i)(?<![A-Za-z0-9_.-])[A-Z]:[\\/]Users[\\/][^\\/\s]+(?:[\\/]|$)"))


def _rows(d: DataFrame, rule: str, key: str, message, severity: str = "ERROR") -> DataFrame:
    return d.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(key).alias("record_id"), message.alias("message"))


def _no_id(c):
    return F.coalesce((strip(c) == "") | F.col(c).rlike(r"(?U)\s"), F.lit(True))


def _blank(c):
    return F.coalesce(strip(c) == "", F.lit(True))


def _repeats(c):
    return F.coalesce(F.size(F.array_distinct(c)) < F.size(c), F.lit(False))


def record_faults(r) -> DataFrame:
    """V1: the rules a record must hold by itself, one row for each that it breaks."""
    conf = F.get_json_object("attributes", "$.confidence").try_cast("double")
    revision = F.get_json_object("scope", "$.revision")
    checks = {
        "node": [(_no_id("node_id"), "node_id is missing or holds white space"), (_blank("node_type"), "node_type is required"), (_blank("name"), "name is required"),
                 (F.coalesce(F.array_contains("aliases", F.col("node_id")), F.lit(False)), "an alias equals the node's own id"), (_repeats("aliases"), "aliases repeat")],
        "evidence": [(_no_id("evidence_id"), "evidence_id is missing or holds white space"), (_blank("source_type"), "source_type is required"), (_blank("source_name"), "source_name is required"),
                     (~pinned("revision"), "revision can move"), (_blank("path"), "path is required"), (_blank("locator"), "locator is required"),
                     (~F.coalesce(F.col("content_hash").rlike(HASH), F.lit(False)), "content_hash is no SHA-256")],
        "claim": [(_no_id("claim_id"), "claim_id is missing or holds white space"), (_no_id("subject"), "subject is missing or holds white space"), (_no_id("object"), "object is missing or holds white space"),
                  (F.coalesce(F.col("subject") == F.col("object"), F.lit(False)), "subject and object are one node"), (_blank("predicate"), "predicate is required"),
                  (~F.coalesce(F.col("assertion_kind").isin(KINDS), F.lit(False)), "assertion_kind is unknown"), (~F.coalesce(F.col("review_status").isin(STATUSES), F.lit(False)), "review_status is unknown"),
                  (F.coalesce(~conf.between(0, 1), F.lit(False)), "confidence is outside 0 to 1"), (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "no evidence is named"),
                  (_repeats("evidence_ids"), "evidence_ids repeat"), (revision.isNotNull() & ~pinned(revision), "the revision of the scope can move")],
        "unresolved": [(_no_id("unresolved_id"), "unresolved_id is missing or holds white space"), (_no_id("source_node_id"), "source_node_id is missing or holds white space"),
                       (_blank("reason"), "reason is required"), (_repeats("evidence_ids"), "evidence_ids repeat")],
    }
    parts = []
    for label, cs in checks.items():
        t, key = TABLES[label]
        faults = F.array_compact(F.array(*[F.when(bad, F.lit(f"invalid {label} record: {text}")) for bad, text in cs]))
        parts.append(getattr(r, t).select(F.col(key).alias("record_id"), F.explode(faults).alias("message")).select(F.lit("V1").alias("rule"), F.lit("ERROR").alias("severity"), "record_id", "message"))
    return reduce(DataFrame.unionByName, parts)


def duplicate_ids(d: DataFrame, key: str) -> DataFrame:
    """key, n_rows of ids that stand on several rows."""
    return d.groupBy(key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def missing(refs: DataFrame, ref: str, parents: DataFrame, key: str) -> DataFrame:
    """refs whose `ref` is no key of parents."""
    return refs.filter(F.col(ref).isNotNull()).join(parents.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def missing_endpoints(r) -> DataFrame:
    """claim_id, side, node_id: ends of claims that no node has."""
    ends = r.claims.select("claim_id", F.explode(F.create_map(F.lit("subject"), F.col("subject"), F.lit("object"), F.col("object"))).alias("side", "node_id"))
    return missing(ends, "node_id", r.nodes, "node_id").select("claim_id", "side", "node_id")


def missing_evidence(d: DataFrame, key: str, evidence: DataFrame) -> DataFrame:
    """key, evidence_id: references to evidence that is not there (for claims or unresolved records)."""
    refs = d.select(key, F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    return missing(refs, "evidence_id", evidence, "evidence_id").select(key, "evidence_id")


def used_evidence(r) -> DataFrame:
    """evidence_id of all references of claims and unresolved records."""
    return r.claims.select(F.explode("evidence_ids").alias("evidence_id")).union(r.unresolved.select(F.explode("evidence_ids"))).filter("evidence_id is not null").distinct()


def unused_evidence(r) -> DataFrame:
    return r.evidence.join(used_evidence(r), "evidence_id", "left_anti").select("evidence_id")


def duplicate_edges(claims: DataFrame) -> DataFrame:
    """subject, predicate, object, previous_id, claim_id: each further accepted claim of an edge, with the one before it by id."""
    w = Window.partitionBy("subject", "predicate", "object").orderBy("claim_id")
    d = claims.filter(accepted()).select("subject", "predicate", "object", F.lag("claim_id").over(w).alias("previous_id"), "claim_id")
    return d.filter("previous_id is not null")


def messages(r) -> DataFrame:
    """All rows of V1 to V8, V10, V11 (ERROR) and W1, W2 (WARNING)."""
    text = lambda *xs: F.concat_ws("", *[F.lit(x) if isinstance(x, str) else x for x in xs])
    c = F.col
    out = [record_faults(r)]
    for label, (t, key) in TABLES.items():
        out.append(_rows(duplicate_ids(getattr(r, t), key), "V2", key, text(f"duplicate {label} id ", c(key))))
    out.append(_rows(missing_endpoints(r), "V3", "claim_id", text("claim ", c("claim_id"), " has no ", c("side"), " node ", c("node_id"))))
    out.append(_rows(missing_evidence(r.claims, "claim_id", r.evidence), "V4", "claim_id", text("claim ", c("claim_id"), " names missing evidence ", c("evidence_id"))))
    ok = r.claims.filter(accepted())
    straight = F.coalesce(F.get_json_object("attributes", "$.lineage_orientation").isin("subject_to_object", "object_to_subject"), F.lit(False))
    out.append(_rows(ok.filter(~straight), "V5", "claim_id", text("accepted claim ", c("claim_id"), " has no lineage_orientation")))
    out.append(_rows(ok.filter(json_flag("attributes", "$.include_in_lineage").isNull()), "V6", "claim_id", text("accepted claim ", c("claim_id"), " has no boolean include_in_lineage")))
    out.append(_rows(duplicate_edges(r.claims), "V7", "claim_id", text("duplicate accepted edge ", c("subject"), " ", c("predicate"), " ", c("object"), ": ", c("previous_id"), ", ", c("claim_id"))))
    out.append(_rows(r.evidence.filter(~portable(c("path"))), "V8", "evidence_id", text("evidence ", c("evidence_id"), " has a path outside its repository")))
    out.append(_rows(missing(r.unresolved, "source_node_id", r.nodes, "node_id"), "V10", "unresolved_id", text("unresolved ", c("unresolved_id"), " has no source node ", c("source_node_id"))))
    out.append(_rows(missing_evidence(r.unresolved, "unresolved_id", r.evidence), "V11", "unresolved_id", text("unresolved ", c("unresolved_id"), " names missing evidence ", c("evidence_id"))))
    out.append(_rows(unused_evidence(r), "W1", "evidence_id", text("unused evidence ", c("evidence_id")), "WARNING"))
    none = r.claims.agg(F.coalesce(F.bool_or(F.coalesce(accepted(), F.lit(False))), F.lit(False)).alias("some")).filter("not some")
    out.append(none.select(F.lit("W2").alias("rule"), F.lit("WARNING").alias("severity"), F.lit(None).cast("string").alias("record_id"), F.lit("no claim is accepted; traversal will answer UNKNOWN").alias("message")))
    return reduce(DataFrame.unionByName, out)


def review_queue(claims: DataFrame) -> DataFrame:
    """Claims that are neither accepted nor rejected."""
    return claims.filter(~F.coalesce(accepted(), F.lit(False)) & ~F.coalesce(F.upper(strip("review_status")) == "REJECTED", F.lit(False)))


def counts(r) -> DataFrame:
    """metric, value: the numbers of records, accepted claims and claims to review; one pass over each table."""
    yes = F.coalesce(accepted(), F.lit(False))
    c = r.claims.agg(F.count("*").alias("claims"), F.count_if(yes).alias("accepted_claims"),
                     F.count_if(~yes & ~F.coalesce(F.col("review_status") == "REJECTED", F.lit(False))).alias("review_queue"))
    c = c.select(F.explode(F.create_map(*[x for n in c.columns for x in (F.lit(n), F.col(n))])).alias("metric", "value"))
    return reduce(DataFrame.unionByName, [c, *[getattr(r, t).agg(F.count("*").alias("value")).select(F.lit(t).alias("metric"), "value") for t in ("nodes", "evidence", "unresolved")]])


def all_evidenced(claims: DataFrame) -> bool:
    """Whether every accepted claim names evidence; true without accepted claims."""
    return bool(claims.filter(accepted()).agg(F.coalesce(F.bool_and(F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0), F.lit(True))).first()[0])
