"""From workflow sources to a snapshot: identities, resolved sensors, the promotion gate and the report."""
import hashlib
import json
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions.canonical import quoted, stable_id
from ..sources import dags, jsonl
from ..sources.files import python_files
from ..sources.jsonl import BundleError
from ..sources.tables import materialise
from . import gates

EXTRACTOR = "groundline-dag-reader-1"
EMPTY_LIST = "array<string>"


def namespace_ok(namespace: str) -> str:
    """The namespace, if it is an urn:, http: or https: address without white space."""
    if not namespace or urlsplit(namespace).scheme not in ("urn", "http", "https") or any(map(str.isspace, namespace)):
        raise BundleError("the namespace must be an urn: or https: address of your own")
    return namespace


def _object(**columns):
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(columns.items())]))


class Extraction:
    """Facts of all files with ids, as tables: dags, tasks, edges, sensors, gaps, evidence. Candidates stay apart from what promote() accepts."""

    def __init__(self, spark, source, namespace: str):
        self.spark, self.namespace = spark, namespace_ok(namespace)
        self.files = materialise(python_files(spark, source).repartition(64, "path"))
        self.revision = dags.source_revision(self.files)
        self.facts = materialise(self._named(dags.extracted(self.files)))
        self._unique("dag", ["dag"], "the DAG identity {} is not unique; narrow the source to one deployment")
        self._unique("task", ["dag", "task"], "the task {} is not unique in its DAG; nothing was written")

    def identifier(self, kind: str, *parts):
        """An address below the namespace, its parts percent-quoted."""
        return F.concat(F.lit(self.namespace.rstrip("/:") + f"/{kind}/"), F.concat_ws("/", *[quoted(p) for p in parts]))

    def _named(self, d: DataFrame) -> DataFrame:
        locator = F.concat(F.lit("L"), "line", F.lit("-L"), "last_line")
        e = stable_id("evidence", repository=F.lit(self.namespace), revision=F.lit(self.revision), path=F.col("path"), locator=locator, content_hash=F.col("sha256"))
        node = lambda d, t: F.when(F.col(t).isNotNull(), self.identifier("task", F.col(d), F.col(t))).when(F.col(d).isNotNull(), self.identifier("dag", F.col(d)))
        return d.withColumns({"locator": locator, "evidence_id": e, "node_id": node("dag", "task"), "other_id": node("other_dag", "other_task")})

    def _unique(self, kind, keys, words):
        twice = self.of(kind).groupBy(*keys).count().filter("count > 1").limit(1).collect()
        if twice:
            raise BundleError(words.format(".".join(twice[0][k] for k in keys)))

    def of(self, kind: str) -> DataFrame:
        return self.facts.filter(F.col("kind") == kind)

    def candidates(self) -> DataFrame:
        """subject, predicate, object, rule, evidence_id, path, seq: memberships, dependencies and resolved sensors, none accepted yet."""
        row = lambda d, s, p, o, rule: d.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), rule.alias("rule"), "evidence_id", "path", "seq")
        tasks = self.of("task")
        member = row(tasks, self.identifier("dag", F.col("dag")), "CONTAINS", F.col("node_id"), F.lit("dag-task"))
        found = self.sensors().filter("target_id is not null")
        return member.unionByName(row(self.of("edge"), F.col("node_id"), "NEXT", F.col("other_id"), F.col("rule"))).unionByName(
            row(found, F.col("node_id"), "WAITS_FOR", F.col("target_id"), F.lit("external-task")))

    def sensors(self) -> DataFrame:
        s = self.of("sensor").select("node_id", "evidence_id", "path", "seq", F.col("other_dag").alias("dag"), F.col("other_task").alias("task"))
        return gates.resolved_sensors(s, self.of("task").select("dag", "task", "node_id"))

    def gaps(self) -> DataFrame:
        """source_node_id, reason, evidence_id: what was not read, also sensors without target; without a DAG the source as a whole stands for it."""
        own = self.of("gap").select(F.coalesce("node_id", self.identifier("repository", F.lit("source"))).alias("source_node_id"), F.col("detail").alias("reason"), "evidence_id")
        return own.unionByName(self.sensors().filter("target_id is null").select(F.col("node_id").alias("source_node_id"), F.lit(dags.SENSOR).alias("reason"), "evidence_id"))

    def nodes(self) -> DataFrame:
        none = F.array().cast(EMPTY_LIST)
        row = lambda d, kind, name, attributes: d.select("node_id", F.lit(kind).alias("node_type"), name.alias("name"), none.alias("aliases"), attributes.alias("attributes"))
        d = row(self.of("dag"), "Orchestrator", F.col("dag"), _object(repository=F.lit(self.namespace), source_path=F.col("path"), schedule=F.col("detail")))
        t = row(self.of("task"), "Task", F.col("task"), _object(orchestrator=self.identifier("dag", F.col("dag")), operator=F.col("detail"), source_path=F.col("path")))
        whole = self.gaps().select(F.col("source_node_id").alias("node_id")).filter(F.col("node_id") == self.identifier("repository", F.lit("source"))).limit(1)
        return d.unionByName(t).unionByName(row(whole, "Repository", F.lit("source"), F.lit("{}")))

    def evidence(self) -> DataFrame:
        return self.facts.filter("kind <> 'file'").select(
            "evidence_id", F.lit("source").alias("source_type"), F.lit(self.namespace).alias("source_name"), F.lit(self.revision).alias("revision"), "path", "locator",
            F.concat(F.lit("sha256:"), "sha256").alias("content_hash"), F.lit(EXTRACTOR).alias("extractor"), F.lit(None).cast("string").alias("environment"),
            F.lit('{"locator_verified":true}').alias("attributes")).dropDuplicates(["evidence_id"])

    def promote(self) -> Bundle:
        """A bundle of the candidates, if all pass: the rule may claim its predicate, both ends and the evidence exist, dependencies run between
        tasks, and NEXT stays within its DAG. One that fails raises. Of candidates with one id the last counts."""
        nodes, evidence = materialise(self.nodes()), materialise(self.evidence())
        rules = self.spark.createDataFrame(list(gates.RULES.items()), "rule string, allowed string")
        c = self.candidates()
        wrong = c.join(F.broadcast(rules), "rule", "left").filter(~F.col("predicate").eqNullSafe(F.col("allowed"))).limit(1).collect()
        scope = json.dumps({"namespace": self.namespace, "revision": self.revision}, sort_keys=True, separators=(",", ":"))
        table = [(p, gates.RELATIONS[p][0], gates.RELATIONS[p][1], gates.RELATIONS[p][2]) for p in sorted(set(gates.RULES.values()))]
        rel = self.spark.createDataFrame(table, "predicate string, category string, direction string, in_lineage boolean")
        d = c.join(F.broadcast(rel), "predicate").select(
            "subject", "predicate", "object", F.lit("DECLARED").alias("assertion_kind"), F.lit("AUTO_VERIFIED").alias("review_status"), F.array("evidence_id").alias("evidence_ids"), F.lit(scope).alias("scope"),
            _object(lineage_orientation=F.col("direction"), include_in_lineage=F.col("in_lineage"), relation_category=F.col("category"), verifier=F.lit(EXTRACTOR), rule=F.col("rule")).alias("attributes"),
            F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), "path", "seq").withColumn("claim_id", jsonl.claim_id())
        columns = ["subject", "predicate", "object", "assertion_kind", "review_status", "evidence_ids", "scope", "attributes", "valid_from", "valid_to"]
        claims = materialise(d.groupBy("claim_id").agg(F.max_by(F.struct(*columns), F.struct("path", "seq")).alias("s")).select("claim_id", "s.*"))
        ends = gates.missing_ends(claims, nodes).limit(1).collect()
        kinds = gates.endpoint_gate(claims, nodes).limit(1).collect()
        blind = gates.unverified(claims, evidence).limit(1).collect()
        for bad, word in ((wrong, "its rule may not claim its predicate"), (ends, "an end is no node"), (kinds, "its ends are not tasks of one DAG"), (blind, "its evidence is not verified")):
            if bad:
                raise BundleError(f"a candidate failed the gate: {word}")
        u = self.gaps().select(stable_id("unresolved", source=F.col("source_node_id"), evidence=F.col("evidence_id"), reason=F.col("reason")).alias("unresolved_id"), "source_node_id", "reason",
                               F.lit("unresolved-control-flow").alias("target_hint"), F.array("evidence_id").alias("evidence_ids"), F.lit("{}").alias("attributes")).dropDuplicates(["unresolved_id"])
        u = materialise(u)
        used = claims.select(F.explode("evidence_ids").alias("evidence_id")).union(u.select(F.explode("evidence_ids"))).distinct()
        return Bundle(self.spark, nodes, materialise(evidence.join(used, "evidence_id", "left_semi")), claims, u)

    def report(self, bundle: Bundle) -> dict:
        kinds = {r[0]: r[1] for r in self.facts.groupBy("kind").count().collect()}
        return {"files_scanned": self.files.count(), "workflow_files": kinds.get("file", 0), "dags": kinds.get("dag", 0), "tasks": kinds.get("task", 0), "candidates": bundle.claims.count(),
                "unresolved": bundle.unresolved.count(), "scope": "declared-control-flow-only", "source_revision": self.revision}


def build(spark, source, out, namespace: str) -> dict:
    """Extracts, promotes, writes and loads again; the state of health with the report of the extraction. (candidates counts what was promoted.)"""
    x = Extraction(spark, source, namespace)
    if x.of("dag").isEmpty():
        raise BundleError("no DAG with a literal identity was found; give a folder of DAG sources")
    bundle = x.promote()
    digest = lambda v: "sha256:" + hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    counts = x.report(bundle)
    bundle.write(out, metadata={"project": namespace, "source_revision": x.revision, "adapter": EXTRACTOR, "source_files": counts["files_scanned"], "workflow_files": counts["workflow_files"], "ontology": {
        "name": "groundline-control-flow", "version": "1", "entities_sha256": digest({t: gates.ENTITY_TYPES[t] for t in ("Repository", "Orchestrator", "Task")}),
        "relations_sha256": digest({p: gates.RELATIONS[p] for p in sorted(set(gates.RULES.values()))})}})
    return Bundle.load(spark, out).doctor() | {"extraction": counts}


def reasons(bundle: Bundle) -> DataFrame:
    """kind, name, n: histograms of the predicates of claims and the reasons of gaps."""
    parts = [bundle.claims.select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name")), bundle.unresolved.select(F.lit("reason").alias("kind"), F.col("reason").alias("name"))]
    return reduce(DataFrame.union, parts).groupBy("kind", "name").agg(F.count("*").alias("n"))
