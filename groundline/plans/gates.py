"""Gates between candidates and accepted records, as tables of what fails, and the vocabularies they look at."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import with_overrides
from ..functions.text import strip
from ..operators.traversal import json_flag

FORWARD, BACK = "subject_to_object", "object_to_subject"
# The default vocabulary. Each type with the fields that identify it.
ENTITY_TYPES = {
    "Repository": ["name"], "Environment": ["name"], "Orchestrator": ["repository", "name"], "Task": ["orchestrator", "name"], "Job": ["environment", "name"],
    "Service": ["repository", "name"], "Queue": ["environment", "name"], "Trigger": ["environment", "kind", "name"], "LogicalDataset": ["domain", "name"],
    "PhysicalDataset": ["environment", "platform", "namespace", "name"], "Column": ["dataset", "name"], "DataContract": ["domain", "name"], "MessageContract": ["producer", "consumer", "name"],
    "MarkerContract": ["producer", "name"], "ArgumentContract": ["producer", "consumer", "name"], "Invariant": ["domain", "name"], "SLA": ["domain", "name"],
    "LifecycleAssertion": ["subject", "environment", "valid_from"], "Decision": ["repository", "name", "date"], "Migration": ["repository", "name"], "Incident": ["environment", "name", "date"]}
# Each predicate with its category, the direction of dependency and whether it counts in lineage.
RELATIONS = {
    "CONTAINS": ("structural", FORWARD, False), "SCHEDULES": ("control", FORWARD, True), "TRIGGERS": ("control", FORWARD, True), "STARTS": ("control", FORWARD, True),
    "INVOKES": ("control", FORWARD, True), "ENQUEUES_TO": ("control", FORWARD, True), "CONSUMES": ("control", BACK, True), "NEXT": ("control", FORWARD, True),
    "WAITS_FOR": ("control", BACK, True), "READS_FROM": ("data", BACK, True), "WRITES_TO": ("data", FORWARD, True), "TRANSFORMS": ("data", FORWARD, True),
    "MATERIALIZES_AS": ("data", FORWARD, True), "EMITS": ("contract", FORWARD, True), "REQUIRES": ("contract", BACK, True), "GATED_BY": ("contract", BACK, True),
    "OWNED_BY": ("ownership", FORWARD, False), "DEPLOYED_IN": ("deployment", FORWARD, False), "REPLACES": ("evolution", FORWARD, False), "COEXISTS_WITH": ("evolution", FORWARD, False),
    "VALIDATED_BY": ("evolution", FORWARD, False)}
# The rules of extraction and the predicate each may claim.
RULES = {"dag-task": "CONTAINS", "bitshift": "NEXT", "taskflow-input": "NEXT", "set-dependency": "NEXT", "external-task": "WAITS_FOR"}


def entity_table(spark, types: dict | None = None) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in (types or ENTITY_TYPES).items()], "node_type string, identity array<string>")


def relation_table(spark, relations: dict | None = None) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in (relations or RELATIONS).items()], "predicate string, category string, direction string, in_lineage boolean")


def identity_gate(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """node_id, node_type, missing: nodes of a type the vocabulary lacks (missing null) or without some of its identifying fields."""
    def there(f):
        return F.when(f == "name", strip("name")).otherwise(strip(F.call_function("get_json_object", F.col("attributes"), F.concat(F.lit("$."), f))))
    d = nodes.join(F.broadcast(types), "node_type", "left")
    gone = F.filter("identity", lambda f: F.coalesce(there(f) == "", F.lit(True)))
    return d.withColumn("missing", gone).filter(F.col("identity").isNull() | (F.size("missing") > 0)).select("node_id", "node_type", F.array_join("missing", ",").alias("missing"))


def unknown_predicates(claims: DataFrame, relations: DataFrame) -> DataFrame:
    return claims.join(F.broadcast(relations), "predicate", "left_anti")


def by_vocabulary(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """claims with lineage_orientation, include_in_lineage and relation_category of their predicate put into the attributes."""
    d = claims.join(F.broadcast(relations), "predicate", "left")
    more = F.to_json(F.struct(F.col("direction").alias("lineage_orientation"), F.col("in_lineage").alias("include_in_lineage"), F.col("category").alias("relation_category")))
    return d.withColumn("attributes", with_overrides("attributes", more)).select(*claims.columns)


def ontology_gate(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """claim_id, predicate, problem: claims whose predicate is unknown, or whose own attributes say otherwise than the vocabulary."""
    d = claims.join(F.broadcast(relations), "predicate", "left")
    flag, said = json_flag("attributes", "$.include_in_lineage"), F.get_json_object("attributes", "$.lineage_orientation")
    problem = (F.when(F.col("direction").isNull(), "unknown predicate").when(said.isNotNull() & (said != F.col("direction")), "other orientation")
               .when(flag.isNotNull() & (flag != F.col("in_lineage")), "other lineage flag"))
    return d.withColumn("problem", problem).filter("problem is not null").select("claim_id", "predicate", "problem")


def unverified(claims: DataFrame, evidence: DataFrame, status: str = "AUTO_VERIFIED") -> DataFrame:
    """claim_id, evidence_id: evidence of claims of the status that is missing, or whose locator_verified is not the JSON value true."""
    refs = claims.filter(F.col("review_status") == status).select("claim_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    e = evidence.select("evidence_id", F.coalesce(json_flag("attributes", "$.locator_verified"), F.lit(False)).alias("ok"))
    return refs.join(e, "evidence_id", "left").filter(~F.coalesce("ok", F.lit(False))).select("claim_id", "evidence_id")


def collisions(rows: DataFrame, key: str, content) -> DataFrame:
    """key, n_contents: ids that stand for several different contents."""
    return rows.groupBy(key).agg(F.count_distinct(content).alias("n_contents")).filter("n_contents > 1")


def missing_ends(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """claim_id, node_id: ends of claims that no node has."""
    ends = claims.select("claim_id", F.explode(F.array("subject", "object")).alias("node_id"))
    return ends.join(nodes.select("node_id").distinct(), "node_id", "left_anti").select("claim_id", "node_id")


def endpoint_gate(claims: DataFrame, nodes: DataFrame, kind: str = "Task", predicates=("NEXT", "WAITS_FOR"), within: str = "orchestrator") -> DataFrame:
    """claim_id, problem: dependency claims whose ends are missing or of another kind, or whose NEXT leaves its orchestrator."""
    n = nodes.select("node_id", "node_type", F.get_json_object("attributes", f"$.{within}").alias("home"))
    d = claims.filter(F.col("predicate").isin(*predicates)).select("claim_id", "predicate", "subject", "object")
    for side in ("subject", "object"):
        d = d.join(n.select(F.col("node_id").alias(side), F.col("node_type").alias(f"{side}_type"), F.col("home").alias(f"{side}_home")), side, "left")
    problem = (F.when(F.col("subject_type").isNull() | F.col("object_type").isNull(), "missing end").when((F.col("subject_type") != kind) | (F.col("object_type") != kind), "other kind of end")
               .when((F.col("predicate") == "NEXT") & ~F.col("subject_home").eqNullSafe(F.col("object_home")), "other orchestrator"))
    return d.withColumn("problem", problem).filter("problem is not null").select("claim_id", "problem")


def resolved_sensors(sensors: DataFrame, tasks: DataFrame) -> DataFrame:
    """sensors (with dag, task) and target_id, the node_id of the task they wait for; null where it is dynamic or absent."""
    return sensors.join(tasks.select("dag", "task", F.col("node_id").alias("target_id")), ["dag", "task"], "left")
