"""Reach, paths and impact over accepted lineage edges, level by level."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import accepted, code, ident
from ..sources.tables import materialise

# Predicates whose object is upstream of the subject when the claim gives no orientation.
REVERSED = ["READS_FROM", "CONSUMES", "DEPENDS_ON", "REQUIRES", "GATED_BY", "SUBSCRIBES_TO", "QUERIES"]
# Limits of the query surface.
MAX_HOPS, FOUND_CAP, PATH_CAP = 20, 500, 10
BROADCAST_ROWS = 20_000


def json_flag(attributes, path: str):
    """The JSON boolean at path; null where it is absent or of another kind ("false" in quotes is not false)."""
    v = F.try_variant_get(F.try_parse_json(attributes), path, "variant")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.to_json(v) == "true")


def lineage_edges(claims: DataFrame) -> DataFrame:
    """up, down, claim_id, predicate of accepted claims whose include_in_lineage is not the JSON value false."""
    orient = F.lower(F.coalesce(F.get_json_object("attributes", "$.lineage_orientation"), F.lit("")))
    back = orient.isin("object_to_subject", "reverse") | (~orient.isin("subject_to_object", "forward") & code("predicate").isin(REVERSED))
    s, o = ident("subject"), ident("object")
    return (claims.filter(accepted() & F.coalesce(json_flag("attributes", "$.include_in_lineage"), F.lit(True)))
            .select(F.when(back, o).otherwise(s).alias("up"), F.when(back, s).otherwise(o).alias("down"),
                    ident("claim_id").alias("claim_id"), code("predicate").alias("predicate"))
            .filter("up is not null and down is not null and claim_id is not null").distinct())


def check(nodes: DataFrame, *starts: str, max_hops: int = 1) -> None:
    """KeyError for an id that no node has; ValueError for hops outside 1..MAX_HOPS."""
    there = {r[0] for r in nodes.filter(F.col("node_id").isin(*starts)).select("node_id").distinct().collect()}
    for s in starts:
        if s not in there:
            raise KeyError(f"no node has the id {s!r}; look it up by find first")
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"max_hops must be between 1 and {MAX_HOPS}")


def _small(d: DataFrame) -> DataFrame:
    """d with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(d) if d.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else d


def _directed(edges: DataFrame, upstream: bool) -> DataFrame:
    a, b = ("down", "up") if upstream else ("up", "down")
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), "predicate", "claim_id")


def reach(edges: DataFrame, start: str, max_hops: int = 6, upstream: bool = False) -> DataFrame:
    """node_id, hops: each node reached from start, once, at its least distance, however many; start itself is not reported."""
    e = materialise(_directed(edges, upstream).select("a", "b").distinct())
    level = seen = edges.sparkSession.createDataFrame([(start, 0)], "node_id string, hops int")
    for hop in range(1, max_hops + 1):
        nxt = e.join(_small(level.select(F.col("node_id").alias("a"))), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
        level = materialise(nxt.join(_small(seen), "node_id", "left_anti").withColumn("hops", F.lit(hop)))
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen.filter("hops > 0")


def traverse(edges: DataFrame, start: str, max_hops: int = 6, upstream: bool = False, cap: int | None = FOUND_CAP) -> DataFrame:
    """node_id, hops, via_claim_id, path_nodes, path_claims: first discoveries in breadth-first order.

    A node's path is the least of its shortest ones by (predicate, node, claim) of its steps, which is the order of discovery
    within a level too, so no rank over all rows is needed. The cap is soft: a node is expanded as long as fewer than `cap`
    were found before its first new neighbour, and then wholly; None finds all. Per level at most `cap` parents with their
    counts come to the driver.
    """
    e = materialise(_directed(edges, upstream))
    spark = edges.sparkSession
    level = seen = spark.createDataFrame([(start, [])], "node_id string, path array<string>")
    out, found = [], 0
    for hop in range(1, max_hops + 1):
        step = e.join(_small(level.select(F.col("node_id").alias("a"), "path")), "a").select(F.col("b").alias("node_id"), F.concat("path", F.array("predicate", "b", "claim_id")).alias("path"))
        new = materialise(step.join(_small(seen.select("node_id")), "node_id", "left_anti").groupBy("node_id").agg(F.min("path").alias("path")))
        if cap is None:
            if new.isEmpty():
                break
            level = new
            out.append(level.withColumn("hops", F.lit(hop)))
            seen = seen.unionByName(level)
            continue
        parent = F.slice("path", 1, 3 * hop - 3)
        first = new.groupBy(parent.alias("parent")).agg(F.count("*").alias("n")).orderBy("parent").limit(cap - found).collect()
        if not first:
            break
        kept = []
        for r in first:
            if found >= cap:
                break
            kept.append((r.parent,))
            found += r.n
        level = new.join(F.broadcast(spark.createDataFrame(kept, "parent array<string>")), parent == F.col("parent")).drop("parent")
        out.append(level.withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(level)
        if found >= cap:
            break
    if not out:
        return spark.createDataFrame([], "node_id string, hops int, via_claim_id string, path_nodes array<string>, path_claims array<string>")
    every = lambda k: F.filter("path", lambda _, i: i % 3 == k)
    return reduce(DataFrame.unionByName, out).select("node_id", "hops", F.element_at("path", -1).alias("via_claim_id"), F.concat(F.array(F.lit(start)), every(1)).alias("path_nodes"), every(2).alias("path_claims"))


def enriched(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found with the node's type, name and aliases."""
    return found.join(nodes.select("node_id", "node_type", "name", "aliases"), "node_id", "left")


def packed_paths(found: DataFrame, claims: DataFrame, key: str = "node_id") -> DataFrame:
    """key, hops, node_ids, claim_ids, evidence_ids (sorted, distinct over the path), steps: paths with the claims they run over.

    A step holds claim_id, from_node, to_node, subject, predicate, object, evidence_ids, confidence (1.0 where the attributes give none), assertion_kind and review_status.
    """
    steps = found.select(key, "hops", "path_nodes", "path_claims", F.posexplode("path_claims").alias("k", "claim_id"))
    conf = F.coalesce(F.get_json_object("attributes", "$.confidence").try_cast("double"), F.lit(1.0))
    c = claims.select("claim_id", "subject", "predicate", "object", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), conf.alias("confidence"), "assertion_kind", "review_status")
    s = F.struct("k", "claim_id", F.col("path_nodes")[F.col("k")].alias("from_node"), F.col("path_nodes")[F.col("k") + 1].alias("to_node"), "subject", "predicate", "object", "evidence_ids",
                 "confidence", "assertion_kind", "review_status")
    g = steps.join(c, "claim_id").groupBy(key, "hops", F.col("path_nodes").alias("node_ids"), F.col("path_claims").alias("claim_ids")).agg(F.array_sort(F.collect_list(s)).alias("steps"))
    return g.select(key, "hops", "node_ids", "claim_ids", F.array_sort(F.array_distinct(F.flatten("steps.evidence_ids"))).alias("evidence_ids"),
                    F.transform("steps", lambda x: x.dropFields("k")).alias("steps"))


def boundaries(unresolved: DataFrame, visited: DataFrame) -> DataFrame:
    """The unresolved records whose source is among the visited node_id."""
    return unresolved.join(visited.select(F.col("node_id").alias("source_node_id")).distinct(), "source_node_id", "left_semi")


def impact(found: DataFrame, nodes: DataFrame) -> tuple:
    """(direct, transitive, total) as one row, and the number of reached nodes by node_type."""
    summary = found.agg(F.count_if(F.col("hops") == 1).alias("direct"), F.count_if(F.col("hops") > 1).alias("transitive"), F.count("*").alias("total"))
    return summary, enriched(found, nodes).groupBy("node_type").agg(F.count("*").alias("n_nodes"))


def shortest_paths(edges: DataFrame, source: str, target: str, max_hops: int = 8, max_paths: int = PATH_CAP) -> tuple:
    """(paths, explored): all shortest downstream paths as hops, path_nodes, path_claims, and the node_id within their length.

    Distances from the source by levels, then back from the target along edges that lose one, then forward over what is left:
    every prefix there leads to the target, so the first max_paths of a level hold the first max_paths paths and the rest is
    cut at once. Parallel claims count separately; of the last step all claims of a begun prefix count, so the cap is soft.
    """
    spark = edges.sparkSession
    empty = spark.createDataFrame([], "hops int, path_nodes array<string>, path_claims array<string>")
    if source == target:
        return spark.createDataFrame([(0, [source], [])], empty.schema), spark.createDataFrame([(source,)], "node_id string")
    e = materialise(_directed(edges, False))
    levels = [spark.createDataFrame([(source,)], "node_id string")]
    seen, length = levels[0], None
    for hop in range(1, max_hops + 1):
        nxt = e.join(_small(levels[-1].withColumnRenamed("node_id", "a")), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
        levels.append(materialise(nxt.join(_small(seen), "node_id", "left_anti")))
        seen = seen.union(levels[-1])
        if not levels[-1].filter(F.col("node_id") == target).isEmpty():
            length = hop
            break
        if levels[-1].isEmpty():
            break
    if length is None:
        return empty, seen
    useful, kept = spark.createDataFrame([(target,)], "b string"), []
    for hop in range(length, 0, -1):
        s = e.join(_small(useful), "b", "left_semi").join(_small(levels[hop - 1].withColumnRenamed("node_id", "a")), "a", "left_semi")
        kept.append(materialise(s))
        useful = kept[-1].select(F.col("a").alias("b")).distinct()
    paths = spark.createDataFrame([(source, [])], "a string, path array<string>")
    for hop, s in enumerate(reversed(kept), 1):
        nxt = s.join(F.broadcast(paths), "a").select(F.col("b").alias("a"), F.concat("path", F.array("predicate", "b", "claim_id")).alias("path"))
        if hop < length:
            nxt = nxt.orderBy("path").limit(max_paths)
        paths = materialise(nxt)
    parent = F.slice("path", 1, 3 * length - 3)
    begun, total = [], 0
    for r in paths.groupBy(parent.alias("parent")).agg(F.count("*").alias("n")).orderBy("parent").limit(max_paths).collect():
        if total >= max_paths:
            break
        begun.append((r.parent,))
        total += r.n
    paths = paths.join(F.broadcast(spark.createDataFrame(begun, "parent array<string>")), parent == F.col("parent"))
    every = lambda k: F.filter("path", lambda _, i: i % 3 == k)
    return paths.select(F.lit(length).alias("hops"), F.concat(F.array(F.lit(source)), every(1)).alias("path_nodes"), every(2).alias("path_claims")), seen
