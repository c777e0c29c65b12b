"""Finding nodes by name, alias or id: tiers of matches, the best ones first."""
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Score of each tier, and the least ratio of the last one.
EXACT, PREFIX, CONTAINS, TOKEN, PER_TOKEN, TOKENS, FUZZY, LEAST = 100.0, 85.0, 70.0, 45.0, 5.0, 4, 60.0, 0.58


def fold(c):
    """Case-folded text on the JVM: ß and ss, final and other sigma, ſ and s are equal; the dotless i stays itself."""
    kept = F.translate(c, "ı", "\ue0ff")
    # sigma stands aside, which also keeps the optimizer from reading lower(upper(x)) as lower(x)
    return F.translate(F.lower(F.translate(F.upper(kept), "Σ", "\ue0fe")), "\ue0fe\ue0ff", "σı")


def _fields(nodes: DataFrame) -> DataFrame:
    texts = F.concat(F.array("node_id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return nodes.withColumn("_f", F.transform(F.filter(texts, lambda x: x.isNotNull()), fold)).withColumn(
        "_t", F.array_distinct(F.split(F.trim(F.regexp_replace(F.translate(fold(F.concat_ws(" ", texts, F.array("node_type"))), ":/", "  "), r"(?U)\s+", " ")), " ")))


def scored(nodes: DataFrame, query: str, node_type: str | None = None, fuzzy: bool = True) -> DataFrame:
    """nodes that match, with score: 100 equal, 85 begins with, 70 contains the query (in id, name or an alias, case folded), 45 + 5 a
    shared word (four at most, words of the type too), else 60 times the ratio of matching blocks where that is 0.58 or more.

    Only rows without a better tier, and long enough for the ratio to reach its least, go through Python, in Arrow batches.
    """
    q = query.strip()
    if not q:
        raise ValueError("the query must not be empty")
    folded = q.casefold()
    words = sorted(set(folded.replace(":", " ").replace("/", " ").split()))
    d = nodes if node_type is None else nodes.filter(fold("node_type") == node_type.casefold())
    d = _fields(d)
    shared = F.size(F.array_intersect("_t", F.array(*map(F.lit, words)))) if words else F.lit(0)
    d = d.withColumn("score", F.when(F.array_contains("_f", folded), EXACT).when(F.exists("_f", lambda f: f.startswith(folded)), PREFIX)
                     .when(F.exists("_f", lambda f: f.contains(folded)), CONTAINS).when(shared > 0, TOKEN + PER_TOKEN * F.least(shared, F.lit(TOKENS))))
    best = d.filter("score is not null").drop("_f", "_t")
    if not fuzzy:
        return best
    n = len(folded)
    near = F.filter("_f", lambda f: 2 * F.least(F.length(f), F.lit(n)) >= LEAST * (F.length(f) + n))

    @F.pandas_udf("double")
    def ratio(fields: pd.Series) -> pd.Series:
        return fields.map(lambda fs: max((SequenceMatcher(None, folded, f).ratio() for f in fs), default=0.0))

    rest = d.filter("score is null").withColumn("_n", near).filter(F.size("_n") > 0).withColumn("_r", ratio("_n")).filter(F.col("_r") >= LEAST)
    return best.unionByName(rest.withColumn("score", F.col("_r") * FUZZY).drop("_f", "_t", "_n", "_r"))


def find(nodes: DataFrame, query: str, node_type: str | None = None, limit: int = 10) -> DataFrame:
    """The best `limit` matches: score (three decimals, rounded as Python rounds), then node_type, name and node_id decide."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")

    @F.pandas_udf("double")
    def three(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, 3))

    return scored(nodes, query, node_type).orderBy(F.desc("score"), "node_type", "name", "node_id").limit(limit).withColumn("score", three("score"))
