"""JSON lines and single JSON documents as record tables, and back."""
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical, dumps, stable_id, with_defaults
from ..functions.text import strip

KEYS = {"nodes": "node_id", "evidence": "evidence_id", "claims": "claim_id", "unresolved": "unresolved_id"}


class BundleError(ValueError):
    """A snapshot, specification or source that breaks its rules; errors has them all."""

    def __init__(self, *errors):
        self.errors = tuple(map(str, errors))
        super().__init__("; ".join(self.errors))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (text) and v (variant) of each line that is not blank. A line that is no JSON object raises."""
    d = spark.read.text(path).filter(strip("value") != "")
    return objects(d, path)


def objects(d: DataFrame, name: str) -> DataFrame:
    d = d.withColumn("v", F.try_parse_json("value"))
    bad = d.filter(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT")).limit(1).collect()
    if bad:
        raise BundleError(f"{name}: every record must be a JSON object, not {bad[0].value[:80]!r}")
    return d


def from_rows(spark: SparkSession, rows, name: str) -> DataFrame:
    """The same from a list of Python objects."""
    return objects(spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "value string"), name)


def _any(*names):
    """The value under the first of the names that is present, even if it is null."""
    return F.coalesce(*[F.try_variant_get("v", f"$.{n}", "variant") for n in names])


def _text(*names, default=None):
    c = strip(_any(*names).cast("string"))
    return c if default is None else F.when(_any(*names).isNull(), F.lit(default)).otherwise(c)


def _texts(*names):
    """A list of texts, or one text, without blank ones."""
    one = F.schema_of_variant(_any(*names)) == "STRING"
    many = F.coalesce(*[F.try_variant_get("v", f"$.{n}", "array<string>") for n in names])
    return F.filter(F.transform(F.when(one, F.array(_any(*names).cast("string"))).otherwise(F.coalesce(many, F.array().cast("array<string>"))), strip), lambda x: x != "")


def _object(name):
    return F.coalesce(F.get_json_object("value", f"$.{name}"), F.lit("{}"))


def _attribute(name):
    return F.get_json_object("value", f"$.attributes.{name}")


def normalised(d: DataFrame, kind: str) -> DataFrame:
    """The records of one kind in their columns: synonyms of fields resolved, texts stripped, codes in upper case, ids made where
    there are none, optional fields folded into attributes (JSON text). Unknown fields are dropped; nothing is validated."""
    blank = lambda c: F.when(c != "", c)
    if kind == "nodes":
        return d.select(_text("node_id", "id").alias("node_id"), _text("node_type", "type", "kind").alias("node_type"), _text("name").alias("name"), _texts("aliases").alias("aliases"),
                        canonical(_object("attributes")).alias("attributes"))
    if kind == "evidence":
        given = F.coalesce(_any("observed_at", "extracted_at").cast("string"), _attribute("observed_at"))
        extra = F.to_json(F.struct(given.alias("observed_at"), _any("artifact_uri").cast("string").alias("artifact_uri"), _any("excerpt").cast("string").alias("excerpt")))
        d = d.select(blank(_text("evidence_id", "id")).alias("evidence_id"), _text("source_type", "type", default="source").alias("source_type"),
                     _text("repository", "source_name", "source", default="local").alias("source_name"), _text("revision").alias("revision"), _text("path").alias("path"),
                     _text("locator", "line", "symbol").alias("locator"), _text("content_hash", "sha256").alias("content_hash"),
                     F.coalesce(blank(_any("extractor").cast("string")), F.lit("manual")).alias("extractor"), _any("environment").cast("string").alias("environment"),
                     with_defaults(_object("attributes"), extra).alias("attributes"))
        made = stable_id("evidence", repository=F.col("source_name"), revision=F.col("revision"), path=F.col("path"), locator=F.col("locator"), content_hash=F.col("content_hash"))
        low = F.lower("content_hash")
        return d.withColumn("evidence_id", F.coalesce("evidence_id", made)).withColumn("content_hash", F.when(low.startswith("sha256:"), low).otherwise(F.concat(F.lit("sha256:"), low)))
    if kind == "claims":
        conf = F.coalesce(_any("confidence").cast("string"), _attribute("confidence")).try_cast("double")
        extra = F.to_json(F.struct(F.coalesce(_any("observed_at").cast("string"), _attribute("observed_at")).alias("observed_at"), F.when(conf != 1.0, conf).alias("confidence")))
        d = d.select(blank(_text("claim_id", "id")).alias("claim_id"), _text("subject", "source", "source_node_id").alias("subject"), F.upper(_text("predicate", "relation")).alias("predicate"),
                     _text("object", "target", "target_node_id").alias("object"), F.upper(_text("assertion_kind", default="DECLARED")).alias("assertion_kind"),
                     F.upper(_text("review_status", "status", default="CANDIDATE")).alias("review_status"), _texts("evidence_ids", "evidence").alias("evidence_ids"),
                     canonical(_object("scope")).alias("scope"), with_defaults(_object("attributes"), extra).alias("attributes"),
                     _any("valid_from").cast("string").alias("valid_from"), _any("valid_to").cast("string").alias("valid_to"))
        return d.withColumn("claim_id", F.coalesce("claim_id", claim_id()))
    d = d.select(blank(_text("unresolved_id", "id")).alias("unresolved_id"), _text("source_node_id", "source").alias("source_node_id"), _text("reason").alias("reason"),
                 _any("target_hint").cast("string").alias("target_hint"), _texts("evidence_ids", "evidence").alias("evidence_ids"), canonical(_object("attributes")).alias("attributes"))
    made = stable_id("unresolved", source_node_id=F.col("source_node_id"), target_hint=F.col("target_hint"), reason=F.col("reason"))
    return d.withColumn("unresolved_id", F.coalesce("unresolved_id", made))


def claim_id(scope="scope"):
    """The id of a claim from what it says; neither its evidence nor its status counts. scope holds canonical JSON."""
    return stable_id("claim", scope=("json", F.col(scope)), **{c: F.col(c) for c in ("subject", "predicate", "object", "assertion_kind", "valid_from", "valid_to")})


def lines(d: DataFrame) -> DataFrame:
    """line: each row as canonical JSON, its JSON texts as objects; order is kept."""
    columns, nested = d.columns, [c for c in d.columns if c in ("attributes", "scope")]

    def run(batches):
        import pandas as pd
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                r = {c: (list(v) if hasattr(v, "tolist") else None if v is None or v is pd.NA else v) for c, v in zip(columns, row)}
                out.append(dumps({**r, **{c: json.loads(r[c] or "{}") for c in nested}}))
            yield pd.DataFrame({"line": out})
    return d.mapInPandas(run, "line string")
