"""Problem 2: mixed time texts by a kept dictionary of distinct values."""
import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import EXACT, parsed
from ..functions.text import ident, strip
from ..sources.tables import materialise, shared_dir
from ..sources.versions import Versions
from .skew import ROWS_PER_SALT, salted_join

KEY, PARSER = ["source", "raw", "zone"], 2  # raise PARSER whenever parsed() gives other results
SCHEMA = "source string, raw string, zone string, instant_us bigint"


def kept_folder(spark, dataset: str) -> str:
    """The dictionary folder of a data set (its path), below the shared folder, kept from run to run."""
    return f"{shared_dir(spark)}/time-dictionary-{PARSER}/{hashlib.sha256(dataset.encode()).hexdigest()[:16]}"


def dictionary(values: DataFrame, folder: str) -> tuple:
    """(source, raw, zone, instant_us) of all values ever seen in `folder`, and how often each stands in `values`.

    Only what the kept dictionary lacks is parsed and added; each key stands in it once. Null and empty texts are left out;
    texts that name no instant are kept with a null, so that they are not tried again.
    """
    counts = materialise(values.filter("raw is not null and raw <> ''").groupBy(*KEY).agg(F.count("*").alias("n")))
    kept = Versions(values.sparkSession, folder)

    def missing(paths):
        return counts.select(*KEY).join(kept.read(SCHEMA, paths), KEY, "left_anti") if paths else counts.select(*KEY)

    paths = kept.paths()
    if not paths or not missing(paths).isEmpty():
        paths = kept.add(lambda there: parsed(missing(there)).select(*KEY, "instant_us"))
    return kept.read(SCHEMA, paths), counts


def time_values(claims: DataFrame, evidence: DataFrame, environments: DataFrame) -> DataFrame:
    """table_name, field_name, record_id, source, raw (stripped), zone (UTC where the environment is unknown). environments is small and fixed."""
    tz = F.broadcast(environments.select(strip("environment").alias("env"), "tz_name").dropDuplicates(["env"]))
    env = strip(F.get_json_object("scope", "$.environment"))
    c = claims.select(F.lit("claims").alias("table_name"), ident("claim_id").alias("record_id"), env.alias("env"),
                      F.explode(F.create_map(F.lit("observed_at"), F.col("observed_at"), F.lit("valid_from"), F.col("valid_from"))).alias("field_name", "v"))
    e = evidence.select(F.lit("evidence").alias("table_name"), ident("evidence_id").alias("record_id"), strip("environment").alias("env"),
                        F.lit("observed_at").alias("field_name"), F.col("observed_at").alias("v"))
    return (reduce(DataFrame.unionByName, [c, e]).join(tz, "env", "left")
            .select("table_name", "field_name", "record_id", F.concat_ws(".", "table_name", "field_name").alias("source"), strip("v").alias("raw"),
                    F.coalesce("tz_name", F.lit("UTC")).alias("zone"))
            .filter("raw is not null and raw <> '' and record_id is not null"))


def normalised(values: DataFrame, folder: str, rows: int = ROWS_PER_SALT) -> DataFrame:
    """values (with source, raw, zone, record_id) and instant_us; texts that name no instant leave no row. Frequent texts are salted."""
    values = values.drop("instant_us")
    d, counts = dictionary(values, folder)
    return salted_join(values, d.filter("instant_us is not null"), KEY, "inner", "record_id", rows, counts)


def odd(values: DataFrame) -> DataFrame:
    """The values not written as YYYY-MM-DDTHH:MM:SSZ."""
    return values.filter(~F.col("raw").rlike(EXACT))


def instants(values: DataFrame, folder: str) -> DataFrame:
    """table_name, field_name, record_id, instant_us: one row per record and field that names an instant (of several the first)."""
    return normalised(values, folder).groupBy("table_name", "field_name", "record_id").agg(F.min("instant_us").alias("instant_us"))
