"""Joins of many rows to few on keys of which some may hold a third of all rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS, ROWS_PER_SALT = 512, 100_000


def salted_join(many: DataFrame, one: DataFrame, keys: list, how: str, spread: str, rows: int = ROWS_PER_SALT, counts: DataFrame | None = None) -> DataFrame:
    """many joined (inner or left) to one, which has at most one row a key; rows of null keys match nothing.

    The HOT_KEYS heaviest keys with over `rows` rows are cut into as many salts as they need, by the hash of `spread`, and
    their row of `one` is copied to each salt. Every other key then holds at most max(rows, 1/HOT_KEYS of all). At most
    HOT_KEYS keys come to the driver. counts: keys and n, where the caller has them already.
    """
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = counts.filter(F.col("n") > rows).orderBy(F.desc("n"), *keys).limit(HOT_KEYS).collect()
    if not hot:
        return many.join(one, keys, how)
    salts = F.broadcast(many.sparkSession.createDataFrame([(*[r[k] for k in keys], -(-r["n"] // rows)) for r in hot],
                                                          ", ".join(f"{k} {many.schema[k].dataType.simpleString()}" for k in keys) + ", _k bigint"))
    m = many.join(salts, keys, "left").withColumn("_salt", F.when(F.col("_k").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_k"))).otherwise(F.lit(0).cast("bigint"))).drop("_k")
    o = one.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_k"), F.lit(1)) - 1))).drop("_k")
    return m.join(o, [*keys, "_salt"], how).drop("_salt")
