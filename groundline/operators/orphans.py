"""Problem 6: references to absent records, by keyed state of parents and waiting references, advanced load by load."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident
from ..sources.tables import discard, materialise
from .skew import ROWS_PER_SALT, salted_join

KEY = ["parent", "ref_id"]
SPANS = "array<struct<loaded_at:timestamp_ntz,deleted_at:timestamp_ntz>>"


def references(claims: DataFrame, unresolved: DataFrame) -> DataFrame:
    """table_name, field_name, record_id, parent, ref_id, at: each distinct reference of a record, as first loaded.

    A record's first delivery counts (rows without loaded_at come last; ties: the least content). Null and blank ids give none.
    """
    ref = lambda f, p, c: F.struct(F.lit(f).alias("field_name"), F.lit(p).alias("parent"), c.alias("ref_id"))

    def of(d, t, key, cols, refs):
        first = (d.select(ident(key).alias("record_id"), F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", *cols).alias("s")).filter("record_id is not null")
                 .groupBy("record_id").agg(F.min("s").alias("s")))
        return first.select(F.lit(t).alias("table_name"), "record_id", F.col("s.loaded_at").alias("at"), F.explode(refs).alias("x")) \
            .select("table_name", "x.field_name", "record_id", "x.parent", "x.ref_id", "at").filter("ref_id is not null")

    evidence = F.transform(F.array_distinct(F.transform(F.coalesce("s.evidence_ids", F.array().cast("array<string>")), ident)), lambda x: ref("evidence_ids", "evidence", x))
    a = of(claims, "claims", "claim_id", ["subject", "object", "evidence_ids"],
           F.concat(F.array(ref("subject", "nodes", ident("s.subject")), ref("object", "nodes", ident("s.object"))), evidence))
    return a.unionByName(of(unresolved, "unresolved", "unresolved_id", ["source_node_id"], F.array(ref("source_node_id", "nodes", ident("s.source_node_id")))))


def parents(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """parent, ref_id, loaded_at, deleted_at: the deliveries of the records referred to. Null ids or load times give none."""
    rows = lambda d, t, k: d.select(F.lit(t).alias("parent"), ident(k).alias("ref_id"), "loaded_at", "deleted_at").filter("ref_id is not null and loaded_at is not null")
    return rows(nodes, "nodes", "node_id").unionByName(rows(evidence, "evidence", "evidence_id"))


def compact(rows: DataFrame) -> DataFrame:
    """parent, ref_id, spans: the times of presence. Of rows with one end only the earliest counts, so a key holds one span per distinct deletion."""
    return (rows.groupBy(*KEY, "deleted_at").agg(F.min("loaded_at").alias("loaded_at")).groupBy(*KEY)
            .agg(F.collect_list(F.struct("loaded_at", "deleted_at")).alias("spans")))


def _live(at):
    return F.exists("spans", lambda s: (s["loaded_at"] <= at) & (s["deleted_at"].isNull() | (s["deleted_at"] > at)))


class OrphanState:
    """State kept by key between loads: the parent index, and the references that did not hold, each with what is known of its parent.

    advance() takes the references and parent rows of one load, in any order of loads:
    new references probe the index as of their own moment and wait if it holds no live parent;
    arriving parents are brought to the waiting references of their key, which become `deleted` or `late`, leave if a row proves
    that the parent was there after all, and are resolved while a span covers the time of the load; a deletion ends the span
    and opens them again. A reference must come once; references() sees to it. Rows without a moment are never found wanting.
    Both tables are written at every load and their forerunners deleted, so the state survives any executor.
    """

    WAITING = "table_name string, field_name string, record_id string, parent string, ref_id string, at timestamp_ntz, spans " + SPANS + ", resolved boolean, times_opened int"

    def __init__(self, spark, rows: int = ROWS_PER_SALT):
        self.rows = rows
        self.index = spark.createDataFrame([], f"parent string, ref_id string, spans {SPANS}")
        self.waiting = spark.createDataFrame([], self.WAITING)

    def advance(self, refs: DataFrame, arrivals: DataFrame, now) -> None:
        """now: the end of the load (exclusive), at which references are counted as resolved or open; a Python datetime."""
        now = F.lit(now).cast("timestamp_ntz")
        new = materialise(compact(arrivals))
        old_index, old_waiting = self.index, self.waiting
        both = F.concat(F.coalesce("spans", F.array().cast(SPANS)), F.coalesce("more", F.array().cast(SPANS)))
        self.index = materialise(old_index.join(new.withColumnRenamed("spans", "more"), KEY, "full_outer").select(*KEY, both.alias("spans")))
        known = F.coalesce("spans", F.array().cast(SPANS))
        refs = refs.select("table_name", "field_name", "record_id", *KEY, "at").filter("at is not null")
        fresh = salted_join(refs, self.index, KEY, "left", "record_id", self.rows).withColumn("spans", known) \
            .select("table_name", "field_name", "record_id", *KEY, "at", "spans", F.lit(True).alias("resolved"), F.lit(0).alias("times_opened"))
        told = salted_join(old_waiting, new.withColumnRenamed("spans", "more"), KEY, "left", "record_id", self.rows).withColumn("spans", both).drop("more")
        all_ = fresh.unionByName(told.select(*fresh.columns)).filter(~_live(F.col("at"))).withColumn("now", _live(now - F.expr("interval 1 microsecond")))
        opened = F.col("times_opened") + (F.col("resolved") & ~F.col("now")).cast("int")
        # one that was resolved within its own load was open once too
        self.waiting = materialise(all_.withColumn("times_opened", F.greatest(opened, F.lit(1))).withColumn("resolved", F.col("now")).drop("now"))
        for d in (old_index, old_waiting, new):
            discard(d)

    def found(self) -> DataFrame:
        """table_name, field_name, record_id, ref_id, ref_state, load_month of all references that did not hold, as known after the last load."""
        state = F.when(F.size("spans") == 0, "missing").when(F.exists("spans", lambda s: s["loaded_at"] <= F.col("at")), "deleted").otherwise("late")
        return self.waiting.select("table_name", "field_name", "record_id", "ref_id", state.alias("ref_state"), F.date_format("at", "yyyy-MM").alias("load_month"))

    def counts(self, until: str) -> DataFrame:
        """until, table_name, field_name, n_orphans, n_open, n_resolved, n_reopened: the state at the end of the last load."""
        return self.waiting.groupBy("table_name", "field_name").agg(
            F.count("*").alias("n_orphans"), F.count_if(~F.col("resolved")).alias("n_open"), F.count_if("resolved").alias("n_resolved"),
            F.count_if(F.col("times_opened") > 1).alias("n_reopened")).withColumn("until", F.lit(until))


def run_loads(refs: DataFrame, rows: DataFrame, every: str = "year", salt_rows: int = ROWS_PER_SALT) -> tuple:
    """The state after all loads, one per calendar `every` (year, quarter, month) of loading, and the counts after each of them.

    Both inputs are written once, split by load, so each load reads only its own. The loads are as many as periods with rows.
    """
    load = lambda c: F.date_format(F.date_trunc(every, F.col(c)), "yyyy-MM-dd").alias("load")
    refs = materialise(refs.filter("at is not null").withColumn("load", load("at")), partition="load")
    rows = materialise(rows.withColumn("load", load("loaded_at")), partition="load")
    spark = refs.sparkSession
    starts = [r[0] for r in refs.select("load").union(rows.select("load")).distinct().orderBy("load").collect()]
    state, counts = OrphanState(spark, salt_rows), []
    for start in starts:
        end = spark.sql(f"select cast(add_months(date'{start}', {dict(year=12, quarter=3, month=1)[every]}) as timestamp_ntz)").first()[0]
        state.advance(refs.filter(F.col("load") == start).drop("load"), rows.filter(F.col("load") == start).drop("load"), end)
        counts.append(state.counts(end.strftime("%Y-%m-%d")))
        counts[-1] = materialise(counts[-1])
    discard(refs)
    discard(rows)
    none = "table_name string, field_name string, n_orphans bigint, n_open bigint, n_resolved bigint, n_reopened bigint, until string"
    return state, reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], none)
