"""Problem 4: interval union and gaps over compressed run bitmaps per entity and time shard."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

#: A shard of level 0 spans 2^34 us (4.8 h), one of level 1 spans 2^44 us (203 days) in units of the former; the rest is one shard.
LEVELS = (34, 44)
OPEN_US = 253402214400000000  # 9999-12-31T00:00:00Z


def bitmaps(intervals: DataFrame, levels=LEVELS) -> DataFrame:
    """subject, level, shard, runs: the set bits of an entity as compressed bitmaps, runs [a, b) in units of the level.

    The bits are microseconds. An interval sets at most two ends of bits in shards of level 0, at most two ends of wholly set
    shards in those of level 1, and one run of whole shards above. Equal starts within a shard are united before the
    shuffle, so a bitmap takes at most one run per distinct start: with texts in seconds 17,180 in level 0, 1,024 in level 1,
    17,950 above up to the year 9999, however many intervals an entity has; a hot entity is spread over its shards.
    Null subjects and empty, inverted or null intervals are ignored.
    """
    d = intervals.filter("subject is not null").select("subject", F.col("start_us").cast("bigint").alias("a"), F.col("end_us").cast("bigint").alias("b"))
    zero = F.lit(0).cast("bigint")
    bits = [levels[0], *[y - x for x, y in zip(levels, levels[1:])]]
    a, b = F.col("a"), F.col("b")
    piece = lambda lvl, shard, x, y: F.struct(F.lit(lvl).alias("level"), shard.alias("shard"), x.alias("a"), y.alias("b"))
    none = F.lit(None).cast("struct<level:int,shard:bigint,a:bigint,b:bigint>")
    for lvl, k in enumerate(bits):
        first, last = F.shiftright("a", k), F.shiftright(b - 1, k)
        d = d.withColumns({"f": first, "l": last, "up": F.shiftright(a + ((1 << k) - 1), k), "down": F.shiftright("b", k)})
        live, one, f, up, down = a < b, F.col("f") == F.col("l"), F.col("f"), F.col("up"), F.col("down")
        edge = lambda x: F.shiftleft(x, k)
        d = d.withColumns({
            f"p{lvl}": F.when(live & one, piece(lvl, f, a, b)).when(live & (edge(f) < a), piece(lvl, f, a, edge(up))).otherwise(none),
            f"q{lvl}": F.when(live & ~one & (edge(down) < b), piece(lvl, down, edge(down), b)).otherwise(none),
            "a2": F.when(live & ~one, up).otherwise(zero), "b2": F.when(live & ~one, down).otherwise(zero)})
        d = d.select("subject", *[c for i in range(lvl + 1) for c in (f"p{i}", f"q{i}")], F.col("a2").alias("a"), F.col("b2").alias("b"))
    top = F.when(a < b, piece(len(bits), zero, a, b)).otherwise(none)
    parts = F.filter(F.array(*[c for i in range(len(bits)) for c in (f"p{i}", f"q{i}")], top), lambda x: x.isNotNull())
    d = d.select("subject", F.explode(parts).alias("x")).select("subject", "x.*")
    d = d.groupBy("subject", "level", "shard", "a").agg(F.max("b").alias("b"))
    return d.groupBy("subject", "level", "shard").agg(F.collect_list(F.struct("a", "b")).alias("runs")).select("subject", "level", "shard", union(F.col("runs")).alias("runs"))


def union(runs):
    """The disjoint runs, in order, of an array of runs in any order; touching runs become one."""
    run = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    state = lambda r, x, y: F.struct(r.alias("r"), x.alias("a"), y.alias("b"))
    s = F.array_sort(runs)
    start = state(F.array().cast("array<struct<a:bigint,b:bigint>>"), s[0]["a"], s[0]["b"])
    step = lambda t, x: F.when(x["a"] <= t["b"], state(t["r"], t["a"], F.greatest(t["b"], x["b"]))).otherwise(
        state(F.concat(t["r"], F.array(run(t["a"], t["b"]))), x["a"], x["b"]))
    return F.when(F.size(runs) < 2, runs).otherwise(F.aggregate(s, start, step, lambda t: F.concat(t["r"], F.array(run(t["a"], t["b"])))))


def spans(intervals: DataFrame, levels=LEVELS) -> DataFrame:
    """subject, span_kind, start_us, end_us from (subject, start_us, end_us): set runs are periods, clear runs between them gaps.

    Runs that neither begin nor end a bitmap, and the clear runs between, come from each bitmap of level 0 alone, unless
    higher bits cover its shard. Only the first and last run of each and the runs of the higher levels are put in order per
    entity, to join them over shard borders: per decade at most some 40,000 items, however many intervals there are.
    """
    m = materialise(bitmaps(intervals, levels))
    unit = F.element_at(F.array(*[F.lit(1 << x).cast("bigint") for x in (0, *levels)]), F.col("level") + 1)
    n, runs = F.size("runs"), F.col("runs")
    item = lambda kind, x, y, inner: F.struct(F.lit(kind).alias("kind"), x.alias("a"), y.alias("b"), inner.alias("runs"))
    none = F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    items = F.when((F.col("level") == 0) & (n > 1), F.array(item("head", runs[0]["a"], runs[0]["b"], runs), item("tail", runs[n - 1]["a"], runs[n - 1]["b"], none))).otherwise(
        F.transform(runs, lambda r: item("head", r["a"] * F.col("unit"), r["b"] * F.col("unit"), none)))
    e = m.withColumn("unit", unit).select("subject", F.explode(items).alias("x")).select("subject", "x.*")
    w = Window.partitionBy("subject").orderBy("a", F.desc("b"))
    e = e.withColumn("top", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("whole", F.max("b").over(Window.partitionBy("subject")))
    top, a, n, runs = F.col("top"), F.col("a"), F.size("runs"), F.col("runs")
    e = e.withColumn("fresh", top.isNull() | (top < a))
    # a bitmap lies under higher bits if and only if what came before reaches beyond its first bit
    e = e.withColumn("inside", runs.isNotNull() & (top.isNull() | (top <= a))).filter("fresh or inside")
    # a head that only goes on is followed by its tail, which is fresh: the next fresh item is one or two away
    begun = F.when(F.col("fresh"), top)
    e = e.withColumn("end", F.coalesce(F.lead(begun, 1).over(w), F.lead(begun, 2).over(w), "whole"))
    span = lambda k, x, y: F.struct(F.lit(k).alias("span_kind"), x.alias("start_us"), y.alias("end_us"))
    border = F.array(F.when(F.col("fresh"), span("period", a, F.col("end"))), F.when(F.col("fresh") & (F.col("kind") != "tail") & top.isNotNull(), span("gap", top, a)))
    inner = F.concat(F.zip_with(F.slice("runs", 1, n - 1), F.slice("runs", 2, n - 1), lambda x, y: span("gap", x["b"], y["a"])),
                     F.transform(F.slice("runs", 2, n - 2), lambda x: span("period", x["a"], x["b"])))
    out = F.array_compact(F.when(F.col("inside"), F.concat(border, inner)).otherwise(border))
    return e.select("subject", F.explode(out).alias("x")).select("subject", "x.*")
