"""Problem 8: mixing sources to target weights by Pfair block scheduling."""
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TOKENS, MAX_PERIOD, RANGES = 4096, 1_000_000, 1024


def units(shares: dict, max_period: int = MAX_PERIOD) -> dict:
    """Whole-number weights in exactly the ratio of the shares as written (0.45 is 45/100), without a common factor.

    Only where these would need a period of over max_period blocks they are rounded to millionths of the whole, at least one
    each; the mix is then off by at most one block in max_period.
    """
    exact = {s: Fraction(repr(float(x))) for s, x in shares.items()}
    common = math.lcm(*[x.denominator for x in exact.values()])
    whole = {s: int(x * common) for s, x in exact.items()}
    g = math.gcd(*whole.values())
    whole = {s: w // g for s, w in whole.items()}
    if sum(whole.values()) > max_period:
        total = sum(whole.values())
        whole = {s: max(1, round(w * max_period / total)) for s, w in whole.items()}
    return whole


def pattern(weights: dict) -> dict:
    """Slots of each source within one period of sum(weights) blocks: earliest deadline first among released blocks.

    Block j of weight w out of P is released at floor(j P / w) and due at ceil((j + 1) P / w), so the share of a source
    is never off by a block. The schedule repeats each period.
    """
    period, done, out = sum(weights.values()), dict.fromkeys(weights, 0), {s: [] for s in weights}
    for slot in range(period):
        due = [(-(-(done[s] + 1) * period // w), s) for s, w in weights.items() if w > done[s] and done[s] * period // w <= slot]
        s = min(due)[1]
        done[s] += 1
        out[s].append(slot)
    return out


def plan(targets: list, total: dict, target_tokens: int | None = None) -> list:
    """(mix_name, source, quota, total, period, slots) for each target with tokens. targets: rows of the small table mix_targets.

    A mix is target_tokens long; by default as long as its scarcest source allows within max_repeats, so that every share is
    met. With a greater target_tokens the sources that run out give all they may and the reached shares tell. Targets without
    tokens, share or repeats are left out and the other weights scaled up.
    """
    out = []
    for m in sorted({w.mix_name for w in targets}):
        live = [w for w in targets if w.mix_name == m and total.get(w.source) and (w.target_share or 0) > 0 and (w.max_repeats or 0) > 0]
        if not live:
            continue
        n = units({w.source: w.target_share for w in live})
        p, slots = sum(n.values()), pattern(n)
        size = min(w.max_repeats * total[w.source] * p // n[w.source] for w in live) if target_tokens is None else target_tokens
        out += [(m, w.source, min(size * n[w.source] // p, w.max_repeats * total[w.source]), total[w.source], p, slots[w.source]) for w in live]
    return out


def mix(sizes: DataFrame, targets: DataFrame, target_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """mix_name, source, doc_id, repeat_no, token_start, token_end, tokens, slot: the pieces of documents in each block of the mix.

    The documents of a source are laid end to end, by hash, and again for each repeat, and cut at the borders of blocks of
    block_tokens; its j-th block has the slot of the j-th release of its schedule. Reading by (slot, doc_id, token_start)
    therefore never leaves a source a whole block off its share, and all pieces of a document put together give it whole; only
    the last piece of a source ends with its quota. Documents of null or untargeted sources, and those without tokens, are in
    no mix. targets is small and fixed, totals per source are of its size. Offsets come from sums over RANGES hash ranges of a
    source, so no source is walked in one task.
    """
    s = sizes.filter("tokens > 0 and source is not null").select("doc_id", "source", "tokens").withColumn("h", F.xxhash64("doc_id", F.lit(11))).withColumn("r", F.pmod("h", F.lit(RANGES)))
    per = s.groupBy("source", "r").agg(F.sum("tokens").alias("t"))
    base = per.withColumn("base", F.sum("t").over(Window.partitionBy("source").orderBy("r")) - F.col("t")).drop("t")
    want = targets.select("mix_name", "source", "target_share", "max_repeats").dropDuplicates(["mix_name", "source"]).collect()
    total = {r[0]: r[1] for r in per.filter(F.col("source").isin(list({w.source for w in want}))).groupBy("source").agg(F.sum("t")).collect()}
    p = F.broadcast(sizes.sparkSession.createDataFrame(plan(want, total, target_tokens), "mix_name string, source string, quota bigint, total bigint, period int, slots array<int>"))
    w = Window.partitionBy("source", "r").orderBy("h", "doc_id")
    at = s.join(base, ["source", "r"]).withColumn("o", F.col("base") + F.sum("tokens").over(w) - F.col("tokens"))
    x = at.join(p, "source").filter("o < quota").withColumn("repeat_no", F.explode(F.expr("sequence(0, int((quota - 1 - o) div total))")))
    x = x.withColumn("o", F.col("o") + F.col("repeat_no") * F.col("total")).withColumn("end", F.least(F.col("o") + F.col("tokens"), F.col("quota")))
    x = x.withColumn("block", F.explode(F.expr(f"sequence(o div {block_tokens}, (end - 1) div {block_tokens})")))
    lo, hi = F.greatest("o", F.col("block") * block_tokens), F.least("end", (F.col("block") + 1) * block_tokens)
    n = F.size("slots")
    slot = F.expr("block div size(slots)") * F.col("period") + F.element_at("slots", (F.col("block") % n).cast("int") + 1)
    return x.select("mix_name", "source", "doc_id", F.col("repeat_no").cast("int").alias("repeat_no"), (lo - F.col("o")).alias("token_start"), (hi - F.col("o")).alias("token_end"),
                    (hi - lo).alias("tokens"), slot.cast("bigint").alias("slot"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, tokens, reached_share for every target."""
    g = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"))
    t = targets.join(g, ["mix_name", "source"], "left").na.fill(0, ["tokens"])
    return t.select("mix_name", "source", "target_share", "tokens", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix_name"))).alias("reached_share"))
