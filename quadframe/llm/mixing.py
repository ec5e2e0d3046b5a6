"""Mixing sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, in_order, join_hot, written

#: Words in a block, at most; rows in a shard, about; shards of a source, at most.
BLOCK, SHARD_ROWS, SHARDS = 64, 1000, 16_384
#: Thresholds that one pass over the sources tries.
PROBES = 512


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), none above its ``most``; ties go to the earlier.

    A divisor found by bisection gives nearly all seats at once; the rest go one by one.
    """
    v, cap = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, cap[v > 0].sum()))
    if seats <= 0:
        return [0] * len(v)
    given = lambda d: np.minimum(cap, np.floor(v / d + 0.5)).astype(np.int64)
    low, high = v.max() / (2.0 * seats + 2), 4 * v.max() + 1
    while given(low).sum() < seats:
        low /= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    won = given(high)
    quotients = [(-v[i] / (2 * won[i] + 1), i) for i in range(len(v)) if v[i] > 0 and won[i] < cap[i]]
    heapq.heapify(quotients)
    for _ in range(seats - int(won.sum())):
        _, i = heapq.heappop(quotients)
        won[i] += 1
        if won[i] < cap[i]:
            heapq.heappush(quotients, (-v[i] / (2 * won[i] + 1), i))
    return won.tolist()


def _bits(x: float) -> int:
    """A whole number that orders positive doubles as they are ordered themselves."""
    return struct.unpack("<q", struct.pack("<d", x))[0]


def _double(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def _reaching(t: Column) -> Column:
    """How many quotients v / (2 k + 1) of a row reach ``t``, at most ``cap``: by division, then put right by the quotients themselves."""
    k = F.floor(F.col("v") / t / 2 + 0.5)
    more = F.when(F.col("v") / (2 * k + 1) >= t, 1).otherwise(0)
    less = F.when((k > 0) & (F.col("v") / (2 * k - 1) < t), 1).otherwise(0)
    return F.least(F.col("cap"), k + more - less)


def sainte_lague_table(table: DataFrame, seats: int) -> DataFrame:
    """s and seats of every row (s, v, cap) of a written ``table``: what ``sainte_lague`` gives for v and cap in order of s.

    The seats are the highest quotients of all rows.  The least quotient that wins is bracketed by doubles: a pass tries PROBES thresholds, at first
    more closely around the mean one; rows never move, and the driver sees one number per threshold.  When at most PROBES quotients
    are left between the ends, those are sorted.  If more are, because so many rows tie, the ends close in to one double, and of the equal
    quotients those of the first rows win.
    """
    live = table.where("v > 0 AND cap > 0").select("s", "v", "cap")
    ends = live.agg(F.sum("cap").alias("all"), F.sum("v").alias("v"), F.min(F.col("v") / (2 * F.col("cap") - 1)).alias("low"), F.max("v").alias("high")).first()
    seats = min(seats, ends["all"] or 0)
    if seats <= 0:
        return table.select("s", F.lit(0).cast("long").alias("seats"))
    # at least ``seats`` quotients reach ``low``, fewer reach ``high``; the counts at both are kept
    low, high = _bits(ends["low"]), _bits(ends["high"]) + 1
    at_low, at_high = ends["all"], 0
    mean = ends["v"] / (2 * seats)
    near = {_bits(mean * (1 + sign * 2.0**-i)) for i in range(1, 48) for sign in (-1, 1)}
    while high - low > 1 and at_low - at_high > PROBES:
        tried = sorted(x for x in near | {low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1)} if low < x < high)
        thresholds = F.expr(f"cast(split('{','.join(repr(_double(b)) for b in tried)}', ',') AS array<double>)")
        counts = live.select("v", "cap", F.posexplode(thresholds).alias("i", "t")).groupBy("i").agg(F.sum(_reaching(F.col("t"))).alias("n")).collect()
        reached = {tried[r["i"]]: r["n"] for r in counts}
        low, at_low = max([(low, at_low), *(x for x in reached.items() if x[1] >= seats)])
        high, at_high = min([(high, at_high), *(x for x in reached.items() if x[1] < seats)])
        near = set()
    sure, last = _reaching(F.lit(_double(high))), _reaching(F.lit(_double(low)))
    won = live.select("s", "v", sure.alias("sure"), last.alias("last"))
    open_ = won.where("last > sure")
    if at_low - at_high <= PROBES:
        quotients = open_.select("s", "v", F.explode(F.sequence("sure", F.col("last") - 1)).alias("k")).select("s", (F.col("v") / (2 * F.col("k") + 1)).alias("q"))
        more = F.broadcast(quotients.orderBy(F.desc("q"), "s").limit(seats - at_high).groupBy("s").agg(F.count("*").alias("extra")))
    else:
        more = in_order(open_.select("s"), "s", "place").where(F.col("place") < seats - at_high).select("s", F.lit(1).alias("extra"))
    won = won.join(more, "s", "left").select("s", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("seats"))
    return table.select("s").join(won, "s", "left").select("s", F.coalesce("seats", F.lit(0)).cast("long").alias("seats"))


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, limit: float = 2.0) -> list[float]:
    """Split ``share`` of all sizes by weight; what exceeds ``limit`` times a size is shared again."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def targets_table(sources: DataFrame, weights: Sequence[float], share: float = 1.5, limit: float = 2.0) -> Column:
    """The target of each row (s, source_size) of a written ``sources``, as ``targets`` has it for weights in rotation by s.

    Sources of one weight have one target unless their limit stops it, so a round is one aggregate with a row per weight.
    """
    kind, size = F.pmod("s", F.lit(len(weights))).cast("int"), F.col("source_size")
    goals, stopped = [0.0] * len(weights), -1
    while True:
        goal = F.element_at(F.array(*[F.lit(float(g)) for g in goals]), kind + 1)
        over = (size > 0) & (goal > limit * size)
        found = sources.groupBy(kind.alias("kind")).agg(F.sum("source_size").alias("n"), F.count_if(over).alias("over"), F.sum(F.when(over, size).otherwise(0)).alias("held"), F.count_if((size > 0) & ~over).alias("open")).collect()
        total = sum(weights[r["kind"]] * r["open"] for r in found)
        if sum(r["over"] for r in found) == stopped or not total:
            return F.when(size > 0, F.least(goal, limit * size) if total else limit * size).otherwise(0.0).cast("double")
        stopped = sum(r["over"] for r in found)
        left = share * sum(r["n"] for r in found) - limit * sum(r["held"] for r in found)
        goals = [left * w / total for w in weights]


def _by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """The quota of each shard of one source, which has at most SHARDS."""
    own = pdf.sort_values("shard")
    return own[["s", "shard"]].assign(quota=sainte_lague(own["held"], int(own["seats"].iloc[0]), own["most"]))


def mix_sources(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: int = 2, seed: int = 42) -> DataFrame:
    """How many words of each document a mix takes, repeats counted.

    Sources in code point order, null last, get ``weights`` in rotation.  The words are dealt to
    equal blocks; Sainte-Laguë gives each source a whole number of blocks, and then each shard
    of the source.  A shard holds its documents in a seeded order, cut into blocks; its quota is
    a whole number of rounds over all its blocks plus a run of blocks that starts at a seeded one.

    A shard is some thousand documents by hash, so a hot source is many shards and no window
    spans a source.  Sources and shards are tables, however many there are: the driver gets sums over all sources, and a task
    the shards of one source, at most SHARDS.  A hot source's row meets its documents by ``join_hot``; quotas meet them where the
    windows have put them.  A null text has 0 words, repeated rows count each for itself,
    an empty table gives no rows, other columns are ignored.  At most ``limit`` times a
    document's words are taken, and equal inputs give equal results whatever their partitions.

    Returns key, size, source_size, target (its source's), taken, and ``row`` if it is given: a column with a number of
    each row's own, which orders rows of one key and size and deals rows without a key.
    """
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    more = [] if row is None else [F.col(row).alias("row")]
    # "s" before a source and "t" for none, so that null is a value of its own and the last
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))
    sized = written(df.select(F.col(key).alias("k"), name.alias("name"), words.alias("size"), *more), "sizes")
    counted = sized.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = written(in_order(counted, "name", "s"), "sources")
    whole = sources.agg(F.sum("source_size").alias("n"), F.sum("rows").alias("rows"), F.min(F.when(F.col("source_size") > 0, F.expr(f"source_size DIV {2 * BLOCK}"))).alias("block")).first()
    block = max(1, min(BLOCK, BLOCK if whole["block"] is None else whole["block"]))
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("rows") / SHARD_ROWS), F.expr(f"{SHARDS} * rows DIV {max(1, whole['rows'] or 0)}")))
    planned = sources.select("name", "s", "source_size", "rows", shards.cast("int").alias("shards"), targets_table(sources, weights, share, limit).alias("target"))

    label = F.col("k").cast("string")
    order = F.xxhash64(label if row is None else F.coalesce(label, F.concat(F.lit("row "), F.col("row").cast("string"))), F.lit(seed))
    met = join_hot(sized, planned.withColumn("n", F.col("rows")).drop("rows"), ["name"], "n")
    dealt = met.withColumn("h", order).withColumn("shard", F.expr(f"pmod(xxhash64(h, {seed + 1}), shards)").cast("int")).drop("name")

    held = dealt.groupBy("s", "shard").agg(F.sum("size").alias("held")).withColumn("blocks", F.ceil(F.col("held") / block))
    held = written(held.select("s", "shard", "held", "blocks", (limit * F.col("blocks")).alias("most")), "shards")
    caps = held.groupBy("s").agg(F.sum("most").alias("cap"), F.count("*").alias("shards_held"))
    votes = written(planned.join(caps, "s").select("s", F.col("target").alias("v"), "cap", "shards_held"), "votes")
    seats = sainte_lague_table(votes, round(min(share, limit) * (whole["n"] or 0) / block))
    seated = held.join(votes.select("s", "shards_held").join(seats, "s"), "s")
    # most sources of a long list are one shard, whose quota is the source's
    alone = seated.where("shards_held = 1").select("s", "shard", F.least("seats", F.when(F.col("held") > 0, F.col("most")).otherwise(0)).alias("quota"))
    several = seated.where("shards_held > 1").select("s", "shard", "held", "most", "seats").groupBy("s").applyInPandas(_by_shard, "s long, shard int, quota long")
    blocks, start = F.col("blocks"), F.col("start")
    runs = held.where("blocks > 0").join(alone.unionByName(several), ["s", "shard"]).withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "s", "shard"), blocks))
    end = start + F.col("quota") % blocks
    # the run of blocks as words [lo, hi), and what wraps past the last block as [0, wrap)
    runs = written(runs.select("s", "shard", F.floor(F.col("quota") / blocks).alias("rounds"), (start * block).alias("lo"), (F.least(end, blocks) * block).alias("hi"), (F.greatest(end - blocks, F.lit(0)) * block).alias("wrap")), "runs")

    inside = Window.partitionBy("s", "shard").orderBy("h", "k", "size", *(["row"] if row else [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("to", F.col("at") + F.col("size"))
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("to"), hi) - F.greatest(F.col("at"), lo))
    taken = F.col("rounds") * F.col("size") + overlap(F.col("lo"), F.col("hi")) + overlap(F.lit(0), F.col("wrap"))
    joined = placed.join(runs, ["s", "shard"], "left")
    return joined.select(F.col("k").alias(key), "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), *([F.col("row").alias(row)] if row else []))
