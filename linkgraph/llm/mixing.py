"""Mixing sources to target weights by size in tokens.

Each source is cut into blocks of equal size, at most about BLOCK_TOKENS. Block j of a source of
weight w has release time floor(j / w) and deadline ceil((j + 1) / w) (Pfair windows); earliest
deadline first among the released blocks fills slot after slot, so at any slot every source is less
than one block away from its share. The schedule is made for one period of SLOTS slots, at whose
end all sources are exactly on their share, and repeats as often as the mix needs.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a period of the schedule, a fixed size whatever the corpus; and the most tokens of a block, at the mean of the sources.
SLOTS, BLOCK_TOKENS = 16_384, 8_192
#: Leading bits of the random key by which the prefix sums of a source are cut into pieces.
KEY_BITS = 12
SEED = 42


def water_fill(share: dict[str, float], cap: dict[str, int], size: int) -> dict[str, float]:
    """Sizes in the proportions of share, none above its cap, that add up to size as far as the
    caps allow: what capped sources lack is shared out among the others."""
    out, open_ = {}, {s for s in share if cap[s] > 0 and share[s] > 0}
    out |= {s: 0.0 for s in share if s not in open_}
    left = float(size)
    while open_:
        whole = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / whole >= cap[s]}
        if not full:
            return out | {s: left * share[s] / whole for s in open_}
        out |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) of each slot. With m blocks of M a source has weight m / M."""
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s, m in sorted(blocks.items()) if m]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // blocks[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // blocks[s], s, j + 1))
    return out


def plan(sizes: DataFrame, weights: DataFrame) -> list[dict]:
    """One entry per source of weights (source, target_share, max_repeats; a small fixed table):
    available, wanted and capped. sizes: source, n_tokens of all documents, of which those of
    no listed source count for the size of the mix but aren't used. A source without documents gets nothing."""
    have = {r["source"]: r["n"] for r in sizes.join(F.broadcast(weights.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    rows = [r for r in weights.collect() if r["source"] is not None]
    share = {r["source"]: r["target_share"] or 0.0 for r in rows}
    cap = {r["source"]: (have.get(r["source"]) or 0) * (r["max_repeats"] or 0) for r in rows}
    size = water_fill(share, cap, total)
    return [{"source": s, "share": share[s], "available": have.get(s) or 0, "wanted": size[s], "capped": share[s] * total > cap[s]} for s in share]


def _used(planned: list[dict]) -> list[dict]:
    return [p for p in planned if p["available"] and p["wanted"] > 0]


def periods(planned: list[dict], slots: int = SLOTS, block_tokens: int = BLOCK_TOKENS) -> int:
    """How often the period of slots repeats."""
    return max(1, -(-int(sum(p["wanted"] for p in planned)) // (slots * block_tokens)))


def mix(sizes: DataFrame, planned: list[dict], slots: int = SLOTS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """source, doc_id, copy_no, slot, place, n_tokens: the mix, in the order (slot, source, place).

    sizes: doc_id (unique), source, n_tokens. A source is used in whole passes in random order and
    a last part of a pass, up to its wanted size to the nearest document. Prefix sums are taken
    within pieces of the random key and over the pieces, so that no source is gathered. What is
    broadcast has a row a source, or a row a slot of the period.
    """
    spark = sizes.sparkSession
    used = _used(planned)
    n_periods, total = periods(planned, slots, block_tokens), sum(p["wanted"] for p in used)
    counts = {p["source"]: max(1, round(p["wanted"] / total * slots)) for p in used}
    rows = [(p["source"], p["available"], int(p["wanted"] // p["available"]), p["wanted"] % p["available"], counts[p["source"]], p["wanted"] / (counts[p["source"]] * n_periods)) for p in used]
    table = spark.createDataFrame(rows, "source string, available bigint, passes bigint, rest double, n_blocks bigint, block_size double")
    schedule = pfair(counts)
    period = len(schedule)
    in_period = spark.createDataFrame([(s, j, i) for i, (s, j) in enumerate(schedule)], "source string, block bigint, at bigint")
    keyed = (
        sizes.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(F.broadcast(table), "source")
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("piece", F.shiftrightunsigned("key", 64 - KEY_BITS))
    )
    pieces = keyed.groupBy("source", "piece").agg(F.sum("n_tokens").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("source").orderBy("piece")) - F.col("n")
    ).drop("n")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "piece").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at = keyed.join(pieces, ["source", "piece"]).withColumn("start", F.col("before") + inside - F.col("n_tokens"))
    copies = (
        at.withColumn("n_copies", F.col("passes") + ((F.col("start") + F.col("n_tokens") / 2) <= F.col("rest")).cast("long"))
        .where("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
        .withColumn("place", (F.col("copy_no") - 1) * F.col("available") + F.col("start"))
        .withColumn("number", F.least(F.floor(F.col("place") / F.col("block_size")), F.col("n_blocks") * n_periods - 1))
        .withColumn("block", F.col("number") % F.col("n_blocks"))
    )
    slot = F.floor(F.col("number") / F.col("n_blocks")) * period + F.col("at")
    return copies.join(F.broadcast(in_period), ["source", "block"]).select("source", "doc_id", "copy_no", slot.alias("slot"), "place", "n_tokens")


def deviations(mixed: DataFrame, planned: list[dict], slots: int = SLOTS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """source, max_deviation: how far, in blocks of the source, it is at most from its share of the tokens at the end of any slot.

    Documents lie in the slot of their first token, so the one that straddles the end adds up to its size.
    Running sums are taken within stretches of slots and over the stretches. A mix of nothing gives no rows.
    """
    used = _used(planned)
    if not used:
        return mixed.sparkSession.createDataFrame([], "source string, max_deviation double")
    n_periods, total = periods(planned, slots, block_tokens), sum(p["wanted"] for p in used)
    stretch = F.floor(F.col("slot") / 4096)
    mine = {f"s{i}": F.sum(F.when(F.col("source") == p["source"], F.col("n_tokens")).otherwise(0)) for i, p in enumerate(used)}
    by_slot = mixed.groupBy("slot").agg(*(c.alias(k) for k, c in mine.items())).withColumn("stretch", stretch)
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = by_slot.groupBy("stretch").agg(*(F.sum(k).alias(k) for k in mine)).select("stretch", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias("b" + k) for k in mine))
    upto = Window.partitionBy("stretch").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    run = by_slot.select("stretch", *(F.sum(k).over(upto).alias(k) for k in mine)).join(sums, "stretch").select(*((F.col(k) + F.col("b" + k)).alias(k) for k in mine))
    every = sum((F.col(k) for k in mine), F.lit(0))
    size = {p["source"]: p["wanted"] / (max(1, round(p["wanted"] / total * slots)) * n_periods) for p in used}
    far = run.agg(*(F.max(F.abs(F.col(k) - every * p["wanted"] / total) / size[p["source"]]).alias(k) for k, p in zip(mine, used, strict=True)))
    return far.select(F.explode(F.array(*(F.struct(F.lit(p["source"]).alias("source"), F.col(k).alias("max_deviation")) for k, p in zip(mine, used, strict=True)))).alias("r")).select("r.*")
