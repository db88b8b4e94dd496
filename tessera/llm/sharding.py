"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns ``vnodes`` points on a 64-bit ring.  A row's key belongs to
the first point clockwise; a shard that is full passes what it cannot hold on to
the next point.  Where the overflow goes depends only on how many rows each arc
holds, so the driver plans it over at most ``n_shards * vnodes`` counts, and the
rows themselves are placed by one window over even pieces of the arcs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, stage

RING_BITS = 14
PIECE_ROWS = 50_000


def ring_points(spark, n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard), sorted; ``n_shards * vnodes`` rows, fixed by the parameters alone."""
    rows = spark.range(n_shards * vnodes, numPartitions=1).select((F.col("id") % n_shards).cast("int").alias("s"), F.xxhash64(F.lit("point"), (F.col("id") % n_shards), F.floor(F.col("id") / n_shards)).alias("p")).collect()
    return sorted({r["p"]: r["s"] for r in sorted(rows, key=lambda r: -r["s"])}.items())


def capacities(n: int, n_shards: int, load: float) -> list[int]:
    """Rows each shard may hold; at load 1 they add up to ``n`` and differ by one at most."""
    if load <= 1:
        return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    return [math.ceil(load * n / n_shards)] * n_shards


def overflow_plan(points: list[tuple[int, int]], counts: dict[int, int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for every piece of an arc.

    In each round every arc offers what it has left to the point it has reached,
    in ring order; a full shard lets it move one point on.  A piece is cut only
    where a shard fills up, so there are at most arcs + shards pieces.
    """
    room, used, out = list(caps), [0] * len(caps), []
    left = [(a, 0, counts[a]) for a in sorted(counts) if counts[a]]
    step = 0
    while left:
        still = []
        for arc, lo, hi in left:
            shard = points[(arc + step) % len(points)][1]
            take = min(room[shard], hi - lo)
            if take:
                out.append((arc, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if lo + take < hi:
                still.append((arc, lo + take, hi))
        left, step = still, step + 1
    return out


def ring_intervals(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(prefix, low, high, arc): the ring cut at every point and every hash prefix, so that a row finds its arc by an equality on the prefix."""
    shift, out, low = 64 - RING_BITS, [], -(2**63)
    ends = [(p, i) for i, (p, _) in enumerate(points)] + [(2**63 - 1, 0)]
    for high, arc in ends:
        at = low
        while at <= high:
            end = min(high, (((at >> shift) + 1) << shift) - 1)
            out.append((at >> shift, at, end, arc))
            at = end + 1
        low = high + 1
    return out


def shard_documents(df: DataFrame, n_shards: int = 24, vnodes: int = 128, load: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard: id, size, text_crc32, law, shard, slot, grown_shard.

    ``load`` 1 fills all shards evenly (law ``rows``: counts at most one apart);
    a larger load leaves slack, so that fewer keys overflow and fewer move when a
    shard joins.  Null texts count as empty.  Rows with a null id are placed by
    their text.  Repeated ids and equal rows share a ring position and are
    told apart by rank alone.  An empty table gives no rows.  Columns other than
    the two named are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(text)).alias("h"))
    points = ring_points(spark, n_shards, vnodes)
    ring = literal_rows(spark, ring_intervals(points), "prefix int, low bigint, high bigint, arc int")
    at = F.shiftright(F.col("h"), 64 - RING_BITS).cast("int")
    digest = digest.withColumn("prefix", at).join(F.broadcast(ring), ["prefix"]).where(F.col("h").between(F.col("low"), F.col("high"))).select("doc_id", "size", "text_crc32", "h", "arc")
    digest = stage(digest, "shards")
    counts = {r["arc"]: r["n"] for r in digest.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    plan = literal_rows(spark, overflow_plan(points, counts, capacities(n, n_shards, load)), "arc int, lo bigint, hi bigint, shard int, base bigint") if n else literal_rows(spark, [], "arc int, lo bigint, hi bigint, shard int, base bigint")

    fine = max(1, math.ceil(n / (len(points) * PIECE_ROWS)))
    digest = digest.withColumn("fine", F.pmod(F.xxhash64("h", "text_crc32", "size"), F.lit(fine)).cast("int"))
    before = digest.groupBy("arc", "fine").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy("arc").orderBy("fine")) - F.col("m")).select("arc", "fine", "before")
    order = Window.partitionBy("arc", "fine").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = digest.withColumn("k", F.row_number().over(order) - 1).join(before, ["arc", "fine"]).withColumn("rank", (F.col("k") + F.col("before")).cast("long"))
    placed = ranked.join(F.broadcast(plan), ["arc"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows" if load <= 1 else "bounded").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
