"""Minimax contiguous partition of atomic groups into shards.

Rows with equal texts form a group that no cut divides.  Groups stand in the
order of their text's hash.  The smallest capacity at which a greedy sweep needs
no more than the wanted number of shards is found by binary search, and the
sweep at that capacity places the cuts.

The sweep runs on the driver over bins, stretches of the hash order whose sizes
one aggregation gives: ``BINS`` at most, whatever the number of groups.  Bins
act as atoms, so the capacity found is an upper bound; it is exact once no bin
that a cut might fall into can be divided.  Until then those bins are divided,
at most ``REFINE`` of them at a time, by further bits of the hash.

Defined results: a null text has size ``overhead`` and all null texts form one
group, apart from the empty text's.  Repeated rows stay repeated and get slots
of their own.  With no rows there are no shards; shards beyond the need are
empty.  Groups larger than the mean shard set the capacity alone.  Only the
named columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import durable

#: First division of the hash order, and bits by which a bin is divided further.
BIN_BITS, STEP_BITS = 14, 6
#: Bins divided in one round at most.
REFINE = 4096
#: Parts of a bin by the row's own hash, so that a hot group's rows are numbered in many tasks.
SALT = 64


def greedy_cuts(sizes: list[int], capacity: int, most: int) -> list[int] | None:
    """Where shards begin (0 left out) if each takes as many bins as fit; None if that needs more than ``most``."""
    ends = list(accumulate(sizes))
    cuts, base, at = [], 0, 0
    while at < len(ends):
        nxt = bisect_right(ends, base + capacity, at)
        if nxt == at or len(cuts) == most:
            return None
        cuts.append(nxt)
        base, at = ends[nxt - 1], nxt
    return cuts[:-1]


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which ``sizes`` fit into so many contiguous shards."""
    if not sizes:
        return 0
    low, high = max(max(sizes), -(-sum(sizes) // shards)), max(sizes) + -(-sum(sizes) // shards)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _bins(groups: DataFrame, bits: int) -> DataFrame:
    """Size and number of groups of each stretch of the hash order that ``bits`` leading bits name."""
    return groups.groupBy(F.shiftright("group_hash", 64 - bits).alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"))


def find_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hashes of the shards after the first, and the capacity. ``groups``: group_hash and size, one row a group."""
    total, largest = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not total:
        return [], 0
    floor = max(largest, -(-total // shards))
    # a bin: its first hash, bits, size, groups; kept in the order of the hash
    bins = sorted((r.bin << (64 - BIN_BITS), BIN_BITS, r["size"], r.groups) for r in _bins(groups, BIN_BITS).collect())
    while True:
        sizes = [b[2] for b in bins]
        capacity = smallest_capacity(sizes, shards)
        if capacity == floor:
            break
        ends = list(accumulate(sizes))
        doubtful = [b for b, end in zip(bins, ends) if b[3] > 1 and b[1] < 64 and (b[2] > floor or _may_hold_cut(end - b[2], end, total, capacity, floor, shards))]
        if not doubtful:
            break
        bits = min(b[1] for b in doubtful)
        chosen = sorted((b for b in doubtful if b[1] == bits), key=lambda b: -b[2])[:REFINE]
        finer = min(64, bits + STEP_BITS)
        wanted = groups.sparkSession.createDataFrame([(b[0] >> (64 - bits),) for b in chosen], "wide long")  # REFINE rows at most
        inside = groups.withColumn("wide", F.shiftright("group_hash", 64 - bits)).join(F.broadcast(wanted), "wide", "left_semi")
        parts = [(r.bin << (64 - finer), finer, r["size"], r.groups) for r in _bins(inside, finer).collect()]
        gone = {b[:2] for b in chosen}
        bins = sorted([b for b in bins if b[:2] not in gone] + parts)
    starts = greedy_cuts([b[2] for b in bins], capacity, shards)
    return [bins[k][0] for k in starts], capacity


def _may_hold_cut(start: int, end: int, total: int, capacity: int, floor: int, shards: int) -> bool:
    """Whether a cut of a partition better than ``capacity`` may lie within these bounds of the running size."""
    best = capacity - 1
    k = max(1, start // best)
    while k < shards and total - (shards - k) * best < end:
        if start < k * best:
            return True
        k += 1
    return False


def shard(docs: DataFrame, shards: int, *, id_column: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """id, size, text_crc32, group_hash, shard, slot of every row; slots count from 0 in each shard."""
    raw = F.col(text).cast("string").cast("binary")
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.crc32(F.lit(b""))).cast("long").alias("text_crc32"),
        F.xxhash64(raw, raw.isNull()).alias("group_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    # written once: the row numbers below must not change if a task runs again
    rows = durable(rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).drop("row"), "shard-rows")
    groups = durable(rows.groupBy("group_hash").agg(F.sum("size").alias("size")), "shard-groups")
    cuts, _ = find_cuts(groups, shards)
    place = F.lit(0)
    for cut in cuts:  # shards - 1 of them at most
        place = place + (F.col("group_hash") >= F.lit(cut)).cast("int")
    rows = rows.withColumn("shard", place).withColumn("bin", F.shiftright("group_hash", 64 - BIN_BITS))
    cell = ["shard", "bin", "part"]  # a bounded number of cells
    before = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1))).select(*cell, F.coalesce("first", F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy(*cell).orderBy("group_hash", "id")) - 1
    return rows.withColumn("own", own).join(before, cell).select("id", "size", "text_crc32", "group_hash", "shard", (F.col("first") + F.col("own")).cast("long").alias("slot"))
