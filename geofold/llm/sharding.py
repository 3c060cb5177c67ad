"""Range sharding by sampled splitters, with near-equal bytes in all shards.

1. Every row gets a size and a sort key: hash of its text, then hash of its id.
   Rows of equal texts so lie side by side.
2. Rows larger than a hundredth of a shard are few (at most 100 for each shard);
   they are dealt to the least loaded shard, largest first.
3. Of the others a sample is drawn with probability in proportion to size, and
   its quantiles are splitters: they cut the key space into ranges of about
   equal bytes. Exact bytes of each range are counted; an overfull range (many rows of
   one key) is subdivided evenly along the key,
   by the id's hash where one text fills it; parts that are overfull still hold rows of one text and id, and are dealt
   out by numbers of their own.
4. Running sums inside ranges, plus the sums of the ranges before, place every
   row on one line of bytes. Shards are cut from this line where loads come out equal.

DataFrame functions only. No range is larger than a small part of a shard, so no task
gets a hot key's rows at once; the driver sees counts of ranges and shards only.

Defined cases: a null text has size ``overhead`` and hashes as null; a null id
hashes as null; repeated rows are placed each on its own; fewer rows than shards
leave shards empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofold.llm.common import stash

SHARDS = 40
OVERHEAD = 16
#: Bytes of a range that one task sorts, at most about; there are at least RANGES_PER_SHARD ranges for each shard.
RANGE_BYTES = 256 << 20
RANGES_PER_SHARD = 8
#: Most ranges, so that splitters and their sample are bounded; a range's rows are sorted as narrow ones, without texts.
MAX_RANGES = 16_384
#: Sampled rows for each range, on average.
SAMPLES = 16
#: A row over this part of a shard's share is dealt on its own.
LARGE = 0.01
SIGN = -(1 << 63)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, h, g, r): h orders by text, g by id; r is any row's own number, fixed once it is written."""
    data = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(data) + overhead).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(docs[text_col]).alias("h"),
        F.xxhash64(docs[id_col]).alias("g"),
        F.xxhash64(F.monotonically_increasing_id()).alias("r"),
    )


def _sampled_splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """(range, lo_h, lo_g, hi_h, hi_g): key ranges of about equal bytes by a size-weighted sample of the rows."""
    if ranges < 2 or not total:
        return rows.sparkSession.range(1).select(F.lit(0).alias("range"), *(F.lit(v).cast("long").alias(n) for n, v in (("lo_h", SIGN), ("lo_g", SIGN), ("hi_h", -SIGN - 1), ("hi_g", -SIGN - 1))))
    chance = F.least(F.lit(1.0), F.col("size") * (SAMPLES * ranges / total))
    draw = F.shiftrightunsigned(F.xxhash64("g", "h", F.lit("splitter sample")), 11) / float(1 << 53)
    sample = rows.where(draw < chance).select("h", "g", (F.col("size") / chance).alias("stands_for"))
    key = Window.orderBy("h", "g")
    sums = sample.withColumn("upto", F.sum("stands_for").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    cell = sums.withColumn("cell", F.least(F.floor(F.col("upto") * ranges / F.max("upto").over(Window.partitionBy())), F.lit(ranges - 1)))
    edges = cell.groupBy("cell").agg(F.min(F.struct("h", "g")).alias("lo")).orderBy("cell")
    line = Window.orderBy("cell")
    return edges.select(
        (F.row_number().over(line) - 1).alias("range"),
        F.when(F.row_number().over(line) == 1, F.lit(SIGN)).otherwise(F.col("lo.h")).alias("lo_h"),
        F.when(F.row_number().over(line) == 1, F.lit(SIGN)).otherwise(F.col("lo.g")).alias("lo_g"),
        F.coalesce(F.lead("lo.h").over(line), F.lit(-SIGN - 1)).alias("hi_h"),
        F.coalesce(F.lead("lo.g").over(line), F.lit(-SIGN - 1)).alias("hi_g"),
    )


def _ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """rows with their range. Splitters are looked up by the first 12 bits of h, so the join is by equality."""
    first = lambda c: F.shiftright(c, 52)
    cells = splitters.select(F.explode(F.sequence(first(F.col("lo_h")), first(F.col("hi_h")))).alias("bits"), "range", "lo_h", "lo_g", "hi_h", "hi_g")
    lists = cells.groupBy("bits").agg(F.array_sort(F.collect_list(F.struct("range", "lo_h", "lo_g", "hi_h", "hi_g"))).alias("ranges"))
    below = lambda x: (x["lo_h"] < F.col("h")) | ((x["lo_h"] == F.col("h")) & (x["lo_g"] <= F.col("g")))
    at = F.size(F.filter("ranges", below))
    return rows.withColumn("bits", first(F.col("h"))).join(F.broadcast(lists), "bits").withColumn("range", F.element_at("ranges", F.greatest(at, F.lit(1)))).drop("ranges", "bits")


def _subdivided(ranged: DataFrame, limit: float) -> DataFrame:
    """``part``: which even subdivision of an overfull range a row lies in; it rises with the key."""
    full = ranged.groupBy("range.range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).select(F.col("range").alias("no"), F.ceil(F.col("bytes") / limit).alias("parts"))
    r = F.col("range")
    wide = r["lo_h"] != r["hi_h"]
    low = F.when(wide, r["lo_h"]).otherwise(r["lo_g"]).cast("double")
    high = F.when(wide, r["hi_h"]).otherwise(r["hi_g"]).cast("double")
    place = (F.when(wide, F.col("h")).otherwise(F.col("g")).cast("double") - low) / F.greatest(high - low, F.lit(1.0))
    part = F.coalesce(F.least(F.greatest(F.floor(place * F.col("parts")), F.lit(0)), F.col("parts") - 1), F.lit(0))
    return ranged.join(F.broadcast(full), ranged["range.range"] == full["no"], "left").withColumn("part", part.cast("long")).drop("no", "parts")


def _dealt(placed: DataFrame, limit: float) -> DataFrame:
    """placed (no, part, ...) with ``piece``: where a part is overfull, rows are dealt to pieces by their own numbers."""
    full = placed.groupBy("no", "part").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).select(F.col("no").alias("__no"), F.col("part").alias("__part"), F.ceil(F.col("bytes") / limit).alias("pieces"))
    joined = placed.join(F.broadcast(full), (F.col("no") == F.col("__no")) & (F.col("part") == F.col("__part")), "left").drop("__no", "__part")
    return joined.withColumn("piece", F.coalesce(F.pmod("r", "pieces"), F.lit(0)).cast("long")).drop("pieces", "r")


def level(loads: list[int], extra: int) -> list[float]:
    """What each load gets of extra so that the lowest ones rise to one level."""
    order, sunk = sorted(loads), 0.0
    height = float(order[0])
    for i, load in enumerate(order):
        rest = extra - (load * i - sunk)
        if rest < 0:
            break
        height, sunk = load + rest / (i + 1), sunk + load
    return [max(0.0, height - x) for x in loads]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; shards' bytes are equal but for about one small row."""
    spark = docs.sparkSession
    rows = stash(measured(docs, id_col, text_col, overhead), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    bound = max(1.0, LARGE * total / shards)
    large, small = rows.where(F.col("size") > bound), rows.where(F.col("size") <= bound)

    # at most shards / LARGE rows, by their definition
    ranked = large.withColumn("n", F.row_number().over(Window.orderBy(F.desc("size"), "h", "g")))
    heap, given, loads, counts = [(0, s) for s in range(shards)], [], [0] * shards, [0] * shards
    for r in ranked.select("n", "size").collect():
        load, s = heapq.heappop(heap)
        given.append((r["n"], s, counts[s]))
        loads[s], counts[s] = load + r["size"], counts[s] + 1
        heapq.heappush(heap, (loads[s], s))
    values = ", ".join(map(str, given)) or "(CAST(NULL AS INT), 0, 0)"
    dealt = ranked.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(n, shard, slot)")), "n").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))

    rest = total - sum(loads)
    ranges = max(1, shards * RANGES_PER_SHARD, min(MAX_RANGES, rest // RANGE_BYTES))
    limit = max(1.0, 2.0 * rest / ranges)
    placed = _subdivided(_ranged(small, stash(_sampled_splitters(small, rest, ranges), "splitters")), limit)
    cell = ["no", "part", "piece"]
    placed = stash(placed.select("doc_id", "size", "text_crc32", "h", "g", "r", F.col("range.range").alias("no"), "part"), "shard-parts")
    placed = stash(_dealt(placed, limit), "shard-ranges")

    # the line of cells: sums by two levels, so that no task orders all cells of a large input
    sums = placed.groupBy(*cell).agg(F.sum("size").alias("bytes"))
    by_range = sums.groupBy("no").agg(F.sum("bytes").alias("range_bytes")).withColumn("range_from", F.sum("range_bytes").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("no").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(F.broadcast(by_range.select(F.col("no"), "range_from")), "no").select(*cell, (F.coalesce("range_from", F.lit(0)) + F.coalesce(F.sum("bytes").over(inside), F.lit(0))).alias("cell_from"))
    order = Window.partitionBy(*cell).orderBy("h", "g", "doc_id", "size")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    line = placed.withColumn("at", running).join(starts, cell).withColumn("mid", F.col("cell_from") + F.col("at") + F.col("size") / 2)

    ends, upto = [], 0.0
    for share in level(loads, rest):
        upto += share
        ends.append(upto)
    shard = reduce(lambda a, e: a + (F.col("mid") >= F.lit(e)).cast("int"), ends[:-1], F.lit(0))
    sharded = stash(line.select("doc_id", "size", "text_crc32", *cell, "h", "g", shard.alias("shard")), "shard-line")

    # slots: rows of the shard in cells before, then rows before in the cell
    held = sharded.groupBy("shard", *cell).agg(F.count("*").alias("n"))
    ranges_held = held.groupBy("shard", "no").agg(F.sum("n").alias("n")).withColumn("range_slot", F.sum("n").over(Window.partitionBy("shard").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)))
    in_range = Window.partitionBy("shard", "no").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    cells = held.join(ranges_held.select("shard", "no", "range_slot"), ["shard", "no"]).select("shard", *cell, (F.coalesce("range_slot", F.lit(0)) + F.coalesce(F.sum("n").over(in_range), F.lit(0))).alias("cell_slot"))
    base = F.element_at(F.array(*(F.lit(c) for c in counts)), F.col("shard") + 1)
    slot = base + F.col("cell_slot") + F.row_number().over(Window.partitionBy("shard", *cell).orderBy("h", "g", "doc_id", "size")) - 1
    small_rows = sharded.join(cells, ["shard", *cell]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
    return small_rows.unionByName(dealt)
