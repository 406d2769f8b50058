"""Shards by best-fit-decreasing packing of groups that stay whole."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.llm.common import as_text, documents, written

# Items of a shard the packing looks at one by one; with up to three times as many in all, however long the table.
GRAIN = 1000
_BLOCK_ROWS = 4096


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> tuple[list[int], int] | None:
    """Bin of each of the falling ``sizes`` and the number of bins; None where over ``most`` bins would be needed.

    Each item enters the bin with the least room that is enough, or a new one. Bins stand in order of their room, so the
    search halves the list at each step as in a balanced tree. An item above the capacity has a bin of its own.
    """
    rooms: list[tuple[int, int]] = []
    out, bins = [], 0
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            if bins == most:
                return None
            room, chosen, bins = max(capacity, size), bins, bins + 1
        insort(rooms, (room - size, chosen))
        out.append(chosen)
    return out, bins


def level_bins(sizes: list[int], count: int) -> list[int]:
    """Bin of each of the falling ``sizes`` in at most ``count`` bins of the least capacity for which they suffice.

    Items of more than an even share of what is left have bins to themselves; the others share the remaining bins evenly.
    """
    left, alone = sum(sizes), 0
    while alone < min(len(sizes), count - 1) and sizes[alone] * (count - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], count - alone
    packed: list[int] = []
    if rest:
        low = max(-(-left // bins), rest[0])
        high = low
        while (packed := best_fit_decreasing(rest, high, bins)) is None:
            low, high = high + 1, high + max(1, high // 64)
        while low < high:
            middle = (low + high) // 2
            tried = best_fit_decreasing(rest, middle, bins)
            if tried is None:
                low = middle + 1
            else:
                packed, high = tried, middle
        packed = packed[0]
    return [*range(alone), *(alone + b for b in packed)]


def shards(docs: DataFrame, count: int | None = None, capacity: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row: into ``count`` shards of like bytes, or as few as hold ``capacity`` each.

    Size is the UTF-8 bytes of the text, none for null, plus 1. Rows with equal texts (null equals empty) form a group that
    stays in one shard, even one of more than an even share. Slots count from 0 without gaps in each shard. An empty table
    gives no rows; repeated rows each have a slot.

    Groups above a thousandth of a shard, of which there can be only a thousand a shard, are packed one by one; smaller ones
    are first dealt by hash to bundles of about half that size, which are packed like groups.
    """
    if (count is None) == (capacity is None):
        raise ValueError("give count or capacity")
    spark = docs.sparkSession
    body = as_text(text)
    sized = written(
        docs.select(
            F.col(key), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("_m"),
        )
    )
    groups = written(sized.groupBy("_m").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")))
    total, rows = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    bins = count or max(1, -(-total // capacity))
    line = max(1, total // (bins * GRAIN))
    bundles = 2 * bins * GRAIN
    bundle = F.pmod(F.xxhash64("_m"), F.lit(bundles))
    large = F.col("_bytes") > line
    items = groups.where(large).select("_m", F.lit(None).cast("bigint").alias("_bundle"), "_bytes").unionByName(
        groups.where(~large).groupBy(bundle.alias("_bundle")).agg(F.sum("_bytes").alias("_bytes")).withColumn("_m", F.lit(None).cast("string"))
    )
    # at most 3 * bins * GRAIN rows
    held = sorted(items.collect(), key=lambda r: (-r["_bytes"], r["_m"] or "", r["_bundle"] or 0))
    sizes = [r["_bytes"] for r in held]
    chosen = level_bins(sizes, count) if count else best_fit_decreasing(sizes, capacity)[0]
    placed = spark.createDataFrame(
        [(r["_m"], r["_bundle"], b) for r, b in zip(held, chosen)], "_m string, _bundle bigint, _shard int"
    )
    whole = placed.where("_m IS NOT NULL").select("_m", F.col("_shard").alias("_whole"))
    part = placed.where("_bundle IS NOT NULL").select("_bundle", F.col("_shard").alias("_part"))
    dealt = (
        sized.join(F.broadcast(whole), "_m", "left")
        .withColumn("_bundle", bundle)
        .join(F.broadcast(part), "_bundle", "left")
        .select(key, "size", "text_crc32", F.coalesce("_whole", "_part").alias("shard"))
    )
    return with_slots(dealt, key, bins, rows)


def with_slots(dealt: DataFrame, key: str, bins: int, rows: int) -> DataFrame:
    """Adds ``slot``: the place in the shard, from 0 without gaps, in an order drawn by hashing.

    Rows are numbered in blocks of some thousand by hash, and blocks begin where the counts of those before them end.
    """
    blocks = max(1, -(-rows // (bins * _BLOCK_ROWS)))
    order = F.xxhash64(key, "size", "text_crc32")
    dealt = written(dealt.withColumn("_block", F.pmod(order, F.lit(blocks)).cast("int")))
    counted = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begin = counted.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inner = Window.partitionBy("shard", "_block").orderBy(order, F.col(key), "text_crc32")
    numbered = dealt.withColumn("_at", F.row_number().over(inner) - 1)
    return numbered.join(begin, ["shard", "_block"]).select(
        key, "size", "text_crc32", "shard", (F.col("_begin") + F.col("_at")).cast("bigint").alias("slot")
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of like bytes, equal texts together."""
    out = shards(documents(spark, sf_dir), count=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_sharding": op4_sharding}
SQL: dict[str, str] = {}
