"""Shards of near equal bytes by histogram sort; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percola.session import Staged

KEY_BITS, FIRST_BITS, NEXT_BITS = 63, 14, 8
#: Lanes of a shard are dealt from so many values of a hash; a lane has about LANE_BYTES.
LANE_BITS, LANE_BYTES = 20, 256 << 20


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def sort_key(text: Column, doc_id: Column) -> Column:
    """63 bits: 31 of a hash of the text, then 32 of a hash of doc_id. Equal texts are neighbours, yet a boundary may fall between them."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(0x7FFFFFFF), 32).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(0xFFFFFFFF))


def splitters(keyed: DataFrame, n_shards: int, tolerance: float) -> list[int]:
    """n_shards - 1 keys, from (key, size): shard j has the keys from splitter j-1 on and below splitter j.

    Each round counts the exact bytes between probes: 2**14 equal ranges first, then 2**8
    inside every range in which some splitter is still off by more than `tolerance` of a
    shard. A round aggregates to at most that many rows a splitter, however many documents
    there are, and after at most 8 rounds a range is one key.
    """
    shift = KEY_BITS - FIRST_BITS
    counted = keyed.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes")).orderBy("bin").collect()
    total = sum(r["bytes"] for r in counted)
    aims = {j: total * j / n_shards for j in range(1, n_shards)}
    allowed = tolerance * total / n_shards
    found: dict[int, int] = {}
    ranges = {None: (0, [(r["bin"], r["bytes"]) for r in counted])}  # what precedes, and the bins with rows
    where = dict.fromkeys(aims)
    while True:
        inside: dict[int, tuple[int, int]] = {}
        for j in [j for j in aims if j not in found]:
            below, bins = ranges[where[j]]
            for b, size in bins:
                if below + size > aims[j]:
                    break
                below += size
            else:  # no rows at all, or none above
                found[j] = 1 << KEY_BITS
                continue
            low, high = aims[j] - below, below + size - aims[j]
            if min(low, high) <= allowed or shift == 0:
                found[j] = (b if low <= high else b + 1) << shift
            else:
                inside[j] = (b, below)
        if not inside:
            return [min(found[j], (1 << KEY_BITS) - 1) for j in sorted(aims)]
        step = min(NEXT_BITS, shift)
        parents = sorted({b for b, _ in inside.values()})
        finer = (
            keyed.where(F.shiftright("key", shift).isin(parents))
            .groupBy(F.shiftright("key", shift - step).alias("bin"))
            .agg(F.sum("size").alias("bytes"))
            .orderBy("bin")
            .collect()
        )
        ranges = {b: (below, [(r["bin"], r["bytes"]) for r in finer if r["bin"] >> step == b]) for b, below in set(inside.values())}
        where |= {j: b for j, (b, _) in inside.items()}
        shift -= step


def shard_of(key: Column, keys: list[int]) -> Column:
    """How many of the sorted splitters are not above the key: a balanced tree of comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(keys[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(keys))


def shard(
    docs: DataFrame, n_shards: int = 40, tolerance: float = 0.001, lanes: int = 64, lane_bytes: int = LANE_BYTES, staged: Staged | None = None
) -> DataFrame:
    """docs' columns plus size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    A narrow table of keys and sizes is written once; histogram rounds read it until every
    splitter is within tolerance; then rows are exchanged once, by shard and lane, and a
    slot is the lane's start plus the row's place in it. Lanes spread a shard over tasks and
    a group of equal texts over lanes; there are `lanes` at least, and as many as the
    counted bytes need for lanes of about lane_bytes, so that tasks stay small however large the corpus is. An added column replaces one of docs of that name.

    Equal texts are neighbours in the sort, so they share a shard unless a boundary falls between them: then
    nearly equal sizes win, as a group may be larger than a shard.

    Null text: size 16, no crc. Null doc_id: a value of its own in the key. Repeated rows
    have one key, so they share a shard, and take different slots. A document above a shard's
    share makes its shard larger; a shard may then be empty. Empty table: empty result.
    """
    staged = staged or Staged(docs.sparkSession)
    added = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    kept = [c for c in docs.columns if c.lower() not in added]
    key, hashed = sort_key(F.col("text"), F.col("doc_id")), F.xxhash64("doc_id", "text").bitwiseAND((1 << LANE_BITS) - 1).cast("int")
    keyed = staged.put(docs.select(key.alias("key"), row_size(F.col("text")).alias("size"), hashed.alias("hashed")), "keys")
    keys = splitters(keyed, n_shards, tolerance)
    total = keyed.agg(F.sum("size")).first()[0] or 0
    lanes = min(1 << LANE_BITS, max(lanes, -(-total // (n_shards * lane_bytes))))
    lane = (hashed % lanes).cast("int")
    lane_start = F.sum("count").over(Window.partitionBy("_s").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1))
    starts = keyed.groupBy(shard_of(F.col("key"), keys).alias("_s"), (F.col("hashed") % lanes).cast("int").alias("_l")).count().select("_s", "_l", F.coalesce(lane_start, F.lit(0)).alias("_start"))
    rows = docs.select(
        F.struct(*kept).alias("_row"), row_size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        shard_of(key, keys).alias("shard"), key.alias("_key"), lane.alias("_lane"),
    )
    place = F.row_number().over(Window.partitionBy("shard", "_lane").orderBy("_key", "_row.doc_id")) - 1
    # a row for each lane: one for each lane_bytes of the corpus, or `lanes` a shard
    placed = rows.withColumn("slot", place).join(F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col("_lane") == F.col("_l")))
    return placed.select(
        "_row.*", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("_start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
