"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percola.session import Staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): `share` of all sizes, dealt by weight.

    Sources in code-point order, null last, take the weights in turn. A target stops at
    `cap` times its source's size and the excess is dealt again by weight among the others
    until none is above: with sources ordered by cap / weight, the level is the first one
    that no later source exceeds, which two running sums find without iterating. One row
    per source: the single-partition windows here see sources, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    every = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    t = (
        totals.withColumn("weight", w)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("all", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("reach", (F.col("all") - F.col("capped")) / F.col("open"))
        .withColumn("water", F.min(F.when(F.col("level") >= F.col("reach"), F.struct("level", "reach"))).over(every)["reach"])
    )
    target = F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    staged: Staged | None = None,
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    A document of source s is expected target(s) / source_size(s) times, so its prefix sum
    is that rate times its place in the source. Places go by size first, which makes the
    systematic sample a stratified one, then by a hash of doc_id, then doc_id. With one
    offset per source, from a hash of the seed, a document is emitted once for each integer
    between its prefix sum and the one before; copies are the floor or the ceiling of the rate.

    Places come from counts, not from one sorted source: documents per (source, size) and
    per (source, size, 1/4096 of the hash), summed forward, plus a row number inside that
    last cell. A source or a text that holds a third of all rows is thus spread over cells.

    Null text: size 0. Null source: a source of its own, last. Null or repeated doc_id:
    kept, each row its own place. Empty table: empty result. Other columns are ignored.
    """
    staged = staged or Staged(docs.sparkSession)
    narrow = staged.put(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn(
            "cell", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3)
        ),
        "sizes",
    )
    targets = source_targets(narrow, weights, share, cap)
    cells = narrow.groupBy("source", "size", "cell").count()
    by_size = cells.groupBy("source", "size").agg(F.sum("count").alias("n"))
    before = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("size_start", F.coalesce(F.sum("n").over(before(["source"], "size")), F.lit(0))).drop("n")
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("count").over(before(["source", "size"], "cell")), F.lit(0))).drop("count")
    starts = _left(cells, by_size, "source", "size").withColumn("start", F.col("size_start") + F.col("cell_start"))
    row = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("doc_id"))
    placed = _left(narrow.withColumn("row", row), starts.select("source", "size", "cell", "start"), "source", "size", "cell")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("\u0001"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = (F.col("start") + F.col("row")).cast("double")
    out = _left(placed.withColumn("place", place), targets.withColumn("rate", rate).withColumn("offset", offset), "source")
    copies = F.floor(F.col("rate") * F.col("place") + F.col("offset")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("offset"))
    return out.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _left(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """An inner join on keys that may be null; every row on the left has its one match."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_{k}" for k in keys])


def mix(docs: DataFrame, staged: Staged | None = None, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as its plan says, with docs' own columns.

    Where doc_ids are unique, texts move once, to their plans. Otherwise rows that share a doc_id (or have
    none) are told apart by source and size, and rows alike in all three take each other's copies in
    turn, so the number of emitted rows is the plan's in either case.
    """
    staged = staged or Staged(docs.sparkSession)
    plan = staged.put(mix_plan(docs, staged=staged, **options), "plan")
    repeat = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    taken = plan.where("copies > 0")
    if not plan.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        # the same plan at every size: whether the plan could be broadcast depends on the corpus
        packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id")
        out = packed.join(taken.select("doc_id", F.col("copies").alias("_copies")).hint("merge"), "doc_id")
        return out.withColumn("_copy", repeat).select("row.*")
    w = Window.partitionBy("doc_id", "source", "size")
    taken = plan.select("doc_id", "source", "size", F.col("copies").alias("_copies"), F.row_number().over(w.orderBy("copies")).alias("nth")).where("_copies > 0")
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    inner = inner.withColumn("nth", F.row_number().over(w.orderBy(F.xxhash64("row"))))
    return _left(inner, taken, "doc_id", "source", "size", "nth").withColumn("_copy", repeat).select("row.*")
