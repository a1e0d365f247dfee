"""Running totals, positions and quantiles over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percola.session import Staged


def running_total(df: DataFrame, order_by: list[Column], value: Column, name: str, staged: Staged | None = None) -> DataFrame:
    """df with `name`: the sum of value over the rows before, in order_by order (make it unique: ties share no order).

    Rows are dealt by range and written once; each range's total goes to the driver (a row for each
    shuffle partition), and a range's start is added to sums within it. Null values count as 0.
    """
    spark = df.sparkSession
    staged = staged or Staged(spark)
    ranged = df.withColumn("_v", F.coalesce(value, F.lit(0)))
    for i, c in enumerate(order_by):
        ranged = ranged.withColumn(f"_o{i}", c)
    cols = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order_by))]
    ranged = staged.put(ranged.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part").agg(F.sum("_v").alias("t")).orderBy("_part").collect()
    starts, at = [], 0
    for r in parts:
        starts.append((r["_part"], at))
        at += r["t"]
    kind = ranged.select(F.sum("_v").alias("s")).schema["s"].dataType.simpleString()
    start = spark.createDataFrame(starts, f"_part int, _start {kind}")
    w = Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_before", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    out = out.join(F.broadcast(start), "_part").withColumn(name, F.col("_before") + F.col("_start"))
    return out.select(*df.columns, name)


def positions(df: DataFrame, order_by: list[Column], name: str = "rank", staged: Staged | None = None) -> DataFrame:
    """df with 1-based places in order_by order, which must be unique for repeatable results."""
    return running_total(df, order_by, F.lit(1).cast("long"), name, staged).withColumn(name, F.col(name) + 1)


def value_places(df: DataFrame, column: str, staged: Staged | None = None) -> DataFrame:
    """(value, n, before): each distinct non-null value, its rows, and the rows of lesser values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running_total(counts, [F.col("value")], F.col("n"), "before", staged)


def average_rank(df: DataFrame, column: str, name: str, staged: Staged | None = None) -> DataFrame:
    """df with the ascending rank of column, ties at their average; null stays null."""
    places = value_places(df, column, staged).select("value", (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(places, F.col(column) == F.col("value"), "left").drop("value")


def column_quantiles(df: DataFrame, wanted: dict[str, list[float]], staged: Staged | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of several numeric columns with linear interpolation, from one pass over df.

    Values of all columns are counted together, so one running total serves them all. Nulls are ignored; None for a
    column without values.
    """
    staged = staged or Staged(df.sparkSession)
    names = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)]))
    counts = df.select(each.alias("x")).where("x.value is not null").groupBy("x.c", "x.value").agg(F.count("*").alias("n"))
    places = staged.put(running_total(counts, [F.col("c"), F.col("value")], F.col("n"), "before", staged), "places")
    # a row for each column
    ends = {r["c"]: (r["first"], r["total"]) for r in places.groupBy("c").agg(F.min("before").alias("first"), F.sum("n").alias("total")).collect()}
    at = {(i, int((ends[i][1] - 1) * p) + k) for i, n in enumerate(names) if i in ends for p in wanted[n] for k in (0, 1)}
    at = sorted((i, x) for i, x in at if x < ends[i][1])
    inside = [(F.col("c") == i) & (F.col("before") <= ends[i][0] + x) & (F.lit(ends[i][0] + x) < F.col("before") + F.col("n")) for i, x in at]
    rows = places.select("value", F.array(*inside).alias("hit")).where(F.array_contains("hit", True)).collect() if at else []
    value = {key: r["value"] for k, key in enumerate(at) for r in rows if r["hit"][k]}
    out: dict[str, list[float | None]] = {}
    for i, n in enumerate(names):
        out[n] = []
        for p in wanted[n]:
            if i not in ends:
                out[n].append(None)
                continue
            x = (ends[i][1] - 1) * p
            lo = value[(i, int(x))]
            out[n].append(lo + (value.get((i, int(x) + 1), lo) - lo) * (x - int(x)))
    return out


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], staged: Staged | None = None) -> list[float | None]:
    """Exact quantiles of one column (see column_quantiles)."""
    return column_quantiles(df, {column: probabilities}, staged)[column]
