"""Per-key results without imbalance: value-frequency compression.

Rows are first grouped by (key, value), which spreads a hot key over all its values, and
only the weighted values are grouped by key. Distinct counts are then counts, modes are
the heaviest values, and exact percentiles come from running weights over a range partitioning
of (key, value), in which a hot key takes as many partitions as it needs.

Defined results: rows with a null key are ignored; null values count as rows but are no values;
ties of modes go to the least value; empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlquarry.session import materialize, shuffle_width


def weighted_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, weight): the distinct values of each key and their rows."""
    return df.select(key.alias("key"), value.alias("value")).where(F.col("key").isNotNull()).groupBy("key", "value").agg(F.count("*").alias("weight"))


def key_summary(weighted: DataFrame) -> DataFrame:
    """(key, rows, distinct, mode, mode_rows) from weighted values."""
    known = F.col("value").isNotNull()
    # max_by over the negated order isn't there for strings: the heaviest, then the least value, by a min of (-weight, value).
    best = F.min(F.when(known, F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))))
    return weighted.groupBy("key").agg(F.sum("weight").alias("rows"), F.count("value").alias("distinct"), best.alias("b")).select(
        "key", "rows", "distinct", F.col("b.v").alias("mode"), F.coalesce(-F.col("b.w"), F.lit(0)).alias("mode_rows")
    )


def percentiles(weighted: DataFrame, points: dict[str, float]) -> DataFrame:
    """(key, one column a point): exact nearest-rank percentiles from weighted values."""
    spark = weighted.sparkSession
    known = weighted.where(F.col("value").isNotNull())
    # The partition numbers must not change between uses, so the partitioned table is written.
    parts = materialize(known.repartitionByRange(shuffle_width(spark), "key", "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("key", "part").agg(F.sum("weight").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key", "part", before.alias("before"), F.sum("w").over(Window.partitionBy("key")).alias("n"))
    run = F.sum("weight").over(Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    cum = parts.join(sums, ["key", "part"]).select("key", "value", "n", (F.col("before") + run).alias("upto"), (F.col("before") + run - F.col("weight")).alias("below"))
    found = []
    for name, p in points.items():
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p)))
        found.append(F.min(F.when((F.col("below") < rank) & (F.col("upto") >= rank), F.col("value"))).alias(name))
    return cum.groupBy("key").agg(*found)


def in_ranges(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` with ``part``, the number of its range of (key, order): rows of a hot key lie in as many parts as it needs, in order of the parts.

    Written, since part numbers must not change between uses.
    """
    return materialize(df.repartitionByRange(shuffle_width(df.sparkSession), F.col(key), *order).withColumn("part", F.spark_partition_id()), "ranges")


def _with_before(parts: DataFrame, keys: list[str], amount: Column, name: str, how) -> DataFrame:
    """``parts`` with ``name``: what ``how`` makes of ``amount`` over the earlier parts of the same keys (null if there are none)."""
    per = parts.groupBy(*keys, "part").agg(amount.alias("amount_"))
    earlier = per.withColumn(name, how(F.col("amount_")).over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    right = earlier.select(*[F.col(k).alias(f"{k}_r") for k in keys], F.col("part").alias("part_r"), name)
    same = parts["part"] == right["part_r"]
    for k in keys:
        same = same & parts[k].eqNullSafe(right[f"{k}_r"])
    return parts.join(right, same, "left").drop(*[f"{k}_r" for k in keys], "part_r")


def ranked(parts: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """row_number over (keys, order) of a table from ``in_ranges`` whose key is among ``keys`` and whose order is the same.

    Rows are numbered inside their part and moved up by the rows of earlier parts, so no key is in one task.
    """
    moved = _with_before(parts, keys, F.count("*"), "before_", F.sum)
    local = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    return moved.withColumn(name, (local + F.coalesce("before_", F.lit(0))).cast("int")).drop("before_")


def running_max(parts: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Greatest ``value`` up to each row, over parts in the same way."""
    parts = parts.withColumn("value_", value)
    moved = _with_before(parts, keys, F.max("value_"), "before_", F.max)
    local = F.max("value_").over(Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return moved.withColumn(name, F.greatest(local, "before_")).drop("before_", "value_")


def heavy_keys(df: DataFrame, key: Column, value: Column, least_share_percent: int) -> DataFrame:
    """(key, distinct): keys with at least that share of all distinct values."""
    weighted = weighted_values(df, key, value).where(F.col("value").isNotNull())
    per_key = weighted.groupBy("key").agg(F.count("*").alias("distinct"))
    total = weighted.select("value").distinct().agg(F.count("*").alias("total")).scalar()
    return per_key.where(F.col("distinct") * 100 >= total * least_share_percent).select("key", "distinct")
