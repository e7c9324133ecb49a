"""Helpers for keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it holds at least one part in HOT_PARTS of all rows, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1000
#: A key with a single row is never hot.
HOT_FLOOR = 2
#: Buckets of the first, coarse count; far more than HOT_PARTS, so nearly every bucket is ruled out at once.
BUCKETS = 1 << 16


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS, floor: int = HOT_FLOOR) -> DataFrame:
    """The exact keys with at least ``floor`` rows and one part in ``parts`` of all rows, with their counts.

    Partial counts decide in two steps, neither of which shuffles rows: counts of hash buckets (map-side combined to
    at most BUCKETS rows a task) rule out every bucket that is too small to hold a hot key, then only the rows of
    the remaining buckets are counted by key. At most ``parts`` keys come out, whatever the input, so the result may
    be broadcast. Null keys never count.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    least = sizes.agg(F.greatest(F.lit(floor), F.ceil(F.sum("_n") / parts)).alias("_least"))
    large = sizes.join(F.broadcast(least), F.col("_n") >= F.col("_least")).select("_bucket", "_least")
    return (
        rows.join(F.broadcast(large), "_bucket")
        .groupBy(key, "_least")
        .agg(F.count("*").alias("hot_rows"))
        .where(F.col("hot_rows") >= F.col("_least"))
        .select(key, "hot_rows")
    )


def two_level_agg(df: DataFrame, key: str, spread: str, partial: list[Column], final: list[Column], salts: int = 64) -> DataFrame:
    """Aggregate by ``key``: rows of hot keys by (key, salt) and then by key, all others in one level.

    ``partial`` are the aggregates over rows, ``final`` those that merge partial results of the same names. ``spread``
    is the column whose hash gives the salt.
    """
    hot = F.broadcast(hot_keys(df, key).select(key))
    salted = (
        df.join(hot, key)
        .groupBy(key, F.pmod(F.xxhash64(spread), F.lit(salts)).alias("_salt"))
        .agg(*partial)
        .groupBy(key)
        .agg(*final)
    )
    return df.join(hot, key, "left_anti").groupBy(key).agg(*partial).unionByName(salted)


def spread(df: DataFrame, by: str) -> DataFrame:
    """The rows of a scan over all cores, where its files have fewer splits than that; else as they are.

    For work that costs far more than moving its rows. A table of many splits, as on a cluster, is never shuffled, nor
    is anything but a scan: what has an exchange of its own is planned adaptively and would run to be counted.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = execution.toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores, by)


def rank_within(df: DataFrame, groups: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1, by ``order``.

    ``chunk`` is a number that never falls in this order. Rows are ranked within (group, chunk), and the counts of the
    chunks before are added, so a hot group is spread over as many tasks as it has chunks. Null is a group of its own.
    """
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy(*groups, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_chunk").alias("_c"), before.alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*groups, "_chunk").orderBy(*order)))
    same = F.col("_chunk") == F.col("_c")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(offsets, same).select(*df.columns, (F.col("_place") + F.col("_before")).cast("int").alias(name))
