"""Problem 5: the best value of each field in a group of duplicate records.

Method: skyline selection. Completeness, recency and trust span the dominance order; the Pareto-undominated records
of a group are computed by sort-filter sweeps, within partitions and then within groups, a lexicographic policy
resolves them, and fields that the first layer leaves null are filled from successive dominance layers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.store import Store


@dataclass(frozen=True)
class Field:
    """A field to survive. ``quality`` is its completeness, null where the record has no usable value; ``value`` is
    what survives and defaults to the record's identifier."""

    name: str
    quality: Column
    value: Column | None = None


def parse_time(text: Column) -> Column:
    """A UTC time from ``yyyy-MM-dd`` or ``yyyy/MM/dd``, optionally with a time; null if there is none."""
    parts = r"^\s*(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})(?:[T ]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?"
    day = F.concat_ws("-", *(F.regexp_extract(text, parts, i) for i in (1, 2, 3)))
    return F.concat_ws(" ", day, F.nullif(F.regexp_extract(text, parts, 4), F.lit(""))).try_cast("timestamp_ntz")


def _sweep(batches: Iterator[pd.DataFrame], dims: list[str]) -> Iterator[tuple[object, list[int]]]:
    """(batch, rows of it that no row dominates) for batches in order of group, then from the latest row to the earliest.

    A row is dominated by a later one of its group that is nowhere worse, so one pass suffices and a row that is kept
    stays. Only the undominated rows of the current group are held.
    """
    group, kept, seen = None, [], set()
    for batch in batches:
        rows = []
        for at, (own, *point) in enumerate(zip(batch["_group"], *(batch[d] for d in dims), strict=True)):
            if own != group:
                group, kept, seen = own, [], set()
            key = tuple(point)
            if key in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(key)
            if not any(all(a >= b for a, b in zip(other, key, strict=True)) for other in kept):
                kept.append(key)
                rows.append(at)
        yield batch, rows


def _undominated(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Each partition's own skyline, which takes no shuffle."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, kept in _sweep(batches, dims):
            yield batch.iloc[kept]

    return rows.sortWithinPartitions("_group", F.desc("_at"), F.desc("_id")).mapInPandas(local, rows.schema)


def _chosen(rows: DataFrame, dims: list[str], count: int) -> DataFrame:
    """(_group, w0, w1, ...): for each field the value of the first row by policy among a group's undominated ones."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, best, out = None, [None] * count, []
        for batch, kept in _sweep(batches, dims):
            part = batch.iloc[kept]
            columns = zip(part["_group"], part["_trust"], *(zip(part[f"_q{i}"], part[f"_v{i}"], strict=True) for i in range(count)), strict=True)
            for own, trust, *fields in columns:
                if own != group:
                    if group is not None:
                        out.append((group, *(b and b[1] for b in best)))
                    group, best = own, [None] * count
                for i, (quality, value) in enumerate(fields):
                    # rows come from the latest to the earliest, so that of equals the first one stays
                    if quality >= 0 and (best[i] is None or (quality, trust) > best[i][0]):
                        best[i] = (quality, trust), value
            if out:
                yield pd.DataFrame(out, columns=["_group", *(f"w{i}" for i in range(count))], dtype=object)
                out = []
        if group is not None:
            yield pd.DataFrame([(group, *(b and b[1] for b in best))], columns=["_group", *(f"w{i}" for i in range(count))], dtype=object)

    ordered = rows.repartition("_group").sortWithinPartitions("_group", F.desc("_at"), F.desc("_id"))
    return ordered.mapInPandas(choose, ", ".join([f"_group {kinds['_group']}", *(f"w{i} {kinds[f'_v{i}']}" for i in range(count))]))


def survivors(df: DataFrame, group: str, identifier: str, fields: list[Field], recency: Column, trust: Column, completeness: Column | None = None) -> DataFrame:
    """One row a group: ``group``, ``records`` (its number of rows), a column for each field and ``layers``.

    A record dominates another of its group if it is later (by ``recency``, null the earliest, then by identifier) and
    not worse in ``trust`` (null is false) and completeness. The completeness of a record is a number,
    ``completeness``, or, if none is given, the ``quality`` of each of its fields, with null below all others, as
    dimensions of their own. Of the undominated records that have a field, the policy takes the greatest quality, then
    trust, recency and identifier. Fields that stay null are filled from the next layer: the undominated ones among the
    group's records that have such a field; ``layers`` says how many were needed, at most one a field. Without
    ``completeness`` the first layer always fills every field that the group has, and the policy's choice is the best
    of all records. A field that no record has is null; rows with a null group are left out; an empty table gives no rows.

    Every partition first drops what its own records dominate, so a huge group arrives at its one task as a few records
    a partition; that task holds only the undominated ones.
    """
    store = Store(df.sparkSession, "survivors")
    count = len(fields)
    at = F.coalesce(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', _recency)"), F.lit(-(1 << 62)))
    rows = df.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_group"),
        F.col(identifier).alias("_id"),
        F.coalesce(trust.cast("int"), F.lit(0)).alias("_trust"),
        recency.cast("timestamp_ntz").alias("_recency"),
        (completeness.cast("long") if completeness is not None else F.lit(0).cast("long")).alias("_c"),
        *(F.coalesce(f.quality.cast("long"), F.lit(-1)).alias(f"_q{i}") for i, f in enumerate(fields)),
        *((f.value if f.value is not None else F.col(identifier)).alias(f"_v{i}") for i, f in enumerate(fields)),
    )
    rows = store.write(rows.withColumn("_at", at).drop("_recency").withColumn("_c", F.coalesce("_c", F.lit(-1))), "rows")
    dims = ["_trust", *(["_c"] if completeness is not None else [f"_q{i}" for i in range(count)])]
    found = rows.groupBy("_group").agg(F.count("*").alias("records"))
    picked = store.write(_chosen(_undominated(rows, dims), dims, count), "layer-1").withColumn("layers", F.lit(1))
    layer = 1
    while completeness is not None and layer < count:
        # what a group already has counts no more
        still = rows.join(picked, "_group").withColumns({f"_q{i}": F.when(F.col(f"w{i}").isNull(), F.col(f"_q{i}")).otherwise(-1) for i in range(count)})
        still = still.where(F.greatest(*(F.col(f"_q{i}") for i in range(count)), F.lit(-1)) >= 0).select(*rows.columns)
        layer += 1
        more = store.write(_chosen(_undominated(still, dims), dims, count), f"layer-{layer}")
        if more.isEmpty():
            break
        more = more.select("_group", *(F.col(f"w{i}").alias(f"x{i}") for i in range(count)), F.lit(layer).alias("next"))
        picked = picked.join(more, "_group", "left").select("_group", *(F.coalesce(f"w{i}", f"x{i}").alias(f"w{i}") for i in range(count)), F.coalesce("next", "layers").alias("layers"))
        picked = store.write(picked, f"picked-{layer}")
    return found.join(picked, "_group").select(F.col("_group").alias(group), "records", *(F.col(f"w{i}").alias(f.name) for i, f in enumerate(fields)), "layers")
