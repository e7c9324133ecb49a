"""Order-aware relational operators. Rows have no order of their own, so each takes the column that gives one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.plans.skew import rank_within


def _packed(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of each key with the smallest ordinal.

    An aggregation, not a window: partial minima are combined before the shuffle, so a hot key is no hot task.
    """
    return df.groupBy(*keys).agg(F.min_by(_packed(df), F.col(ordinal)).alias("_row")).select("_row.*")


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of each key with the largest ordinal."""
    return df.groupBy(*keys).agg(F.max_by(_packed(df), F.col(ordinal)).alias("_row")).select("_row.*")


def owners(df: DataFrame, key: str, identifier: str, ordinal: str) -> DataFrame:
    """(identifier, owner): rows whose key an earlier row has, with the identifier of the first one."""
    rows = df.select(F.col(key).alias("k"), F.col(identifier).alias("i"), F.col(ordinal).alias("at"))
    first = rows.groupBy("k").agg(F.min(F.struct(F.col("at").alias("first_at"), F.col("i").alias("owner"))).alias("f"), F.count("*").alias("n")).where(F.col("n") > 1)
    return rows.join(first.select("k", "f.first_at", "f.owner"), "k").where(F.col("at") > F.col("first_at")).select(F.col("i").alias(identifier), "owner")


def carry_forward(value: str, group: str, ordinal: str) -> Column:
    """The last value that isn't null up to the row, in its group."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))


#: Arrivals of a chunk in which rows are ranked.
STRETCH = 100_000


def running_ids(df: DataFrame, group: str, ordinal: str, prefix: str, name: str = "new_id") -> DataFrame:
    """Identifiers ``prefix-group-01``, ``-02`` and so on in each group, ranked by stretches of arrival numbers."""
    ranked = rank_within(df, [group], [ordinal], F.floor(F.col(ordinal) / STRETCH), "_rank")
    return ranked.withColumn(name, F.format_string(f"{prefix}-%s-%02d", F.coalesce(F.col(group), F.lit("none")), F.col("_rank"))).drop("_rank")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of all sources, with the source's name and place; columns that one lacks are null."""
    tagged = [df.withColumns({"source_name": F.lit(name), "source_ordinal": F.lit(i)}) for i, (name, df) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def upsert(main: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The rows of ``main``, replaced by those of ``updates`` with their key, and the rest of ``updates``.

    Keys are unique on either side.
    """
    columns = [c for c in main.columns if c != key]
    m = main.select(key, *(F.col(c).alias(f"_m_{c}") for c in columns), F.lit(True).alias("_m"))
    u = updates.select(key, *(F.col(c).alias(f"_u_{c}") for c in columns), F.lit(True).alias("_u"))
    return m.join(u, key, "full_outer").select(key, *(F.when(F.col("_u"), F.col(f"_u_{c}")).otherwise(F.col(f"_m_{c}")).alias(c) for c in columns))


def anti_either(df: DataFrame, seen: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of ``df`` none of whose keys is in the table of seen keys at its place; a null key is in none."""
    for other, key in zip(seen, keys, strict=True):
        df = df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return df


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side and the number of its rows."""
    counts = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    sides = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((F.col("a") == 0) | (F.col("b") == 0))
    return sides.select(key, F.when(F.col("a") > 0, "left").otherwise("right").alias("side"), (F.col("a") + F.col("b")).alias("rows"))


def multiset_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of rows differ between the sides."""
    counts = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return counts.groupBy(key).agg(F.sum("a").alias("left_rows"), F.sum("b").alias("right_rows")).where(F.col("left_rows") != F.col("right_rows"))


def conflicts_with_first(df: DataFrame, keys: list[str], value: Column, ordinal: str) -> DataFrame:
    """Later rows of a key whose value differs from that of its first row, with both values; nulls are equal."""
    rows = df.withColumn("_value", value)
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(F.col("_value").alias("v")), F.col(ordinal)).alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    joined = rows.join(first, keys)
    return joined.where(~F.col("_value").eqNullSafe(F.col("_first.v"))).select(*df.columns, F.col("_first.v").alias("first_value"), F.col("_value").alias("own_value"))


def conflicting_keys(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys with more than one value, with the number of values."""
    return df.withColumn("_value", value).groupBy(*keys).agg(F.count_distinct("_value").alias("values_seen")).where(F.col("values_seen") > 1)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows): the keys of both sides; null keys are in none."""
    left = a.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("left_rows"))
    right = b.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("right_rows"))
    return left.join(right, key)


def enclosing(points: DataFrame, intervals: DataFrame, group: str, at: str, start: str, end: str, pick: str = "outermost") -> DataFrame:
    """Each point with one interval of its group that contains it: ``outermost`` (smallest start), ``innermost``
    (shortest, then the later start) or ``first`` (smallest ``position`` of the interval). Points in none are left out.

    ``outermost`` takes two sorted sweeps of a group and no join: of the intervals only those count that reach beyond
    all that start before them, and of these the first that ends at or after the point. The others join on the group.
    """
    if pick == "outermost":
        return _outermost(points, intervals, group, at, start, end)
    order = {
        "innermost": F.struct(F.col(end) - F.col(start), -F.col(start)),
        "first": F.struct(F.col("position")) if "position" in intervals.columns else F.struct(F.col(start)),
    }[pick]
    hits = points.join(intervals, group).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    extra = [c for c in intervals.columns if c != group]
    keys = points.columns
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*extra), order).alias("_i")).select(*keys, "_i.*")


def _outermost(points: DataFrame, intervals: DataFrame, group: str, at: str, start: str, end: str) -> DataFrame:
    extra = [c for c in intervals.columns if c != group]
    reach = F.max(end).over(Window.partitionBy(group).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1))
    leading = intervals.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col(end) > F.col("_reach")))
    own = [c for c in points.columns if c != group]
    ends = leading.select(F.col(group), F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.struct(*extra).alias("_i"))
    asked = points.select(F.col(group), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(*own).alias("_p"))
    both = asked.unionByName(ends, allowMissingColumns=True)
    # a point comes before the end of an interval at the same place, which still contains it
    nearest = F.first("_i", ignorenulls=True).over(Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_i", nearest).where((F.col("_kind") == 0) & (F.col(f"_i.{start}") <= F.col("_at")))
    return found.select(group, *(F.col(f"_p.{c}").alias(c) for c in own), "_i.*").select(*points.columns, *extra)


def forward_as_of(group: str, ordinal: str, wanted: Column) -> Column:
    """The ordinal of the next row after this one, in its group, for which ``wanted`` holds."""
    return F.min(F.when(wanted, F.col(ordinal))).over(Window.partitionBy(group).orderBy(ordinal).rowsBetween(1, Window.unboundedFollowing))


def stratified_holdout(df: DataFrame, stratum: str, identifier: str, seed: str, share: float) -> DataFrame:
    """``df`` with ``held_out``: in each stratum the first rounded share, at least one row, in the order of the
    seeded digest of the identifier. Strata are ranked by the first bytes of the digest, so none is one task."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string")), 256)
    rows = df.withColumn("_digest", digest)
    ranked = rank_within(rows, [stratum], ["_digest", identifier], F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"), "_rank")
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_size"))
    held = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_size") * share + 0.5))
    return ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).select(*df.columns, held.alias("held_out"))


def top_counts(df: DataFrame, value: str, ordinal: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; ties go to the value that appears first."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def fold_merge(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: rows are taken in order, a later one whose JSON is longer replaces the earlier one and takes
    its values where its own are null; any other is dropped whole. Null keys are left out.

    Only rows that are longer than all before them can count, so the group is first reduced to one row for each
    length; the fold then runs over at most as many rows as there are lengths.
    """
    fields = [c for c in df.columns if c not in (key, ordinal)]
    size = F.length(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    rows = df.where(F.col(key).isNotNull()).withColumn("_size", size)
    rows = rows.groupBy(key, "_size").agg(F.min_by(F.struct(ordinal, *fields), F.col(ordinal)).alias("_row"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(f"_row.{ordinal}").alias("o"), F.col("_size").alias("s"), F.col("_row").alias("r"))))
    start = F.element_at("_rows", 1)

    def step(kept: Column, new: Column) -> Column:
        filled = F.struct(new["r"][ordinal].alias(ordinal), *(F.coalesce(new["r"][f], kept["r"][f]).alias(f) for f in fields))
        merged = F.struct(new["o"].alias("o"), F.length(F.to_json(filled.dropFields(ordinal), {"ignoreNullFields": "false"})).alias("s"), filled.alias("r"))
        return F.when(new["s"] > kept["s"], merged).otherwise(kept)

    grouped = rows.groupBy(key).agg(ordered.alias("_rows"))
    return grouped.select(key, F.aggregate(F.slice("_rows", F.lit(2), F.size("_rows")), start, step).alias("_kept")).select(key, f"_kept.r.{ordinal}", *(f"_kept.r.{f}" for f in fields))


def lookup_status(df: DataFrame, other: DataFrame, key: str, usable: Column) -> DataFrame:
    """``df`` with ``status``: ``attached`` if ``other`` has its key and is usable, ``invalid`` if not usable, else
    ``missing``. Keys of ``other`` are unique; a null key is missing."""
    side = other.select(key, usable.alias("_usable"))
    status = F.when(F.col("_usable").isNull(), "missing").when(F.col("_usable"), "attached").otherwise("invalid")
    return df.join(side, key, "left").select(*df.columns, status.alias("status"))


def positional_split(df: DataFrame, group: str, ordinal: str, counts: dict[str, int]) -> DataFrame:
    """``df`` with ``split``: in each group the first rows to the first split, and so on; later rows have null.

    Rows are ranked by stretches of arrival numbers, so a hot group is not one task.
    """
    ranked = rank_within(df, [group], [ordinal], F.floor(F.col(ordinal) / STRETCH), "_rank")
    out, upto = F.lit(None).cast("string"), sum(counts.values())
    for name, n in reversed(counts.items()):
        out = F.when(F.col("_rank") <= upto, name).otherwise(out)
        upto -= n
    return ranked.withColumn("split", out).drop("_rank")


def expanded(templates: DataFrame, names: DataFrame, group: str, ordinal: str, most: int) -> DataFrame:
    """Every template with every name, the first ``most`` of each group by template and name.

    Only the first ``most`` names and, in each group, templates can be among these, so both are cut before they are
    multiplied: at most ``most`` squared rows a group, and ``most`` names are broadcast.
    """
    first = names.orderBy(*names.columns).limit(most)
    heads = rank_within(templates, [group], [ordinal], F.floor(F.col(ordinal) / STRETCH), "_head").where(F.col("_head") <= most).drop("_head")
    rows = heads.crossJoin(F.broadcast(first))
    place = F.row_number().over(Window.partitionBy(group).orderBy(ordinal, *names.columns))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def unique_index(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` if every row has a key of its own; using the rows of any other fails with the key at fault.

    One combined aggregation looks for an empty or repeated key, and its single row is joined to all.
    """
    counts = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    bad = counts.where(F.coalesce(F.col("_k").cast("string"), F.lit("")).isin("") | (F.col("_n") > 1)).agg(F.min(F.coalesce(F.col("_k").cast("string"), F.lit(""))).alias("_bad"))
    checked = F.when(F.col("_bad").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{label}: empty or repeated key: "), "_bad")).cast(df.schema[key].dataType))
    return df.crossJoin(F.broadcast(bad)).withColumn(key, checked).select(*df.columns)
