"""Problem 4: one group identifier for all records linked directly or through others.

Method: low-diameter decomposition. Vertices are records, joined by each key to its first one; clusters grow from
exponentially shifted start times, contract to super-vertices, the edges between clusters go to the next level, and the
assignments of all levels are composed. A level of few edges, and all after it, are worked off in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.store import Store

#: Rate of the exponential shifts: the waves of a level cut an edge with a chance of about 1 - exp(-RATE), and end after
#: about ln(vertices) / RATE rounds at most, or after the diameter of the largest group.
RATE = 0.1
#: Rounds of a wave that are planned at once; after each such batch its state is written and checked for changes.
BATCH = 8
#: Edges, both directions counted, from which a level's waves run as joins of tables. Up to that many, some 40 MB of
#: numbers, one task runs them: every round by joins costs the driver a plan, a job and threads, however small the table.
ONE_TASK = 1 << 18


def advisory_key(field: Column) -> Column:
    """The advisory id in a field, upper case; null for a placeholder or none."""
    found = F.upper(F.regexp_extract(field, r"(?i)GHSA(?:-[a-z0-9]{4}){3}", 0))
    return F.when((found != "") & (found != "GHSA-XXXX-XXXX-XXXX"), found)


def commit_key(field: Column) -> Column:
    """The commit of exactly 40 hexadecimal digits in a field, lower case; null for zeros or none."""
    found = F.lower(F.regexp_extract(field, r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40}(?![0-9A-Fa-f])", 0))
    return F.when((found != "") & (found != "0" * 40), found)


def _vertex(kind: str, value: Column) -> Column:
    """A 16-byte vertex: the digest of the kind of key and its value; null for null."""
    return F.unhex(F.md5(F.concat(F.lit(f"{kind}:"), value.cast("string"))))


def vertices(id_col: Column, keys: dict[str, Column]) -> Column:
    """The vertices of a row, its identifier first; keys that are null are left out."""
    return F.array_compact(F.array(_vertex("id", id_col), *(_vertex(k, v) for k, v in keys.items())))


def _shift(vertex: Column, level: int) -> Column:
    """The exponential shift of a vertex, from a hash so that a lost task draws it again."""
    uniform = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 40)) + F.lit(1)) / F.lit(float(1 << 40))
    return -F.log(uniform) / F.lit(RATE)


def _clusters(edges: DataFrame, level: int, store: Store) -> DataFrame:
    """(v, owner): each vertex of ``edges`` (both directions) with the cluster whose wave reaches it first.

    A wave from ``u`` starts at -shift(u) and moves one edge a round; arrival is the least of start plus distance over
    all ``u``. Only vertices that were reached anew send the wave on, and the waves run until none is, so that every
    vertex is in the cluster that reaches it first. The columns are numbers of fixed width, so that all aggregates
    hash, and a vertex keeps its state over an edge of no length to itself, so that a round is one join and one shuffle.
    """
    state = edges.select("v").distinct().select("v", (-_shift(F.col("v"), level)).alias("at"), F.col("v").alias("owner"), F.lit(True).alias("changed"))
    steps = edges.select("u", "v", F.lit(1).alias("far")).unionByName(edges.select(F.col("v").alias("u"), "v", F.lit(0).alias("far")).distinct())
    batch = 0
    while True:
        for _ in range(BATCH):
            sent = steps.join(state.withColumnRenamed("v", "u"), "u").where(F.col("changed") | (F.col("far") == 0))
            sent = sent.select("v", (F.col("at") + F.col("far")).alias("at"), "owner", F.when(F.col("far") == 0, F.col("at")).alias("old"))
            state = sent.groupBy("v").agg(F.min("at").alias("at"), F.min_by("owner", "at").alias("owner"), F.min("old").alias("old"))
            state = state.select("v", "at", "owner", (F.col("at") < F.col("old")).alias("changed"))
        state = store.write(state, f"wave-{level}-{batch}")
        if batch:
            store.drop(f"wave-{level}-{batch - 1}")
        batch += 1
        if state.where("changed").isEmpty():
            return state.select("v", "owner")


def _waves(u: np.ndarray, v: np.ndarray, count: int, level: int) -> np.ndarray:
    """The owner of each of the vertices 0 to ``count`` - 1 over edges in both directions, as in ``_clusters``."""
    at = -np.random.default_rng(level).exponential(1 / RATE, count)
    owner = np.arange(count)
    while True:
        arrival = at[u] + 1
        best = at.copy()
        np.minimum.at(best, v, arrival)
        won = (arrival < at[v]) & (arrival == best[v])
        if not won.any():
            return owner
        owner[v[won]], at = owner[u[won]], best


def _finished(edges: DataFrame, level: int) -> DataFrame:
    """(v, root) of ``edges`` (both directions) in one task: the waves of ``level`` and of all levels after it.

    The shifts come from a generator seeded by the level, over the vertices in order, so that a lost task draws them again.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch[["u", "v"]].to_numpy() for batch in batches]
        if not sum(map(len, parts)):
            return
        names, ends = np.unique(np.concatenate(parts), return_inverse=True)
        u, v = ends.reshape(-1, 2).T
        root, at = np.arange(len(names)), level
        while len(u):
            owner = _waves(u, v, len(names), at)
            root, at = owner[root], at + 1
            a, b = owner[u], owner[v]
            u, v = np.divmod(np.unique((a * len(names) + b)[a != b]), len(names))
        yield pd.DataFrame({"v": names, "root": names[root]})

    return edges.coalesce(1).mapInPandas(local, "v long, root long")


def components(links: DataFrame, store: Store) -> DataFrame:
    """(v, root) for every vertex of the undirected ``links`` (u, v), both numbers; tables are written each level."""

    def both(e: DataFrame) -> DataFrame:
        pairs = e.where(F.col("u") != F.col("v")).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        return pairs.select("e.u", "e.v").distinct()

    edges, levels = store.write(both(links), "edges-0"), []
    while edges.count() > ONE_TASK:
        level = len(levels)
        owners = _clusters(edges, level, store)
        levels.append(owners)
        tail = owners.select(F.col("v").alias("u"), F.col("owner").alias("a"))
        head = owners.select("v", F.col("owner").alias("b"))
        cut = edges.where(F.col("u") < F.col("v")).join(tail, "u").join(head, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = store.write(both(cut), f"edges-{level + 1}")
        store.drop(f"edges-{level}")
    # from the last levels, which are the smallest, to the first
    roots = store.write(_finished(edges, len(levels)), "roots")
    for owners in reversed(levels):
        upper = roots.select(F.col("v").alias("owner"), "root")
        roots = owners.join(upper, "owner", "left").select("v", F.coalesce("root", "owner").alias("root"))
    return roots


def consolidate(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """The groups of ``df``: (v, id, group_id), one row for each distinct first vertex of a row.

    Rows are linked if they share ``id_col`` or a key, directly or through others; null keys link nothing. A row
    without an identifier is known by its first key (its ``id`` is null) and links what shares its keys; a row with
    neither is in no group. ``group_id`` is the smallest identifier of the group in byte order, null if there is
    none. Repeated rows change nothing; an empty table gives no rows.
    """
    store = Store(df.sparkSession, "consolidate")
    rows = df.select(F.col(id_col).cast("string").alias("id"), vertices(F.col(id_col), keys).alias("vs")).where(F.size("vs") > 0)
    # rows with the same identifier and keys say the same; the distinct is combined before its shuffle
    rows = store.write(rows.distinct(), "rows")
    # records get numbers, which no two share as hashes might
    numbers = store.write(rows.select(F.col("vs")[0].alias("v"), "id").distinct().withColumn("n", F.monotonically_increasing_id()), "numbers")
    # a record without an identifier is named by a key, which links it like its others
    links = F.when(F.col("id").isNull(), F.col("vs")).otherwise(F.slice("vs", 2, len(keys)))
    pairs = rows.where(F.size(links) > 0).select(F.col("vs")[0].alias("v"), F.explode(links).alias("key")).distinct()
    pairs = store.write(pairs.join(numbers.select("v", "n"), "v").select("key", "n"), "pairs")
    # a key joins its records to the first of them, however many there are; the skew join splits a hot key
    first = pairs.groupBy("key").agg(F.min("n").alias("u"))
    linked = pairs.join(first, "key").where(F.col("n") != F.col("u")).select("u", F.col("n").alias("v"))
    roots = components(linked, store).withColumnRenamed("v", "n")
    members = store.write(numbers.join(roots, "n", "left").select("v", "id", F.coalesce("root", "n").alias("root")), "members")
    least = members.groupBy("root").agg(F.min("id").alias("group_id"))
    # the root of a huge group meets one row of `least`; the adaptive skew join splits its side
    groups = store.write(members.join(least, "root").select("v", "id", "group_id"), "groups")
    store.keep("groups")
    return groups
