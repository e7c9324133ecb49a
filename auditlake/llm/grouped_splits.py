"""Problem 1: train, validation and test splits that never divide the records of one author, source or entity.

Method: Borůvka-style minimum-edge contraction builds a spanning forest over the spellings and keys of all entities,
persisted as tables; its roots are stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.plans.store import Store

#: A root with more than one part in HEAVY_PARTS of all records is dealt by itself, so there are at most HEAVY_PARTS.
HEAVY_PARTS = 2000
#: Chunks in which the roots of one size band are ranked.
RANK_CHUNKS = 1024

_REPO = r"^\s*(?:[a-z][a-z0-9+.\-]*://)?(?:[^/@\s]*@)?(?:www\.)?([^/:@\s?#]+)(?::[0-9]+(?=/))?[:/]+([^/\s?#]+)/+([^/\s?#]+)"


def repo_key(url: Column) -> Column:
    """``host/owner/name`` in lower case from any spelling of a repository; null if it names none."""
    low = F.lower(url)
    part = [F.regexp_extract(low, _REPO, i) for i in (1, 2, 3)]
    name = F.regexp_replace(part[2], r"\.git$", "")
    return F.when((part[0] != "") & (name != ""), F.concat_ws("/", part[0], part[1], name))


def split_key(split: Column) -> Column:
    """``train``, ``val`` or ``test`` from any spelling; null if there is none."""
    low = F.lower(F.regexp_replace(split, r"[^A-Za-z]+", ""))
    return (
        F.when(low.isin("train", "training"), "train")
        .when(low.isin("val", "valid", "validation", "dev", "development", "eval"), "val")
        .when(low.isin("test", "testing"), "test")
    )


def _contract(edges: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Borůvka rounds over ``edges`` (u, v, weight): (vertex, root) and the forest's edges, both written tables.

    A round gives each component its lightest edge (ties by its ends, so that the choice is a total order and two
    components can only choose each other), hooks it along that edge and contracts the hooked chains.
    """
    live = store.write(edges.where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.min("weight").alias("weight")), "live-0")
    roots: DataFrame | None = None
    forest: list[DataFrame] = []
    level = 0
    while not live.isEmpty():
        edge = F.struct("weight", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
        ends = live.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("to"), edge.alias("e")), F.struct(F.col("v").alias("c"), F.col("u").alias("to"), edge.alias("e")))).alias("s")).select("s.*")
        chosen = store.write(ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e"), f"chosen-{level}")
        forest.append(chosen.select(F.col("e.x").alias("u"), F.col("e.y").alias("v"), F.col("e.weight").alias("weight")).distinct())
        # of two components that chose each other the smaller becomes the root; every other one hooks
        back = chosen.select(F.col("c").alias("to"), F.col("to").alias("c2"))
        hooked = store.write(
            chosen.join(back, "to", "left").select("c", F.when((F.col("c2") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")),
            f"hook-{level}-0",
        )
        jump = 0
        while True:
            up = hooked.select(F.col("c").alias("p"), F.col("p").alias("g"))
            jump += 1
            jumped = store.write(hooked.join(up, "p").select("c", F.col("g").alias("p"), (F.col("p") != F.col("g")).alias("moved")), f"hook-{level}-{jump}")
            if jumped.where("moved").isEmpty():
                break
            hooked = jumped.select("c", "p")
        if roots is None:
            roots = hooked.select(F.col("c").alias("vertex"), F.col("p").alias("root"))
        else:
            up = hooked.select(F.col("c").alias("root"), "p")
            roots = roots.join(up, "root", "left").select("vertex", F.coalesce("p", "root").alias("root"))
        roots = store.write(roots, f"roots-{level}")
        a, b = (hooked.select(F.col("c").alias(x), F.col("p").alias(f"{x}2")) for x in "uv")
        moved = live.join(a, "u").join(b, "v").where(F.col("u2") != F.col("v2"))
        level += 1
        live = store.write(moved.groupBy(F.col("u2").alias("u"), F.col("v2").alias("v")).agg(F.min("weight").alias("weight")), f"live-{level}")
    if roots is None:
        return live.select(F.col("u").alias("vertex"), F.col("v").alias("root")), live
    whole = forest[0]
    for more in forest[1:]:
        whole = whole.unionByName(more)
    return roots, store.write(whole, "forest")


def entity_groups(df: DataFrame, identifier: Column, entities: dict[str, tuple[Column, Column]], store: Store, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with the root of their group, (id, root, key), and the spanning forest as (u, v, weight).

    ``prior`` is the forest of an earlier run, (u, v, weight) of the same types: its edges count too, so that new
    records join the groups they had then without reading the old ones again.

    ``entities`` gives each kind of entity by its raw spelling and its key. Vertices are ``kind:key`` and, apart from
    it, every spelling; an edge links a spelling to its key, and the keys of different kinds that one record names.
    Its weight is the smallest identifier that shows the link. A record that names no entity is a group of its own,
    with the root ``record:id`` and a null ``key``; the first kind gives ``key``.
    """
    names = list(entities)
    raws = [F.when(entities[k][1].isNotNull(), F.concat(F.lit(f"{k}~"), entities[k][0])) for k in names]
    keys = [F.concat(F.lit(f"{k}:"), entities[k][1]) for k in names]
    rows = df.select(identifier.alias("id"), entities[names[0]][1].alias("key"), F.array_compact(F.array(*raws)).alias("raws"), F.array_compact(F.array(*keys)).alias("keys"))
    pairs = F.transform(F.arrays_zip("raws", "keys"), lambda x: F.struct(x["raws"].alias("u"), x["keys"].alias("v")))
    chain = F.transform(F.sequence(F.lit(1), F.size("keys") - 1), lambda i: F.struct(F.col("keys")[0].alias("u"), F.get("keys", i).alias("v")))
    links = F.when(F.size("keys") > 1, F.concat(pairs, chain)).otherwise(pairs)
    edges = rows.where(F.size("keys") > 0).select("id", F.explode(links).alias("e")).groupBy("e.u", "e.v").agg(F.min("id").alias("weight"))
    roots, forest = _contract(edges if prior is None else edges.unionByName(prior), store)
    # a spelling appears once for each kind, so this side has one row a spelling; a hot one is split by the skew join
    named = rows.where(F.size("keys") > 0).select("id", F.col("raws")[0].alias("vertex"), "key")
    known = named.join(roots, "vertex").select("id", "root", "key")
    alone = rows.where(F.size("keys") == 0).select("id", F.concat(F.lit("record:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("root"), "key")
    return store.write(known.unionByName(alone), "records"), forest


def _deal_heavy(part: pd.DataFrame) -> pd.DataFrame:
    """The largest roots first, each to the split that lacks most of its share."""
    shares = sorted(zip(part["splits"].iloc[0], part["shares"].iloc[0], strict=True))
    total = float(part["total"].iloc[0])
    lacks = {s: share * total for s, share in shares}
    rows = []
    for root, size in sorted(zip(part["root"], part["size"], strict=True), key=lambda x: (-x[1], x[0])):
        to = max(lacks, key=lambda s: (lacks[s], s))
        lacks[to] -= size
        rows.append((root, size, to))
    return pd.DataFrame(rows, columns=["root", "size", "split"])


def _light_splits(light: DataFrame, shares: DataFrame, store: Store) -> DataFrame:
    """Deal the roots of each size band systematically: in hash order, at even steps of the bands' cumulated size.

    The running size is found in two steps, by chunks of the hash order and within them, so that no task holds a
    band. ``shares`` has (split, lower, upper), the wanted intervals of the unit range.
    """
    chunked = light.withColumns(
        {"band": F.floor(F.log2("size")).cast("int"), "at": F.xxhash64("root")}
    ).withColumn("chunk", F.shiftrightunsigned("at", 54).cast("int"))
    sums = chunked.groupBy("band", "chunk").agg(F.sum("size").alias("mass"))
    # at most RANK_CHUNKS rows for each of at most 63 bands
    before = Window.orderBy("band", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("band", "chunk", F.coalesce(F.sum("mass").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("band", "chunk").orderBy("at", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.join(F.broadcast(offsets), ["band", "chunk"]).select(
        "root", "size", (F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2).alias("middle")
    )
    # steps of the golden ratio deal every stretch of the order in the wanted shares
    step = F.pmod(F.col("middle") / F.greatest(F.lit(1.0), F.col("mean")) * F.lit(0.6180339887498949), F.lit(1.0))
    mean = light.agg(F.avg("size").alias("mean"))
    dealt = placed.join(F.broadcast(mean)).withColumn("step", step)
    return dealt.join(F.broadcast(shares), (F.col("step") >= F.col("lower")) & (F.col("step") < F.col("upper"))).select("root", "size", "split")


def grouped_splits(df: DataFrame, id_col: str, entities: dict[str, tuple[Column, Column]], targets: DataFrame) -> DataFrame:
    """(``id_col``, new_split): every record with its split; records linked through entities share one.

    ``targets`` has (split, share), at most a few rows; shares are scaled to sum to 1. Roots that hold more than one
    part in HEAVY_PARTS of the records are dealt first, the others to what then is lacking. A record that names no
    entity is dealt by itself; rows with equal identifiers get the same split if they name the same entities; a null
    identifier is dealt like any other. An empty table gives no rows.
    """
    store = Store(df.sparkSession, "splits")
    records, _ = entity_groups(df, F.col(id_col), entities, store)
    sizes = store.write(records.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.sum("size").alias("total"))
    wanted = targets.where(F.col("share") > 0).agg(F.collect_list("split").alias("splits"), F.collect_list("share").alias("shares"), F.sum("share").alias("all"))
    wanted = wanted.select("splits", F.transform("shares", lambda x: x / F.col("all")).alias("shares"))
    marked = sizes.join(F.broadcast(total)).withColumn("heavy", F.col("size") * HEAVY_PARTS > F.col("total"))
    heavy = marked.where("heavy").join(F.broadcast(wanted))
    # at most HEAVY_PARTS roots
    dealt = store.write(heavy.groupBy("total").applyInPandas(_deal_heavy, "root string, size long, split string"), "heavy")
    given = dealt.groupBy("split").agg(F.sum("size").alias("given"))
    target = wanted.select(F.explode(F.arrays_zip("splits", "shares")).alias("t")).select(F.col("t.splits").alias("split"), F.col("t.shares").alias("share"))
    lack = target.join(given, "split", "left").join(F.broadcast(total)).select("split", F.greatest(F.lit(0.0), F.col("share") * F.col("total") - F.coalesce("given", F.lit(0))).alias("lack"))
    upto = Window.orderBy("split")
    edges = lack.select("split", F.sum("lack").over(upto).alias("to"), F.col("lack"), F.sum("lack").over(Window.partitionBy()).alias("all"))
    shares = store.write(
        edges.where(F.col("all") > 0).select("split", ((F.col("to") - F.col("lack")) / F.col("all")).alias("lower"), F.when(F.col("to") >= F.col("all"), 2.0).otherwise(F.col("to") / F.col("all")).alias("upper")),
        "shares",
    )
    store.keep("records", "sizes", "heavy", "shares")
    light = marked.where(~F.col("heavy")).select("root", "size")
    splits = dealt.unionByName(_light_splits(light, shares, store))
    return records.join(splits.select("root", "split"), "root").select(F.col("id").alias(id_col), F.col("split").alias("new_split"))


def spanning_forest(df: DataFrame, id_col: str, entities: dict[str, tuple[Column, Column]], path: str | None = None, prior: DataFrame | None = None) -> DataFrame:
    """(u, v, weight): the forest over spellings and keys; with ``path`` it is kept there for later runs to extend."""
    store = Store(df.sparkSession, "forest")
    _, forest = entity_groups(df, F.col(id_col), entities, store, prior)
    store.keep("forest", "live-0")
    if path:
        forest.write.mode("errorifexists").parquet(path)
        forest = df.sparkSession.read.parquet(path)
    return forest


def divided_groups(df: DataFrame, id_col: str, entities: dict[str, tuple[Column, Column]], split: Column) -> DataFrame:
    """(key): groups whose records, as delivered, lie in more than one split.

    Rows whose split is null, and records that name no entity, don't count. The groups are those of the spanning
    forest, so every spelling of a key counts for it.
    """
    store = Store(df.sparkSession, "divided")
    identifier = F.struct(F.col(id_col).alias("_row"), split.alias("_split"))
    records, _ = entity_groups(df.where(split.isNotNull()), identifier, entities, store)
    store.keep("records")
    groups = records.where(F.col("key").isNotNull()).groupBy("root").agg(F.min("key").alias("key"), F.count_distinct("id._split").alias("n"))
    return groups.where(F.col("n") >= 2).select("key")
