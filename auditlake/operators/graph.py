"""Connected groups of rows by shared keys, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.store import Store


def connected_groups(df: DataFrame, ordinal: str, keys: list[Column]) -> DataFrame:
    """(ordinal, group): rows that share any key are in one group, named by its smallest ordinal.

    Null keys link nothing. Each key links its rows to their smallest ordinal (a combined aggregation, no pairs);
    labels then move to the smallest neighbour and jump to their label's label until nothing changes.
    """
    store = Store(df.sparkSession, "groups")
    rows = store.write(df.select(F.col(ordinal).alias("o"), F.array_compact(F.array(*(F.concat(F.lit(f"{i}:"), k.cast("string")) for i, k in enumerate(keys)))).alias("ks")), "rows")
    pairs = rows.select("o", F.explode("ks").alias("k"))
    first = pairs.groupBy("k").agg(F.min("o").alias("f"), F.count("*").alias("n")).where(F.col("n") > 1)
    edges = pairs.join(first, "k").where(F.col("o") != F.col("f")).select("o", "f").distinct()
    edges = store.write(edges.unionByName(edges.select(F.col("f").alias("o"), F.col("o").alias("f"))), "edges")
    labels = store.write(rows.select("o", F.col("o").alias("label")), "labels-0")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        near = edges.join(labels.select(F.col("o").alias("f"), "label"), "f").groupBy("o").agg(F.min("label").alias("near"))
        moved = labels.join(near, "o", "left").select("o", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("o").alias("to"), F.col("label").alias("jumped"))
        new = moved.join(jump, "to").select("o", F.least("to", "jumped").alias("label"), (F.least("to", "jumped") < F.col("label")).alias("changed"))
        new = store.write(new, f"labels-{turn}")
        labels = new.select("o", "label")
        if new.where("changed").isEmpty():
            break
        if turn > 1:
            store.drop(f"labels-{turn - 2}")
    return labels.select(F.col("o").alias(ordinal), F.col("label").alias("group"))


def keep_strongest(df: DataFrame, ordinal: str, keys: list[Column], strength: Column) -> DataFrame:
    """One row for each connected group: the strongest, of equals the earliest."""
    grouped = df.join(connected_groups(df, ordinal, keys), ordinal)
    row = F.struct(*df.columns, "group")
    return grouped.groupBy("group").agg(F.max_by(row, F.struct(strength, -F.col(ordinal))).alias("_row")).select("_row.*")


def greedy_two_keys(df: DataFrame, ordinal: str, first: str, second: str) -> DataFrame:
    """Rows in order, each kept if neither of its keys was kept before; a dropped row reserves no key.

    A null first key neither blocks nor is blocked. The rule is sequential only along shared keys, so rounds decide
    many rows at once: a row that is the earliest undecided one of both its keys is kept, and what shares a key with
    a kept row is dropped. The earliest undecided row is always such a row, so every round decides some.
    """
    store = Store(df.sparkSession, "greedy")
    open_rows = store.write(df.select(F.col(ordinal).alias("o"), F.col(first).alias("a"), F.col(second).alias("b")), "open-0")
    kept: list[DataFrame] = []
    turn = 0
    while not open_rows.isEmpty():
        lead_a = open_rows.where(F.col("a").isNotNull()).groupBy("a").agg(F.min("o").alias("la"))
        lead_b = open_rows.where(F.col("b").isNotNull()).groupBy("b").agg(F.min("o").alias("lb"))
        marked = open_rows.join(lead_a, "a", "left").join(lead_b, "b", "left").select("o", "a", "b", ((F.coalesce("la", "o") == F.col("o")) & (F.coalesce("lb", "o") == F.col("o"))).alias("keep"))
        marked = store.write(marked, f"marked-{turn}")
        chosen = marked.where("keep").select("o", "a", "b")
        kept.append(chosen)
        rest = marked.where(~F.col("keep")).select("o", "a", "b")
        rest = rest.join(chosen.where(F.col("a").isNotNull()).select("a").distinct(), "a", "left_anti").join(chosen.where(F.col("b").isNotNull()).select("b").distinct(), "b", "left_anti")
        turn += 1
        open_rows = store.write(rest, f"open-{turn}")
    if not kept:
        return df
    whole = kept[0]
    for more in kept[1:]:
        whole = whole.unionByName(more)
    return df.join(whole.select(F.col("o").alias(ordinal)), ordinal, "left_semi")


def zip_entries(df: DataFrame, path: str = "path", content: str = "content", most_entries: int = 400, most_bytes: int = 2_000_000, most_files: int = 60, most_total: int = 20_000_000) -> DataFrame:
    """(path, entry, bytes, skipped): the entries of zip archives; ``skipped`` says why one has no bytes.

    Of each archive at most ``most_entries`` entries are looked at, and at most ``most_files`` of at most ``most_total``
    bytes together are read; these limits guard against archives that blow up.
    """
    import io
    import zipfile

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(row[1]))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(row[0], "", None, "not_a_zip")], columns=["path", "entry", "bytes", "skipped"])
                    continue
                files = total = 0
                for i, info in enumerate(archive.infolist()):
                    if info.is_dir():
                        continue
                    parts = info.filename.replace("\\", "/").split("/")
                    why = "too_many" if i >= most_entries else "outside" if info.filename.startswith("/") or ".." in parts else "too_large" if info.file_size > most_bytes else "too_many_files" if files >= most_files else "too_much" if total + info.file_size > most_total else None
                    data = None if why else archive.read(info)
                    if data is not None and b"\0" in data:
                        data, why = None, "binary"
                    if data is not None:
                        files, total = files + 1, total + len(data)
                    out.append((row[0], info.filename, data, why))
                yield pd.DataFrame(out, columns=["path", "entry", "bytes", "skipped"])

    return df.select(path, content).mapInPandas(unpack, "path string, entry string, bytes binary, skipped string")
