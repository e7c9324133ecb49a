"""Writers: JSON lines, delimited files, partitioned sets and reports.

A writer that replaces writes beside its target first and then moves, so a failed job leaves the old files as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.operators.relational import upsert


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a new folder beside ``path``, then put it in its place."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tag = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{tag}", jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{tag}")
    try:
        write(new)
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"cannot move {path}")
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(new), target):
            fs.rename(old, target)
            raise OSError(f"cannot replace {path}")
        if had:
            fs.delete(old, True)
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(new), True)


def write_jsonl(df: DataFrame, path: str, nulls: bool = True, ascii_sorted: bool = False, order: list | None = None) -> None:
    """One JSON object a line, columns in order, or sorted by name with everything else than ASCII escaped.

    With ``order`` the lines of all files together, by file name, are in that order, so that equal data give equal files.
    """
    if order:
        df = df.orderBy(*order)
    columns = sorted(df.columns) if ascii_sorted else df.columns
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": str(not nulls).lower()})
    if ascii_sorted:
        units = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F]?$"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")))
        text = F.array_join(units, "")
    rows = df.select(text.alias("value"))
    replaced(df.sparkSession, path, lambda p: rows.write.text(p))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    replaced(df.sparkSession, path, lambda p: df.write.option("header", "true").option("escape", '"').csv(p))


def write_ranked_tsv(df: DataFrame, path: str, order: list, most: int = 10_000) -> None:
    """TSV of the first ``most`` rows in order with a rank from 1, in one file, for review queues."""
    top = df.orderBy(*order).limit(most)
    ranked = top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "*").orderBy("rank").coalesce(1)
    replaced(df.sparkSession, path, lambda p: ranked.write.option("header", "true").option("sep", "\t").csv(p))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """JSON files in a folder for each value of a column."""
    replaced(df.sparkSession, path, lambda p: df.write.partitionBy(by).json(p))


def update_partitioned(spark: SparkSession, path: str, schema: str, updates: DataFrame, key: str, by: str) -> None:
    """Apply updates to a partitioned set: a row moves with its new value of ``by``, and one without it is deleted."""
    main = spark.read.schema(schema).json(path)
    merged = upsert(main, updates.select(*main.columns), key).where(F.col(by).isNotNull())
    write_partitioned(merged, path, by)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def fan_out(df: DataFrame, folder: str, queues: dict) -> None:
    """Write the rows of each queue's condition to a folder of its name, from one pass over ``df``.

    A row in several queues is written to each; the partitioned write reads the input once.
    """
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in queues.items())))
    rows = df.withColumn("queue", F.explode(names))
    replaced(df.sparkSession, folder, lambda p: rows.write.partitionBy("queue").parquet(p))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of at most ``most`` rows, for reports of aggregates."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])
