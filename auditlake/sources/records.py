"""Record files: JSON lines, JSON documents, advisories, CSV, labels; and the rule catalogue."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.plans.skew import rank_within
from auditlake.plans.store import Store

# Keys that hold lists of records in JSON documents and advisory files.
CONTAINERS = ["records", "items", "findings", "results", "data", "samples"]
ADVISORY_WRAPPERS = ["advisories", "vulnerabilities", "vulns", "items", "data"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Records of JSON lines with their raw text as ``_raw``; blank lines are skipped.

    Lenient: lines that aren't objects are skipped and a missing file is empty. Strict: any such line, or no record,
    raises when the rows are used.
    """
    if not _exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], "_raw string").select("_raw", F.from_json("_raw", schema).alias("r")).select("_raw", "r.*")
    rows = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "_raw")
    is_object = F.json_object_keys("_raw").isNotNull()
    if strict:
        if rows.isEmpty():
            raise ValueError(f"{path}: no records")
        checked = F.when(is_object, F.col("_raw")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: not an object: "), F.substring("_raw", 1, 80))))
        rows = rows.select(checked.alias("_raw"))
    else:
        rows = rows.where(is_object)
    return rows.select("_raw", F.from_json("_raw", schema).alias("r")).select("_raw", "r.*")


def numbered(df: DataFrame) -> DataFrame:
    """Rows of files with ``source_file`` and ``ordinal``: by file, then by the place in the file.

    Places are ranked by the blocks in which a file is read, so a large file is not one task.
    """
    place = df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return rank_within(place, ["source_file"], ["_block", "_at"], F.col("_block"), "ordinal").drop("_block", "_at")


def flattened(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """(keep..., locator, record): the records of JSON documents, each with its place such as ``root.items[3]``.

    A list gives its objects; an object with lists of objects under container keys gives those; any other object is a
    record. Containers may be nested to any depth; a table is written for each level.
    """
    store = Store(df.sparkSession, "flattened")
    level = df.select(*keep, F.lit("root").alias("locator"), F.col(raw).alias("record"))
    done, depth = None, 0
    while True:
        is_list = F.col("record").rlike(r"^\s*\[")
        inner = [(k, F.from_json(F.get_json_object("record", f"$.{k}"), "array<string>")) for k in CONTAINERS]
        parts = F.array_compact(
            F.array(
                F.when(is_list, F.struct(F.lit("").alias("k"), F.from_json("record", "array<string>").alias("xs"))),
                *(F.when(~is_list & F.get_json_object("record", f"$.{k}").rlike(r"^\s*\["), F.struct(F.lit(f".{k}").alias("k"), x.alias("xs"))) for k, x in inner),
            )
        )
        marked = store.write(level.withColumn("parts", parts), f"level-{depth}")
        leaves = marked.where((F.size("parts") == 0) & F.col("record").rlike(r"^\s*\{")).select(*keep, "locator", "record")
        done = leaves if done is None else done.unionByName(leaves)
        opened = marked.select(*keep, "locator", F.explode("parts").alias("p")).select(*keep, "locator", "p.k", F.posexplode("p.xs").alias("i", "record"))
        if opened.isEmpty():
            return done
        level, depth = opened.select(*keep, F.concat("locator", "k", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("locator"), "record"), depth + 1


ADVISORY = "id string, aliases array<string>, summary string, details string, withdrawn string, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<events:array<struct<fixed:string>>>>>>, references array<struct<type:string,url:string>>, database_specific struct<cwe_ids:array<string>>"


def advisories(spark: SparkSession, folder: str) -> DataFrame:
    """All advisories of a tree of JSON and JSON line files, bare or under a wrapper key; unreadable ones are skipped.

    JSON line files are read by line and may be split; only a ``.json`` file is one value.
    """

    def read(pattern: str, whole: bool) -> DataFrame:
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=whole)
        return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))

    documents = read("*.json", True).unionByName(read("*.{jsonl,ndjson}", False)).where(F.trim("doc") != "")
    lists = [F.from_json(F.get_json_object("doc", f"$.{k}"), "array<string>") for k in ADVISORY_WRAPPERS]
    whole = F.when(F.col("doc").rlike(r"^\s*\["), F.from_json("doc", "array<string>")).otherwise(F.array("doc"))
    records = documents.select("path", F.explode(F.coalesce(*lists, whole)).alias("record"))
    return records.select("path", F.from_json("record", ADVISORY).alias("a")).select("path", "a.*").where(F.col("id").isNotNull())


def advisory_fields(df: DataFrame) -> DataFrame:
    """(id, packages, cwes, urls, fixed_versions, cve, text, withdrawn) of advisories; only PyPI packages count."""
    empty = F.array().cast("array<string>")
    affected = F.coalesce("affected", F.from_json(F.lit("[]"), "array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<events:array<struct<fixed:string>>>>>>"))
    pypi = F.filter(affected, lambda a: F.lower(a["package"]["ecosystem"]).isin("pypi", "pip") & a["package"]["name"].isNotNull())
    events = F.flatten(F.flatten(F.transform(affected, lambda a: F.transform(F.coalesce(a["ranges"], F.from_json(F.lit("[]"), "array<struct<events:array<struct<fixed:string>>>>")), lambda r: F.coalesce(r["events"], F.from_json(F.lit("[]"), "array<struct<fixed:string>>"))))))
    return df.select(
        "id",
        F.transform(pypi, lambda a: a["package"]["name"]).alias("packages"),
        F.array_sort(F.array_distinct(F.coalesce("database_specific.cwe_ids", empty))).alias("cwes"),
        F.filter(F.coalesce(F.transform("references", lambda r: r["url"]), empty), lambda u: u.isNotNull() & (u != "")).alias("urls"),
        F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull()).alias("fixed_versions"),
        F.coalesce(F.get(F.filter(F.coalesce("aliases", empty), lambda x: x.startswith("CVE-")), 0), F.lit("")).alias("cve"),
        F.concat_ws("\n", "id", "summary", "details").alias("text"),
        F.col("withdrawn").isNotNull().alias("withdrawn"),
    )


def code_pairs_csv(spark: SparkSession, path: str, strict_header: bool = False) -> DataFrame:
    """Code pairs of CSV files in either header dialect, white space around header names ignored."""
    rows = spark.read.options(header="true", multiLine="true", escape='"', maxCharsPerColumn="-1").csv(path)
    names = {c.strip(): c for c in rows.columns}
    pick = lambda *ways: F.coalesce(*(F.col(f"`{names[w]}`") for w in ways if w in names), F.lit(None).cast("string"))
    return rows.select(
        pick("vulnerable_function_source", "function_code").alias("code_vuln"), pick("patched_function_source").alias("code_fixed"), pick("label", "class").alias("label"), pick("repo").alias("repo"),
        pick("sha").alias("sha"), pick("file_path").alias("file_path"), pick("predicted_cwe_ids").alias("predicted_cwe_ids"), pick("cve_ids").alias("cve_ids"),
    )


def source_tree(spark: SparkSession, folder: str, suffixes: list[str], excluded: list[str] | None = None, included: str | None = None, largest: int = 2_000_000) -> DataFrame:
    """(path, content, text, skipped): the files of a tree; ``skipped`` names why a file has no text.

    Files in ``excluded`` folders, of other suffixes, outside the ``included`` pattern (``*`` within a name, ``**`` across
    folders) or larger than ``largest`` are listed and never read: their content is no column of their half of the plan,
    and the other half is limited to the suffixes and the length by the reader. Binary files are told by a zero byte.
    """

    def load(pattern: str | None) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)

    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    outside = F.lit(False)
    for name in excluded or []:
        outside = outside | F.col("path").contains(f"/{name}/")
    if included:
        glob = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", included))
        outside = outside | ~F.col("path").rlike(f"/{glob}$")
    reason = F.when(outside, "excluded").when(~suffix.isin(suffixes), "suffix").when(F.col("length") > largest, "too_large")
    skipped = load(None).select("path", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("text"), reason.alias("skipped")).where(F.col("skipped").isNotNull())
    any_case = [f"*.{''.join(f'[{c.lower()}{c.upper()}]' if c.isalpha() else c for c in x)}" for x in suffixes]
    kept = load("{" + ",".join(any_case) + "}").where((F.col("length") <= largest) & ~outside)
    binary = F.position(F.lit(b"\0"), F.col("content")) > 0
    kept = kept.select("path", "content", F.when(~binary, F.decode("content", "UTF-8")).alias("text"), F.when(binary, "binary").alias("skipped"))
    return kept.unionByName(skipped)


def skip_counts(files: DataFrame) -> DataFrame:
    """(skipped, files) of a tree: how many files each reason left out; null is what was read."""
    return files.groupBy("skipped").agg(F.count("*").alias("files"))


def label_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Label records of ``folder/<verdict>/*.json`` with ``partition``, their folder, and whether it agrees."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    parsed = rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("partition"), F.from_json("value", schema).alias("r")).select("partition", "r.*")
    return parsed.withColumn("consistent", F.col("partition") == F.col("verdict"))


def rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, id, severity, cwe, message) of rule YAML files by their text; of several severities the last counts."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.y*ml").text(folder, wholetext=True)
    pick = lambda p: F.coalesce(F.element_at(F.regexp_extract_all("value", F.lit(p), F.lit(1)), -1), F.lit(""))
    severities = F.regexp_extract_all("value", F.lit(r"(?m)^\s*severity:\s*[\"']?([A-Za-z]+)"), F.lit(1))
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?m)^\s*-?\s*id:\s*[\"']?([\w.\-]+)", 1).alias("id"),
        F.upper(F.coalesce(F.try_element_at(severities, F.lit(-1)), F.lit(""))).alias("severity"), F.regexp_extract("value", r"(CWE-\d+)", 1).alias("cwe"), F.regexp_extract("value", r"(?m)^\s*message:\s*[\"']?(.*?)[\"']?\s*$", 1).alias("message"),
    )


def probes(df: DataFrame, raw: str) -> DataFrame:
    """(gt, finding, code) of probe documents, as triples or as objects."""
    triples = F.from_json(raw, "array<array<string>>")
    objects = F.from_json(raw, "array<struct<gt:string,finding:string,code:string>>")
    is_triple = F.col(raw).rlike(r"^\s*\[\s*\[")
    rows = F.when(is_triple, F.transform(triples, lambda x: F.struct(F.get(x, 0).alias("gt"), F.get(x, 1).alias("finding"), F.get(x, 2).alias("code")))).otherwise(objects)
    return df.select(F.explode(rows).alias("r")).select("r.*")


def cwe_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(cwe, name) of a JSON object of entries by number; an entry's own ``id`` comes before its key. Empty if it can't be read."""
    kind = "map<string,struct<id:string,name:string>>"
    if not _exists(spark, path):
        return spark.createDataFrame([], "cwe string, name string")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "entry")).where(F.col("entry").isNotNull())
    return rows.select(F.upper(F.trim(F.coalesce(F.nullif("entry.id", F.lit("")), "key"))).alias("cwe"), F.col("entry.name").alias("name")).where(F.col("cwe") != "")


def commit_files_provider(fetch: object, pause: float = 0.0) -> object:
    """A source of commit files from ``fetch(owner, repo, sha) -> [(path, patch)]``, in batches; a failure is a row.

    A task waits at least ``pause`` seconds between two calls, so ``pause`` times the calls allowed a second is the
    number of tasks that may run at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                time.sleep(pause)
                try:
                    rows += [(*row, path, patch, None) for path, patch in fetch(*row)]
                except Exception as error:  # noqa: BLE001
                    rows.append((*row, None, None, re.sub(r"\s+", " ", str(error))[:200]))
            yield pd.DataFrame(rows, columns=["owner", "repo", "sha", "path", "patch", "error"])

    def read(df: DataFrame) -> DataFrame:
        return df.select("owner", "repo", "sha").distinct().mapInPandas(run, "owner string, repo string, sha string, path string, patch string, error string")

    return read
