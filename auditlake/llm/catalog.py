"""Named queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, broken_pairs, consolidate, format_duplicates, grouped_splits, leakage, sentences, split_overlap, survivor, syntax
from auditlake.plans.skew import spread
from auditlake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _repositories(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    rows = table(spark, folder, "new_detect").select("ordinal", "repo_url", "split")
    return rows, {"repo": (F.col("repo_url"), grouped_splits.repo_key(F.col("repo_url")))}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories whose delivered records lie in at least two splits."""
    rows, entities = _repositories(spark, folder)
    return grouped_splits.divided_groups(rows, "ordinal", entities, grouped_splits.split_key(F.col("split"))).select(F.col("key").alias("repo_key"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with a split that its whole repository shares."""
    rows, entities = _repositories(spark, folder)
    return grouped_splits.grouped_splits(rows, "ordinal", entities, table(spark, folder, "split_targets"))


def p1_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The spanning forest over the spellings and keys of repositories."""
    rows, entities = _repositories(spark, folder)
    return grouped_splits.spanning_forest(rows, "ordinal", entities)


def _split_rows(spark: SparkSession, folder: str) -> DataFrame:
    new = spread(table(spark, folder, "new_detect").select("ordinal", "code", "source", "split"), "ordinal").select("ordinal", "code", "source", grouped_splits.split_key(F.col("split")).alias("part"), F.lit(False).alias("held"))
    held = table(spark, folder, "detect_eval").select("ordinal", "code", "source", grouped_splits.split_key(F.col("split")).alias("part"), F.lit(True).alias("held"))
    return new.unionByName(held)


def _sides() -> tuple[Column, Column]:
    part, held = F.col("part"), F.col("held")
    return (part == "train") & ~held, held | part.isin("val", "test")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training record and an evaluation record with the same program text."""
    pairs = split_overlap.overlaps(_split_rows(spark, folder), "ordinal", "code", *_sides())
    return pairs.select(F.least("train_id", "eval_id").alias("ordinal_a"), F.greatest("train_id", "eval_id").alias("ordinal_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The overlapping classes of equal records with their similarity, one row a pair of classes."""
    return split_overlap.overlap_classes(_split_rows(spark, folder), "ordinal", "code", *_sides())[0]


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation split and source: its records, those that occur in training, the pairs, and the share of their
    words that lie in chunks that training has too."""
    rows = _split_rows(spark, folder)
    held = rows.where(F.coalesce(_sides()[1], F.lit(False))).select(F.col("ordinal").alias("eval_id"), F.coalesce("part", F.lit("eval")).alias("split"), "source")
    # pairs are counted by class, never expanded
    classes, members = split_overlap.overlap_classes(rows, "ordinal", "code", *_sides())
    sizes = members.groupBy("rep").agg(F.count_if("in_train").alias("trained"))
    partners = classes.join(sizes.withColumnRenamed("rep", "x"), "x").groupBy("y").agg(F.sum("trained").alias("n"))
    pairs = members.where("in_eval").select(F.col("id").alias("eval_id"), "in_train", F.col("rep").alias("y")).join(partners, "y")
    # a row on both sides is no pair with itself
    pairs = pairs.select("eval_id", (F.col("n") - F.col("in_train").cast("int")).alias("n")).where(F.col("n") > 0)
    parts = split_overlap.overlap_fractions(rows, "ordinal", "code", *_sides()).select("eval_id", "words", "shared")
    sums = held.join(pairs, "eval_id", "left").join(parts, "eval_id", "left").groupBy("split", "source")
    return sums.agg(F.count("*").alias("records"), F.count("n").alias("leaked_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), (F.sum("shared") / F.sum("words")).alias("overlap"))


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "new_detect").select("ordinal", "code"), "ordinal").unionByName(table(spark, folder, "new_triage").select("ordinal", "code"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of at least two records that are the same apart from their form."""
    return format_duplicates.collapse(_forms(spark, folder), "ordinal", "code").where(F.col("copies") >= 2)


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each distinct form, with its number of copies."""
    return format_duplicates.collapse(_forms(spark, folder), "ordinal", "code")


def _links() -> dict:
    return {"advisory": consolidate.advisory_key(F.col("advisory_id")), "commit": consolidate.commit_key(F.col("fix_commit"))}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate_id with the smallest candidate_id of its group."""
    rows = table(spark, folder, "candidates").select("candidate_id", "advisory_id", "fix_commit")
    groups = consolidate.consolidate(rows, "candidate_id", _links())
    return groups.where(F.col("id").isNotNull()).select(F.col("id").alias("candidate_id"), "group_id")


def _survivors(spark: SparkSession, folder: str, by_record: bool) -> DataFrame:
    candidates = table(spark, folder, "candidates")
    groups = consolidate.consolidate(candidates.select("candidate_id", "advisory_id", "fix_commit"), "candidate_id", _links())
    length = F.length(F.regexp_replace("code_fixed", r"(?U)^\s+|\s+$", ""))
    rows = candidates.select(
        "ordinal",
        consolidate.vertices(F.col("candidate_id"), _links())[0].alias("v"),
        F.when(_links()["advisory"].isNotNull(), 1).alias("advisory"),
        F.when(_links()["commit"].isNotNull(), 1).alias("commit"),
        F.when(length > 0, length).alias("code"),
        survivor.parse_time(F.col("collected_at")).alias("at"),
        "verified",
    )
    fields = [survivor.Field("advisory_row", F.col("advisory")), survivor.Field("fix_commit_row", F.col("commit")), survivor.Field("code_fixed_row", F.col("code"))]
    filled = F.size(F.array_compact(F.array("advisory", "commit", "code"))) if by_record else None
    # a hot identifier meets one group row; the adaptive skew join splits its side
    best = survivor.survivors(rows.join(groups, "v"), "group_id", "ordinal", fields, F.col("at"), F.col("verified"), filled)
    return best.where(F.col("records") >= 2).select("group_id", *(F.coalesce(f.name, F.lit(-1).cast("long")).alias(f.name) for f in fields), "layers")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each group with several rows, the rows whose advisory id, commit and fixed code survive."""
    return _survivors(spark, folder, False).drop("layers")


def p5_by_record(spark: SparkSession, folder: str) -> DataFrame:
    """The same where records compete as wholes, by the number of fields they fill, and later layers fill what is missing."""
    return _survivors(spark, folder, True)


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    new, old = table(spark, folder, "new_detect"), table(spark, folder, "candidates")
    path = syntax.language_of_path(F.col("file_path"))
    detect = syntax.verdicts(spread(new.select("ordinal", "code", "lang"), "ordinal"), "ordinal", {"code": (F.col("code"), syntax.language_of(F.col("lang")))})
    pairs = syntax.verdicts(spread(old.select("ordinal", "code_vuln", "code_fixed", "file_path"), "ordinal"), "ordinal", {c: (F.col(c), path) for c in ("code_vuln", "code_fixed")})
    return detect.unionByName(pairs)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are not in the grammar of their language."""
    return _verdicts(spark, folder).where("broken").select("ordinal", "field_name")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """For each repository and language, the values that were read and those that are broken."""
    new = table(spark, folder, "new_detect").select("ordinal", "repo_url", syntax.language_of(F.col("lang")).alias("lang"))
    old = table(spark, folder, "candidates").select("ordinal", "repo_url", syntax.language_of_path(F.col("file_path")).alias("lang"))
    rows = new.unionByName(old).select("ordinal", "lang", grouped_splits.repo_key(F.col("repo_url")).alias("repo_key"))
    return syntax.rates(_verdicts(spark, folder).join(rows, "ordinal"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective question-answer pairs with the type of their defect."""
    return broken_pairs.defects(spread(table(spark, folder, "trainingdata").select("conv_id", "messages"), "conv_id"), "conv_id", "messages")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the ids of its text by the byte-level BPE vocabulary."""
    tokenizers = spark.conf.get("spark.auditlake.tokenizers", "/opt/tokenizers")
    return bpe.encode(spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", f"{tokenizers}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the held-out items of which they contain a passage."""
    return leakage.leaks(spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", table(spark, folder, "benchmark_items"), "item_id", "text", "lang")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of all documents that aren't program text."""
    docs = table(spark, folder, "documents").where(~F.col("kind").eqNullSafe("source"))
    return sentences.sentences(spread(docs.select("doc_id", "text"), "doc_id"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from auditlake.llm import oracles

    return oracles.SQL
