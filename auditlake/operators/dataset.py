"""Checks, chat format, leakage and manifests of labelled record sets."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import collapsed

# Required keys, accepted CWEs of each rule, prompt texts and layouts.
REQUIRED = ["id", "lang", "task", "code", "label", "source", "license", "verified", "split"]
RULE_CWE = {
    "CRYPTO-001": ["CWE-327"],
    "CRYPTO-002": ["CWE-327"],
    "CRYPTO-003": ["CWE-327"],
    "CRYPTO-004": ["CWE-327"],
    "CRYPTO-005": ["CWE-327"],
    "CRYPTO-006": ["CWE-329"],
    "CRYPTO-007": ["CWE-321"],
    "CRYPTO-008": ["CWE-338"],
    "CRYPTO-009": ["CWE-326"],
    "CRYPTO-010": ["CWE-326", "CWE-295"],
    "CRYPTO-011": ["CWE-256"],
    "CRYPTO-012": ["CWE-916"],
    "CRYPTO-013": ["CWE-208"],
}
TARGET_CWES = sorted({c for cs in RULE_CWE.values() for c in cs})
PLACEHOLDER_LICENSES = ["unknown", "n/a", "none", "tbd"]
SYSTEM_PROMPT = (
    "You are a Python code vulnerability auditor. Respond in JSON only. "
    "For task 'detect', report whether the code is vulnerable and its CWE. "
    "For task 'triage', decide whether the given static-analysis finding is a "
    "real vulnerability (Confirm/Reject) and give a fix."
)
GUIDE_MARK = "\n\nBefore your verdict,"


def _errors(df: DataFrame, identifier: str, checks: dict[str, Column]) -> DataFrame:
    """(identifier, error): a row for each check that holds."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items())))
    return df.select(identifier, F.explode(found).alias("error"))


def missing_values(df: DataFrame, identifier: str, required: list[str]) -> DataFrame:
    """(identifier, field): required columns that are null in a row."""
    found = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in required)))
    return df.select(identifier, F.explode(found).alias("field"))


def type_errors(df: DataFrame, identifier: str, kind: str) -> DataFrame:
    """(identifier, error) of the label rules of ``detect`` or ``triage`` records."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    wrong = F.coalesce(F.col("task"), F.lit("")) != kind
    if kind == "detect":
        checks = {
            "vulnerable_not_boolean": F.col("label.vulnerable").isNull(),
            "positive_without_cwe": F.col("label.vulnerable") & empty("label.cwe"),
            "verified_without_evidence": F.col("label.vulnerable") & F.col("verified") & (empty("label.cwe") | empty("label.explanation")),
        }
    else:
        checks = {"verdict_missing": empty("label.verdict"), "finding_missing": empty("finding")}
    return _errors(df, identifier, checks | {"unknown_task": wrong})


def evidence_errors(df: DataFrame, identifier: str) -> DataFrame:
    """(identifier, error): what a verified detect record lacks in its chain of evidence, failing closed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rule, cwe = F.trim(text("rule")), F.trim(text("label.cwe"))
    accepted = F.lit(None).cast("array<string>")
    for name, cwes in RULE_CWE.items():
        accepted = F.when(rule == name, F.array(*map(F.lit, cwes))).otherwise(accepted)
    positive = F.coalesce(F.col("label.vulnerable"), F.lit(False))
    return _errors(
        df,
        identifier,
        {
            "id_missing": text("id") == "",
            "not_verified": ~F.coalesce(F.col("verified"), F.lit(False)),
            "source_missing": text("source") == "",
            "language_not_python": text("lang") != "python",
            "split_unknown": ~text("split").isin("train", "val", "test"),
            "license_unusable": F.lower(F.trim(text("license"))).isin("", *PLACEHOLDER_LICENSES),
            "repo_missing": text("repo_url") == "",
            "commit_missing": text("commit_sha") == "",
            "file_missing": text("file") == "",
            "code_missing": text("code") == "",
            "rule_unknown": (rule != "") & accepted.isNull(),
            "cwe_not_of_rule": (cwe != "") & accepted.isNotNull() & ~F.array_contains(accepted, cwe),
            "positive_without_rule": positive & (rule == ""),
            "positive_without_cwe": positive & (cwe == ""),
            "cwe_outside_target": positive & (cwe != "") & ~cwe.isin(TARGET_CWES),
            "vulnerable_not_boolean": F.col("label.vulnerable").isNull(),
        },
    )


def to_chat(df: DataFrame, kind: str) -> Column:
    """The three messages of a record: system, task with its code, and the label as JSON.

    Keys of the label that are null are left out; a record that lacks the core key, or a triage record without a
    finding, has null.
    """
    code, lang = F.coalesce("code", F.lit("")), F.coalesce("lang", F.lit("python"))
    if kind == "detect":
        user = F.concat(F.lit("Task: detect\nLanguage: "), lang, F.lit("\nCode:\n"), code)
        keys, usable = ["vulnerable", "cwe", "severity", "confidence", "explanation"], F.col("label.vulnerable").isNotNull()
    else:
        user = F.concat(F.lit("Task: triage\nLanguage: "), lang, F.lit("\nStatic Finding: "), F.col("finding"), F.lit("\nCode:\n"), code)
        keys, usable = ["cwe", "severity", "verdict", "explanation", "patch"], F.col("label.verdict").isNotNull() & (F.coalesce("finding", F.lit("")) != "")
    answer = F.to_json(F.struct(*(F.col(f"label.{k}").alias(k) for k in keys)))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.when(usable, F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user), message("assistant", answer)))


def from_chat(df: DataFrame, identifier: str, messages: str) -> DataFrame:
    """(identifier, task, language, finding, code, answer): the record in a conversation's first user message.

    Without a code block the code is empty and, without a task line, the task is ``?``.
    """
    of = lambda *roles: F.try_element_at(F.filter(messages, lambda m: F.lower(F.trim(m["role"])).isin(*roles)), F.lit(1))["content"]
    user = F.coalesce(of("user", "human"), F.lit(""))
    block = F.when(user.contains("Code:\n"), F.substring(user, F.locate("Code:\n", user) + 6, F.length(user))).otherwise("")
    code = F.trim(F.when(block.contains(GUIDE_MARK), F.substring_index(block, GUIDE_MARK, 1)).otherwise(block))
    head = F.substring_index(user, "Code:\n", 1)
    task = F.regexp_extract(user, r"^Task:\s*(\w+)", 1)
    return df.select(
        identifier,
        F.when(task == "", "?").otherwise(task).alias("task"),
        F.regexp_extract(head, r"(?m)^Language: *(\S+)", 1).alias("language"),
        F.regexp_extract(head, r"(?m)^Static Finding: *(.*)$", 1).alias("finding"),
        code.alias("code"),
        F.coalesce(of("assistant", "gpt"), F.lit("")).alias("answer"),
    )


def metadata(df: DataFrame, kind: str) -> DataFrame:
    """The flat metadata row of each record."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    verdict = text("label.verdict") if kind == "triage" else F.lit("")
    vulnerable = text("label.vulnerable") if kind == "detect" else F.lit("")
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}="), c))
    notes = [F.concat(F.lit("task="), text("task")), part("verdict", verdict), part("rule", text("rule"))]
    if "category" in df.columns:
        notes.append(part("category", text("category")))
    return df.select(
        F.col("ordinal"), text("id").alias("sample_id"), text("label.cwe").alias("cwe"), text("label.severity").alias("severity"), vulnerable.alias("vulnerable"), text("source").alias("generator"),
        F.when(text("repo_url") == "", "original").otherwise(text("repo_url")).alias("repo_source"), text("split").alias("split"),
        F.when(F.coalesce(F.col("verified"), F.lit(False)), "verified_legacy").otherwise("unverified").alias("label_verified_by"), F.concat_ws(" ", *notes).alias("notes"),
    )


def leak_matrix(evaluation: dict[str, DataFrame], training: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(evaluation, training, dimension, shared_keys, left_rows, right_rows) for every pair and dimension.

    ``keys`` gives each dimension by the column that holds its key; null keys are shared by none. Every set is read
    once: its keys are counted by set in one aggregation, and the pairs are sums over the keys.
    """
    sets = [(f"e{i}", df) for i, df in enumerate(evaluation.values())] + [(f"t{i}", df) for i, df in enumerate(training.values())]
    columns = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("key")) for d, c in keys.items()))
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("s"), F.explode(columns).alias("k")).select("s", "k.*") for name, df in sets))
    counts = rows.where(F.col("key").isNotNull()).groupBy("dimension", "key").agg(*(F.count_if(F.col("s") == name).alias(name) for name, _ in sets))
    pairs = [(e, t, f"e{i}", f"t{j}") for i, e in enumerate(evaluation) for j, t in enumerate(training)]
    sums = []
    for e, t, a, b in pairs:
        both = (F.col(a) > 0) & (F.col(b) > 0)
        sums += [F.count_if(both).alias(f"{a}{b}n"), F.sum(F.when(both, F.col(a)).otherwise(0)).alias(f"{a}{b}l"), F.sum(F.when(both, F.col(b)).otherwise(0)).alias(f"{a}{b}r")]
    whole = counts.groupBy("dimension").agg(*sums)
    # a dimension without any key has a row too
    every = df_of(sets[0][1], [(d,) for d in keys], "dimension string").join(whole, "dimension", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    cells = F.array(*(F.struct(F.lit(e).alias("evaluation"), F.lit(t).alias("training"), zero(f"{a}{b}n").alias("shared_keys"), zero(f"{a}{b}l").alias("left_rows"), zero(f"{a}{b}r").alias("right_rows")) for e, t, a, b in pairs))
    return every.select("dimension", F.explode(cells).alias("c")).select("c.evaluation", "c.training", "dimension", "c.shared_keys", "c.left_rows", "c.right_rows")


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table in the session of another one."""
    return like.sparkSession.createDataFrame(rows, schema)


def split_leaks(df: DataFrame, key: Column, split: Column) -> DataFrame:
    """(key, kind): keys of ``val`` that ``train`` has too, and of ``test`` that ``train`` or ``val`` has."""
    rows = df.select(key.alias("key"), split.alias("split")).where(F.col("key").isNotNull()).groupBy("key").agg(F.collect_set("split").alias("s"))
    has = lambda x: F.array_contains("s", x)
    kinds = F.array_compact(F.array(F.when(has("val") & has("train"), "val_in_train"), F.when(has("test") & (has("train") | has("val")), "test_in_train_or_val")))
    return rows.select("key", F.explode(kinds).alias("kind"))


def quality_report(df: DataFrame, identifier: str) -> DataFrame:
    """(check, failures, passed): the checks of a record set in one table."""
    duplicates = df.groupBy(identifier).agg(F.count("*").alias("n")).where(F.col("n") > 1).agg(F.count("*").alias("failures"))
    codes = df.select(F.sha2(collapsed(F.col("code")), 256).alias("k"), "task", F.col("label.vulnerable").alias("v")).where(F.col("k") != hashlib.sha256(b"").hexdigest()).groupBy("k", "task").agg(F.count_distinct("v").alias("n")).where(F.col("n") > 1).agg(F.count("*").alias("failures"))
    missing = missing_values(df, identifier, ["id", "task", "code", "source", "split"]).agg(F.count("*").alias("failures"))
    parts = {"duplicate_ids": duplicates, "label_conflicts": codes, "missing_fields": missing}
    return reduce(DataFrame.unionByName, (d.select(F.lit(name).alias("check_name"), "failures", (F.col("failures") == 0).alias("passed")) for name, d in parts.items()))


def file_manifest(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, bytes, sha256, line_count) of files read with their content."""
    text = F.decode(F.col(content), "UTF-8")
    return df.select(path, F.octet_length(content).alias("bytes"), F.sha2(F.col(content), 256).alias("sha256"), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).alias("line_count"))
