"""Queries over labelled records: normal forms, splits, checks, conflicts, leakage, set operations, chat format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.catalog import query
from auditlake.functions import hashing, text
from auditlake.operators import dataset, relational, source_ast
from auditlake.plans.skew import spread
from auditlake.queries.sql import collapsed, empty, no_space, quoted
from auditlake.sources.tables import table


def _detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "new_detect")


def _triage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "new_triage")


@query("dedupe_exact", "SELECT min(ordinal) AS ordinal, count(*) AS copies FROM new_detect WHERE code IS NOT NULL GROUP BY code")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull())
    return rows.groupBy(F.sha2("code", 256).alias("k")).agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("copies")).select("ordinal", "copies")


@query("dedupe_normalized", f"SELECT min(ordinal) AS ordinal, count(*) AS copies FROM new_detect WHERE code IS NOT NULL GROUP BY {collapsed('code')}")
def dedupe_normalized(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull()).select("ordinal", F.sha2(text.collapsed(F.col("code")), 256).alias("k"))
    return rows.groupBy("k").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("copies")).select("ordinal", "copies")


@query("dedupe_nospace", f"SELECT min(ordinal) AS ordinal FROM new_detect WHERE code IS NOT NULL GROUP BY {no_space('code')}")
def dedupe_nospace(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull()).select("ordinal", F.sha2(text.no_space(F.col("code")), 256).alias("k"))
    return relational.first_wins(rows, ["k"], "ordinal").select("ordinal")


@query(
    "dup_owner",
    f"""
WITH r AS (SELECT ordinal, id, {collapsed('code')} AS k FROM new_detect WHERE code IS NOT NULL),
w AS (SELECT ordinal, id, first_value(id) OVER (PARTITION BY k ORDER BY ordinal) AS owner, row_number() OVER (PARTITION BY k ORDER BY ordinal) AS n FROM r)
SELECT ordinal, owner FROM w WHERE n > 1
""",
)
def dup_owner(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull()).select("ordinal", "id", F.sha2(text.collapsed(F.col("code")), 256).alias("k"))
    first = rows.groupBy("k").agg(F.min_by("id", "ordinal").alias("owner"), F.min("ordinal").alias("o"), F.count("*").alias("n")).where(F.col("n") > 1)
    return rows.join(first, "k").where(F.col("ordinal") > F.col("o")).select("ordinal", "owner")


@query(
    "digest_ids",
    f"""
SELECT ordinal, CASE WHEN {empty('code')} = '' THEN '' ELSE sha256({collapsed('code')}) END AS digest,
  substr(regexp_replace(regexp_replace(lower({empty('repo_url')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug,
  substr(sha1({empty('id')} || '|' || {empty('file')}), 1, 12) AS local_id,
  length({no_space(empty('code'))}) AS plain_length
FROM new_detect
""",
)
def digest_ids(spark: SparkSession, d: str) -> DataFrame:
    blank = F.lit("")
    return _detect(spark, d).select(
        "ordinal", text.digest(F.col("code")).alias("digest"), text.slug(F.coalesce("repo_url", blank)).alias("slug"), text.local_id(F.col("id"), F.col("file")).alias("local_id"), F.length(text.no_space(F.coalesce("code", blank))).cast("long").alias("plain_length")
    )


_B64 = "CAST(('0x' || substr(sha256({0}), 1, 16))::UBIGINT % 100 AS INTEGER)"


@query("split_80_10_10", f"SELECT ordinal, bucket, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT ordinal, {_B64.format('id')} AS bucket FROM new_detect WHERE id IS NOT NULL)")
def split_80_10_10(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("id").isNotNull())
    return rows.select("ordinal", hashing.bucket_64(F.col("id")).alias("bucket"), hashing.split_80_10_10(F.col("id")).alias("split"))


@query(
    "split_90_5_5",
    f"""
WITH h AS (SELECT ordinal, sha256({collapsed('code')}) AS h FROM new_detect WHERE code IS NOT NULL),
b AS (SELECT ordinal, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(i * 8 + 1 AS BIGINT), 8))::BIGINT)), lambda a, x: (a * 96 + x) % 100) AS bucket FROM h)
SELECT ordinal, CAST(bucket AS INTEGER) AS bucket, CASE WHEN bucket < 90 THEN 'train' WHEN bucket < 95 THEN 'val' ELSE 'test' END AS split FROM b
""",
)
def split_90_5_5(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull())
    rows = spread(rows.select("ordinal", "code"), "ordinal").select("ordinal", hashing.bucket_256(text.collapsed(F.col("code"))).alias("bucket"))
    return rows.withColumn("split", hashing.split_of_bucket(F.col("bucket")))


@query("stable_sample", f"SELECT ordinal FROM new_detect WHERE id IS NOT NULL AND CAST(('0x' || substr(sha256('audit:' || id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.25")
def stable_sample(spark: SparkSession, d: str) -> DataFrame:
    return _detect(spark, d).where(F.col("id").isNotNull() & (hashing.sample_value(F.col("id"), "audit") < 0.25)).select("ordinal")


@query(
    "stratified_holdout",
    """
WITH w AS (SELECT ordinal, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || CAST(ordinal AS VARCHAR)), ordinal) AS place, count(*) OVER (PARTITION BY source) AS n FROM new_triage)
SELECT ordinal, source FROM w WHERE place <= greatest(1, floor(n * 0.1 + 0.5))
""",
)
def stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    rows = _triage(spark, d).select("ordinal", "source")
    return relational.stratified_holdout(rows, "source", "ordinal", "7", 0.1).where("held_out").select("ordinal", "source")


@query(
    "sticky_repo_split",
    f"""
WITH known AS (SELECT repo_url, arg_min(split, ordinal) AS split FROM new_triage WHERE {empty('repo_url')} <> '' AND split IS NOT NULL GROUP BY repo_url),
h AS (SELECT ordinal, repo_url, {_B64.format("coalesce(nullif(repo_url, ''), id)")} AS bucket FROM new_detect WHERE id IS NOT NULL)
SELECT ordinal, coalesce(known.split, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END) AS split FROM h LEFT JOIN known USING (repo_url)
""",
)
def sticky_repo_split(spark: SparkSession, d: str) -> DataFrame:
    old = _triage(spark, d).where((F.coalesce("repo_url", F.lit("")) != "") & F.col("split").isNotNull())
    known = old.groupBy("repo_url").agg(F.min_by("split", "ordinal").alias("known_split"))
    rows = _detect(spark, d).where(F.col("id").isNotNull()).select("ordinal", "repo_url", F.coalesce(F.nullif("repo_url", F.lit("")), "id").alias("seed"))
    return rows.join(known, "repo_url", "left").select("ordinal", F.coalesce("known_split", hashing.split_80_10_10(F.col("seed"))).alias("split"))


@query("balance_plan", "SELECT lang, count_if(label.vulnerable) AS positives, count_if(NOT label.vulnerable) AS negatives, greatest(0, count_if(label.vulnerable) - count_if(NOT label.vulnerable)) AS needed FROM new_detect GROUP BY lang")
def balance_plan(spark: SparkSession, d: str) -> DataFrame:
    counts = _detect(spark, d).groupBy("lang").agg(F.count_if("label.vulnerable").alias("positives"), F.count_if(~F.col("label.vulnerable")).alias("negatives"))
    return counts.select("*", F.greatest(F.lit(0), F.col("positives") - F.col("negatives")).alias("needed"))


_REQUIRED = ["code", "source", "license", "split", "rule", "category", "file", "repo_url", "commit_sha"]


@query("required_fields", " UNION ALL ".join(f"SELECT ordinal, '{c}' AS field FROM new_detect WHERE {c} IS NULL" for c in _REQUIRED))
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    return dataset.missing_values(_detect(spark, d), "ordinal", _REQUIRED)


@query("json_required_keys", " UNION ALL ".join(f"SELECT event_id, '{k}' AS field FROM events WHERE NOT list_contains(coalesce(json_keys(props), []), '{k}')" for k in ("k", "page", "ref")))
def json_required_keys(spark: SparkSession, d: str) -> DataFrame:
    from auditlake.functions.jsons import missing_keys

    return table(spark, d, "events").select("event_id", F.explode(missing_keys(F.col("props"), ["k", "page", "ref"])).alias("field"))


_TYPE_SQL = f"""
SELECT ordinal, 'vulnerable_not_boolean' AS error FROM new_detect WHERE label.vulnerable IS NULL
UNION ALL SELECT ordinal, 'positive_without_cwe' FROM new_detect WHERE label.vulnerable AND {empty('label.cwe')} = ''
UNION ALL SELECT ordinal, 'verified_without_evidence' FROM new_detect WHERE label.vulnerable AND verified AND ({empty('label.cwe')} = '' OR {empty('label.explanation')} = '')
UNION ALL SELECT ordinal, 'unknown_task' FROM new_detect WHERE {empty('task')} <> 'detect'
UNION ALL SELECT ordinal, 'verdict_missing' FROM new_triage WHERE {empty('label.verdict')} = ''
UNION ALL SELECT ordinal, 'finding_missing' FROM new_triage WHERE {empty('finding')} = ''
UNION ALL SELECT ordinal, 'unknown_task' FROM new_triage WHERE {empty('task')} <> 'triage'
"""


@query("type_checks", _TYPE_SQL)
def type_checks(spark: SparkSession, d: str) -> DataFrame:
    return dataset.type_errors(_detect(spark, d), "ordinal", "detect").unionByName(dataset.type_errors(_triage(spark, d), "ordinal", "triage"))


def _evidence_sql() -> str:
    rule, cwe = f"trim({empty('rule')})", f"trim({empty('label.cwe')})"
    rules = ", ".join(quoted(r) for r in dataset.RULE_CWE)
    fits = " OR ".join(f"({rule} = {quoted(r)} AND {cwe} NOT IN ({', '.join(map(quoted, cs))}))" for r, cs in dataset.RULE_CWE.items())
    target = ", ".join(map(quoted, dataset.TARGET_CWES))
    positive = "coalesce(label.vulnerable, false)"
    checks = {
        "id_missing": f"{empty('id')} = ''",
        "not_verified": "NOT coalesce(verified, false)",
        "source_missing": f"{empty('source')} = ''",
        "language_not_python": f"{empty('lang')} <> 'python'",
        "split_unknown": f"{empty('split')} NOT IN ('train', 'val', 'test')",
        "license_unusable": f"lower(trim({empty('license')})) IN ('', {', '.join(map(quoted, dataset.PLACEHOLDER_LICENSES))})",
        "repo_missing": f"{empty('repo_url')} = ''",
        "commit_missing": f"{empty('commit_sha')} = ''",
        "file_missing": f"{empty('file')} = ''",
        "code_missing": f"{empty('code')} = ''",
        "rule_unknown": f"{rule} <> '' AND {rule} NOT IN ({rules})",
        "cwe_not_of_rule": f"{cwe} <> '' AND ({fits})",
        "positive_without_rule": f"{positive} AND {rule} = ''",
        "positive_without_cwe": f"{positive} AND {cwe} = ''",
        "cwe_outside_target": f"{positive} AND {cwe} <> '' AND {cwe} NOT IN ({target})",
        "vulnerable_not_boolean": "label.vulnerable IS NULL",
    }
    return " UNION ALL ".join(f"SELECT ordinal, '{k}' AS error FROM new_detect WHERE {v}" for k, v in checks.items())


@query("evidence_errors", _evidence_sql())
def evidence_errors(spark: SparkSession, d: str) -> DataFrame:
    return dataset.evidence_errors(_detect(spark, d), "ordinal")


@query("duplicate_ids", "SELECT id, count(*) AS n FROM new_detect GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return _detect(spark, d).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


@query(
    "label_conflicts_first",
    f"""
WITH r AS (SELECT ordinal, task, {collapsed('code')} AS k, concat_ws('|', {", ".join(f"coalesce(CAST(label.{f} AS VARCHAR), '?')" for f in ('vulnerable', 'cwe', 'severity', 'confidence', 'explanation'))}) AS v FROM new_detect WHERE code IS NOT NULL),
w AS (SELECT ordinal, v, first_value(v) OVER (PARTITION BY task, k ORDER BY ordinal) AS f FROM r)
SELECT ordinal FROM w WHERE v <> f
""",
)
def label_conflicts_first(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(_detect(spark, d).where(F.col("code").isNotNull()).select("ordinal", "task", "code", "label"), "ordinal")
    rows = rows.select("ordinal", "task", F.sha2(text.collapsed(F.col("code")), 256).alias("k"), F.to_json("label").alias("v"))
    return relational.conflicts_with_first(rows, ["task", "k"], F.col("v"), "ordinal").select("ordinal")


@query("label_conflicts_set", f"SELECT min(ordinal) AS ordinal, count(DISTINCT label.vulnerable) AS values_seen FROM new_detect WHERE code IS NOT NULL GROUP BY {no_space('code')}, task HAVING count(DISTINCT label.vulnerable) > 1")
def label_conflicts_set(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull()).select("ordinal", "task", "label.vulnerable", F.sha2(text.no_space(F.col("code")), 256).alias("k"))
    found = rows.groupBy("k", "task").agg(F.min("ordinal").alias("ordinal"), F.count_distinct("vulnerable").alias("values_seen"))
    return found.where(F.col("values_seen") > 1).select("ordinal", "values_seen")


@query(
    "split_leak_first",
    f"""
WITH r AS (SELECT ordinal, coalesce(split, '?') AS s, {collapsed('code')} AS k FROM new_detect WHERE code IS NOT NULL),
w AS (SELECT ordinal, s, first_value(s) OVER (PARTITION BY k ORDER BY ordinal) AS first_split FROM r)
SELECT ordinal, first_split, s AS split FROM w WHERE s <> first_split
""",
)
def split_leak_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull()).select("ordinal", F.coalesce("split", F.lit("?")).alias("s"), F.sha2(text.collapsed(F.col("code")), 256).alias("k"))
    return relational.conflicts_with_first(rows, ["k"], F.col("s"), "ordinal").select("ordinal", F.col("first_value").alias("first_split"), F.col("s").alias("split"))


@query(
    "split_leak_set",
    f"""
WITH r AS (SELECT DISTINCT sha256({no_space('code')}) AS key, split FROM new_detect WHERE code IS NOT NULL),
t AS (SELECT key FROM r WHERE split = 'train'), v AS (SELECT key FROM r WHERE split = 'val'), e AS (SELECT key FROM r WHERE split = 'test')
SELECT key, 'val_in_train' AS kind FROM v WHERE key IN (SELECT key FROM t)
UNION ALL SELECT key, 'test_in_train_or_val' FROM e WHERE key IN (SELECT key FROM t UNION SELECT key FROM v)
""",
)
def split_leak_set(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull())
    return dataset.split_leaks(rows, F.sha2(text.no_space(F.col("code")), 256), F.col("split"))


@query("repo_spread", f"SELECT repo_url, count(DISTINCT split) AS splits, count(*) AS records FROM new_detect WHERE {empty('repo_url')} <> '' GROUP BY repo_url HAVING count(DISTINCT split) > 1")
def repo_spread(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.coalesce("repo_url", F.lit("")) != "")
    return rows.groupBy("repo_url").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("records")).where(F.col("splits") > 1)


def _leak_sql() -> str:
    parts = []
    for t, where in (("new_detect", "true"), ("new_triage", "true")):
        for dim, key in (("exact", "sha256(code)"), ("normalized", f"sha256({collapsed('code')})")):
            parts.append(
                f"""
SELECT 'detect_eval' AS evaluation, '{t}' AS training, '{dim}' AS dimension, count(*) AS shared_keys, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS right_rows
FROM (SELECT {key} AS k, count(*) AS n FROM detect_eval WHERE code IS NOT NULL GROUP BY 1) a
JOIN (SELECT {key} AS k, count(*) AS n FROM {t} WHERE code IS NOT NULL AND {where} GROUP BY 1) b USING (k)
"""
            )
    return " UNION ALL ".join(parts)


def _keyed(df: DataFrame) -> DataFrame:
    rows = spread(df.where(F.col("code").isNotNull()).select("ordinal", "code"), "ordinal")
    return rows.select("ordinal", F.sha2("code", 256).alias("exact"), F.sha2(text.collapsed(F.col("code")), 256).alias("normalized"))


@query("leak_overlap", _leak_sql())
def leak_overlap(spark: SparkSession, d: str) -> DataFrame:
    training = {n: _keyed(table(spark, d, n)) for n in ("new_detect", "new_triage")}
    return dataset.leak_matrix({"detect_eval": _keyed(table(spark, d, "detect_eval"))}, training, {"exact": "exact", "normalized": "normalized"})


@query(
    "frozen_slice",
    f"""
SELECT ordinal FROM detect_eval e
WHERE NOT EXISTS (SELECT 1 FROM new_detect n WHERE n.code = e.code) AND NOT EXISTS (SELECT 1 FROM new_detect n WHERE {collapsed('n.code')} = {collapsed('e.code')})
""",
)
def frozen_slice(spark: SparkSession, d: str) -> DataFrame:
    keys = ["exact", "normalized"]
    held = table(spark, d, "detect_eval").select("ordinal", F.sha2("code", 256).alias("exact"), F.sha2(text.collapsed(F.col("code")), 256).alias("normalized"))
    seen = _keyed(_detect(spark, d))
    return relational.anti_either(held, [seen, seen], keys).select("ordinal")


@query("ast_leak")
def ast_leak(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records whose syntax tree occurs in training; text that doesn't parse has none."""
    key = lambda n: table(spark, d, n).select("ordinal", source_ast.tree_key(F.col("code")).alias("tree")).where(F.col("tree").isNotNull())
    return key("detect_eval").join(key("new_detect").select("tree").distinct(), "tree", "left_semi").select("ordinal")


@query("parseable", None)
def parseable(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).select("ordinal", "lang", source_ast.parses_as_python(F.col("code")).alias("parses"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("parses").alias("parsed"))


@query("source_parity", "SELECT id, sum(a) AS left_rows, sum(b) AS right_rows FROM (SELECT id, 1 AS a, 0 AS b FROM new_detect UNION ALL SELECT DISTINCT id, 0, 1 FROM new_detect) GROUP BY id HAVING sum(a) <> sum(b)")
def source_parity(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).select("id")
    return relational.multiset_parity(rows, rows.distinct(), "id")


@query("except_all_source", "SELECT source FROM new_detect EXCEPT ALL SELECT source FROM new_triage")
def except_all_source(spark: SparkSession, d: str) -> DataFrame:
    return _detect(spark, d).select("source").exceptAll(_triage(spark, d).select("source"))


@query("rule_coverage", "SELECT DISTINCT rule FROM new_detect WHERE rule IS NOT NULL EXCEPT SELECT rule FROM detect_eval")
def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _detect(spark, d).select("rule").where(F.col("rule").isNotNull()).subtract(table(spark, d, "detect_eval").select("rule"))


@query("symmetric_diff", "SELECT repo_url, CASE WHEN sum(a) > 0 THEN 'left' ELSE 'right' END AS side, sum(a) + sum(b) AS rows FROM (SELECT repo_url, 1 AS a, 0 AS b FROM new_detect UNION ALL SELECT repo_url, 0, 1 FROM candidates) WHERE repo_url IS NOT NULL GROUP BY repo_url HAVING sum(a) = 0 OR sum(b) = 0")
def symmetric_diff(spark: SparkSession, d: str) -> DataFrame:
    return relational.symmetric_difference(_detect(spark, d).select("repo_url"), table(spark, d, "candidates").select("repo_url"), "repo_url")


@query("union_sources", "SELECT source_name, task, count(*) AS n, count(finding) AS with_finding FROM (SELECT 'detect' AS source_name, task, NULL AS finding FROM new_detect UNION ALL SELECT 'triage', task, finding FROM new_triage UNION ALL SELECT 'eval', task, NULL FROM detect_eval) GROUP BY ALL")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = {"detect": _detect(spark, d).select("task"), "triage": _triage(spark, d).select("task", "finding"), "eval": table(spark, d, "detect_eval").select("task")}
    return relational.union_sources(parts).groupBy("source_name", "task").agg(F.count("*").alias("n"), F.count("finding").alias("with_finding"))


@query("fanout_pairs", "SELECT ordinal, 'detect' AS task, label.verdict = 'Confirm' AS vulnerable FROM new_triage WHERE label.verdict IS NOT NULL UNION ALL SELECT ordinal, 'triage', label.verdict = 'Confirm' FROM new_triage WHERE label.verdict IS NOT NULL")
def fanout_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _triage(spark, d).where(F.col("label.verdict").isNotNull())
    return rows.select("ordinal", F.explode(F.array(F.lit("detect"), F.lit("triage"))).alias("task"), (F.col("label.verdict") == "Confirm").alias("vulnerable"))


_LAST = "SELECT id, max(ordinal) AS ordinal, arg_max(split, ordinal) AS split FROM {0} WHERE id IS NOT NULL GROUP BY id"


@query("last_wins", "SELECT id, max(ordinal) AS ordinal FROM new_detect GROUP BY id")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return relational.last_wins(_detect(spark, d).select("id", "ordinal"), ["id"], "ordinal")


@query("upsert_merge", f"WITH m AS ({_LAST.format('new_detect')}), u AS ({_LAST.format('new_triage')}) SELECT coalesce(u.id, m.id) AS id, CASE WHEN u.id IS NOT NULL THEN u.ordinal ELSE m.ordinal END AS ordinal FROM m FULL JOIN u ON m.id = u.id")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    last = lambda n: relational.last_wins(table(spark, d, n).where(F.col("id").isNotNull()).select("id", "ordinal"), ["id"], "ordinal")
    return relational.upsert(last("new_detect"), last("new_triage"), "id")


@query("resume_pending", "SELECT candidate_id, count(*) AS n FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM candidates WHERE verified AND candidate_id IS NOT NULL) GROUP BY candidate_id")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").where(F.col("candidate_id").isNotNull())
    return rows.join(rows.where("verified").select("candidate_id").distinct(), "candidate_id", "left_anti").groupBy("candidate_id").agg(F.count("*").alias("n"))


@query(
    "counters_grouping_sets",
    "SELECT grouping(lang) AS g_lang, grouping(source) AS g_source, grouping(split) AS g_split, lang, source, split, count(*) AS n FROM new_detect GROUP BY GROUPING SETS ((lang), (source), (split))",
)
def counters_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d)
    sets = rows.groupingSets([[rows.lang], [rows.source], [rows.split]], rows.lang, rows.source, rows.split)
    counts = sets.agg(F.grouping("lang").cast("long").alias("g_lang"), F.grouping("source").cast("long").alias("g_source"), F.grouping("split").cast("long").alias("g_split"), F.count("*").alias("n"))
    return counts.select("g_lang", "g_source", "g_split", "lang", "source", "split", "n")


@query("top_counters", "SELECT package, count(*) AS n, min(ordinal) AS first_seen FROM candidates GROUP BY package ORDER BY n DESC, first_seen LIMIT 25")
def top_counters(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_counts(table(spark, d, "candidates").select("package", "ordinal"), "package", "ordinal", 25)


@query("exploded_counters", "SELECT split_part(r, ':', 1) AS reason, count(*) AS n FROM (SELECT unnest(match_reasons) AS r FROM candidates) WHERE r IS NOT NULL GROUP BY 1")
def exploded_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select(F.explode("match_reasons").alias("r")).where(F.col("r").isNotNull())
    return rows.groupBy(F.substring_index("r", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


@query("distinct_counts", "SELECT source, count(DISTINCT nullif(repo_url, '')) AS repos, count(DISTINCT nullif(advisory_id, '')) AS advisories, count_if(coalesce(repo_url, '') <> '' AND coalesce(fix_commit, '') <> '') AS with_commit FROM candidates GROUP BY source")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    return table(spark, d, "candidates").groupBy("source").agg(F.count_distinct(F.nullif("repo_url", F.lit(""))).alias("repos"), F.count_distinct(F.nullif("advisory_id", F.lit(""))).alias("advisories"), F.count_if(present("repo_url") & present("fix_commit")).alias("with_commit"))


@query("task_split_pivot", "SELECT task, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test FROM (SELECT task, split FROM new_detect UNION ALL SELECT task, split FROM new_triage) GROUP BY task")
def task_split_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).select("task", "split").unionByName(_triage(spark, d).select("task", "split"))
    return rows.groupBy("task").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")))


@query(
    "token_stats",
    r"""
WITH t AS (SELECT lang, greatest(1, CAST(ceil((length(code) - length(regexp_replace(code, '[\x00-\x7F]', '', 'g'))) / 4.0 + length(regexp_replace(code, '[\x00-\x7F]', '', 'g')) / 1.5) AS INTEGER)) AS tokens FROM new_detect WHERE code IS NOT NULL)
SELECT lang, count(*) AS n, min(tokens) AS least, max(tokens) AS most, CAST(sum(tokens) AS BIGINT) AS total FROM t GROUP BY lang
""",
)
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d).where(F.col("code").isNotNull()).select("lang", text.estimated_tokens(F.col("code")).alias("tokens"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.sum("tokens").alias("total"))


@query(
    "chat_to_messages",
    f"""
SELECT ordinal, 3 AS messages, 'Task: triage' || chr(10) || 'Language: ' || coalesce(lang, 'python') || chr(10) || 'Static Finding: ' || finding || chr(10) || 'Code:' || chr(10) || coalesce(code, '') AS user_text
FROM new_triage WHERE label.verdict IS NOT NULL AND {empty('finding')} <> ''
""",
)
def chat_to_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _triage(spark, d)
    chat = rows.select("ordinal", dataset.to_chat(rows, "triage").alias("ms")).where(F.col("ms").isNotNull())
    return chat.select("ordinal", F.size("ms").alias("messages"), F.col("ms")[1]["content"].alias("user_text"))


@query(
    "messages_to_record",
    r"""
WITH u AS (SELECT conv_id, coalesce(list_filter(messages, lambda m: lower(trim(m.role)) IN ('user', 'human'))[1].content, '') AS q FROM trainingdata),
p AS (SELECT conv_id, q, CASE WHEN contains(q, 'Code:' || chr(10)) THEN substr(q, instr(q, 'Code:' || chr(10)) + 6) ELSE '' END AS code, split_part(q, 'Code:' || chr(10), 1) AS head FROM u)
SELECT conv_id, CASE WHEN regexp_extract(q, '^Task:\s*(\w+)', 1) = '' THEN '?' ELSE regexp_extract(q, '^Task:\s*(\w+)', 1) END AS task,
  regexp_extract(head, '(?m)^Language: *(\S+)', 1) AS language, regexp_extract(head, '(?m)^Static Finding: *(.*)$', 1) AS finding, length(trim(code)) AS code_length
FROM p
""",
)
def messages_to_record(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset.from_chat(table(spark, d, "trainingdata"), "conv_id", "messages")
    return rows.select("conv_id", "task", "language", "finding", F.length("code").cast("long").alias("code_length"))


@query("role_turns", "SELECT lower(trim(m.role)) AS role, count(*) AS n, CAST(sum(length(m.content)) AS BIGINT) AS chars FROM (SELECT unnest(messages) AS m FROM trainingdata) GROUP BY 1")
def role_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "trainingdata").select(F.explode("messages").alias("m"))
    return rows.groupBy(F.lower(F.trim("m.role")).alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"))


@query(
    "json_extract_best_effort",
    """
WITH m AS (SELECT conv_id, i, messages[i].content AS a FROM (SELECT conv_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM trainingdata) WHERE lower(trim(messages[i].role)) IN ('assistant', 'gpt'))
SELECT conv_id, CAST(i AS INTEGER) AS place, coalesce(CASE WHEN json_valid(a) AND json_type(a) = 'OBJECT' THEN a ->> '$.cwe' END, nullif(regexp_extract(a, '"cwe"\\s*:\\s*"([^"]*)"', 1), '')) AS cwe FROM m
""".replace("\\\\", "\\"),
)
def json_extract_best_effort(spark: SparkSession, d: str) -> DataFrame:
    from auditlake.functions.jsons import best_effort_field

    rows = table(spark, d, "trainingdata").select("conv_id", F.posexplode("messages").alias("at", "m")).where(F.lower(F.trim("m.role")).isin("assistant", "gpt"))
    return rows.select("conv_id", (F.col("at") + 1).alias("place"), best_effort_field(F.col("m.content"), "cwe").alias("cwe"))


@query(
    "metadata_rows",
    f"""
SELECT ordinal, {empty('id')} AS sample_id, {empty('label.cwe')} AS cwe, {empty('label.severity')} AS severity, coalesce(CAST(label.vulnerable AS VARCHAR), '') AS vulnerable, {empty('source')} AS generator,
  CASE WHEN {empty('repo_url')} = '' THEN 'original' ELSE repo_url END AS repo_source, {empty('split')} AS split, CASE WHEN verified THEN 'verified_legacy' ELSE 'unverified' END AS label_verified_by,
  concat_ws(' ', 'task=' || {empty('task')}, CASE WHEN {empty('rule')} <> '' THEN 'rule=' || rule END, CASE WHEN {empty('category')} <> '' THEN 'category=' || category END) AS notes
FROM new_detect
""",
)
def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    return dataset.metadata(_detect(spark, d), "detect")


@query("record_manifest", "SELECT source, split, count(*) AS n, CAST(sum(octet_length(encode(code))) AS BIGINT) AS bytes, count_if(verified) AS verified, count_if(verified IS NULL) AS unknown FROM new_detect GROUP BY source, split")
def record_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = _detect(spark, d)
    return rows.groupBy("source", "split").agg(F.count("*").alias("n"), F.sum(F.octet_length("code")).alias("bytes"), F.count_if("verified").alias("verified"), F.count_if(F.col("verified").isNull()).alias("unknown"))


@query("quality_report", f"""
SELECT 'duplicate_ids' AS check_name, count(*) AS failures, count(*) = 0 AS passed FROM (SELECT id FROM new_detect GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'label_conflicts', count(*), count(*) = 0 FROM (SELECT 1 FROM new_detect WHERE {collapsed('code')} <> '' GROUP BY {collapsed('code')}, task HAVING count(DISTINCT label.vulnerable) > 1)
UNION ALL SELECT 'missing_fields', CAST(sum((id IS NULL)::INT + (task IS NULL)::INT + (code IS NULL)::INT + (source IS NULL)::INT + (split IS NULL)::INT) AS BIGINT), sum((id IS NULL)::INT + (task IS NULL)::INT + (code IS NULL)::INT + (source IS NULL)::INT + (split IS NULL)::INT) = 0 FROM new_detect
""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return dataset.quality_report(_detect(spark, d), "id")


@query("text_filter", "SELECT ordinal FROM new_triage WHERE label.severity = 'ERROR' AND contains(lower(concat_ws(' ', coalesce(finding, ''), coalesce(rule, ''), coalesce(file, ''), coalesce(label.explanation, ''))), 'key')")
def text_filter(spark: SparkSession, d: str) -> DataFrame:
    words = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("finding", "rule", "file", "label.explanation"))))
    return _triage(spark, d).where((F.col("label.severity") == "ERROR") & words.contains("key")).select("ordinal")
