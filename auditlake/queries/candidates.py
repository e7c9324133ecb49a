"""Queries over candidates: matching, scoring, ranking, groups, merges; and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.catalog import query
from auditlake.functions import text
from auditlake.operators import candidates, dataset, graph, relational, source_ast
from auditlake.queries.sql import LINE_END, collapsed, empty, quoted
from auditlake.sources.tables import table
from auditlake.streaming import feedback


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates")


_TARGET = "[" + ", ".join(map(quoted, dataset.TARGET_CWES)) + "]"
_LIST = lambda words: "(" + ", ".join(map(quoted, words)) + ")"
_EVERY = "list_filter(list_transform(coalesce(cwe_all, []), lambda x: upper(trim(x))), lambda x: x <> '')"
_RESOLVED = f"coalesce(nullif(upper(trim(cwe)), ''), list_filter({_EVERY}, lambda x: list_contains({_TARGET}, x))[1], {_EVERY}[1], '')"
_NORMAL = "CASE WHEN regexp_extract(upper(trim(x)), '(?:CWE[-_ ]?)?(\\d{1,4})', 1) <> '' THEN 'CWE-' || printf('%03d', CAST(regexp_extract(upper(trim(x)), '(?:CWE[-_ ]?)?(\\d{1,4})', 1) AS INTEGER)) ELSE '' END"
_CWES = f"list_filter(list_transform(list_concat([{empty('cwe')}], coalesce(cwe_all, [])), lambda x: {_NORMAL}), lambda x: x <> '')"
_HITS = f"len(list_filter(list_distinct({_CWES}), lambda x: list_contains({_TARGET}, x)))"
_PATH = f"replace({empty('file_path')}, chr(92), '/')"
_KIND = f"CASE WHEN {_PATH} = '' THEN 'unknown' WHEN regexp_matches({_PATH}, '(?i)(^|/)conftest\\.py$') THEN 'conftest' WHEN regexp_matches({_PATH}, '(?i)(^|/)(tests?|testing|testdata|test_data|fixtures?|examples?|docs?|benchmarks?|samples?)(/|$)|(^|/)test_[^/]*\\.py$|(^|/)[^/]*_test\\.py$') THEN 'test' ELSE 'production' END"


@query("cwe_resolution", f"SELECT ordinal, {_RESOLVED} AS resolved FROM candidates")
def cwe_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("ordinal", candidates.resolved_cwe().alias("resolved"))


@query("cwe_normalised", f"SELECT ordinal, {_HITS} AS hits, len(list_distinct({_CWES})) AS cwes FROM candidates")
def cwe_normalised(spark: SparkSession, d: str) -> DataFrame:
    own = candidates.record_cwes()
    hits = F.size(F.array_intersect(own, F.array(*map(F.lit, dataset.TARGET_CWES))))
    return _rows(spark, d).select("ordinal", hits.cast("long").alias("hits"), F.size(own).cast("long").alias("cwes"))


@query("path_kinds", f"SELECT {_KIND} AS kind, lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) AS suffix, count(*) AS n FROM candidates GROUP BY ALL")
def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.lower(F.regexp_extract("file_path", r"\.([^./\\]+)$", 1))
    return _rows(spark, d).groupBy(text.path_kind(F.col("file_path")).alias("kind"), suffix.alias("suffix")).agg(F.count("*").alias("n"))


@query("file_inventory", "SELECT split_part(file_path, '/', 1) AS folder, count(*) AS files, count(DISTINCT file_path) AS paths, count_if(coalesce(code_fixed, '') <> '') AS with_fix FROM candidates WHERE coalesce(file_path, '') <> '' GROUP BY 1")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).where(F.coalesce("file_path", F.lit("")) != "")
    return rows.groupBy(F.substring_index("file_path", "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.count_distinct("file_path").alias("paths"), F.count_if(F.coalesce("code_fixed", F.lit("")) != "").alias("with_fix"))


_SCORE = f"""
(CASE WHEN {empty('fix_commit')} <> '' THEN 3 ELSE 0 END) + (CASE WHEN NOT vb AND NOT fb THEN 4 ELSE 0 END)
+ (CASE WHEN vb THEN 0 WHEN n BETWEEN 4 AND 120 THEN 2 WHEN n < 4 THEN -2 ELSE -1 END) + (CASE kind WHEN 'production' THEN 3 WHEN 'test' THEN -4 WHEN 'conftest' THEN -4 ELSE 0 END)
+ (CASE WHEN regexp_matches(v || chr(10) || f, {quoted(candidates.CRYPTO_API)}) THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(v, {quoted(candidates.WEAK_PRIMITIVE)}) THEN 2 ELSE 0 END)
+ (CASE WHEN {empty('cve_id')} <> '' THEN 2 ELSE 0 END) + (CASE WHEN lower({empty('package')}) IN {_LIST(candidates.WATCHLIST)} THEN 1 ELSE 0 END)
+ (CASE WHEN list_contains({_TARGET}, resolved) THEN 2 WHEN resolved <> '' THEN 1 ELSE 0 END) + (CASE WHEN len(list_filter(coalesce(match_reasons, []), lambda r: starts_with(r, 'keyword:'))) > 0 THEN 1 ELSE 0 END)
"""


@query(
    "candidate_score",
    f"""
WITH a AS (SELECT *, {empty('code_vuln')} AS v, {empty('code_fixed')} AS f, {_RESOLVED} AS resolved, {_KIND} AS kind FROM candidates),
b AS (SELECT *, regexp_full_match(v, '\\s*') AS vb, regexp_full_match(f, '\\s*') AS fb, len(list_filter(regexp_split_to_array(v, '{LINE_END}'), lambda x: NOT regexp_full_match(x, '\\s*'))) AS n FROM a)
SELECT ordinal, CAST({_SCORE} AS INTEGER) AS score FROM b
""",
)
def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    """The review score without the terms that need a parser."""
    return _rows(spark, d).select("ordinal", candidates.screening_score().alias("score"))


@query("candidate_score_parsed")
def candidate_score_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The whole review score, with the terms for code that parses."""
    rows = _rows(spark, d).withColumn("both", source_ast.parses_as_python(F.col("code_vuln")) & source_ast.parses_as_python(F.col("code_fixed")))
    return rows.select("ordinal", candidates.screening_score(F.col("both")).alias("score"))


_RANK = f"""
SELECT *, CAST((CASE WHEN hits > 0 THEN 100 ELSE 0 END) + (CASE WHEN hits > 1 THEN 10 ELSE 0 END) + (CASE WHEN kw THEN 30 ELSE 0 END)
 + (CASE WHEN pk IN {_LIST(candidates.CORE_PACKAGES)} THEN 40 WHEN pk IN {_LIST(candidates.SECONDARY_PACKAGES)} THEN 15 ELSE 0 END) + (CASE WHEN wl THEN 5 ELSE 0 END)
 + (CASE WHEN regexp_matches({empty('repo_url')}, {quoted(candidates.CODE_HOST)}) THEN 15 ELSE 0 END) + (CASE WHEN length(trim({empty('fix_commit')})) >= 7 THEN 10 ELSE 0 END) - (CASE WHEN hits = 0 AND NOT kw THEN 50 ELSE 0 END) AS INTEGER) AS score,
 CASE WHEN hits > 0 AND kw THEN 'P0' WHEN hits > 0 THEN 'P1' WHEN kw AND pk IN {_LIST(candidates.CORE_PACKAGES)} THEN 'P2' ELSE 'P3' END AS tier
FROM (SELECT *, {_HITS} AS hits, len(list_filter(coalesce(match_reasons, []), lambda r: starts_with(r, 'keyword:'))) > 0 AS kw, len(list_filter(coalesce(match_reasons, []), lambda r: starts_with(r, 'watchlist:'))) > 0 AS wl, lower(trim({empty('package')})) AS pk FROM candidates)
"""


@query("fetch_rank", f"SELECT ordinal, score, tier FROM ({_RANK})")
def fetch_rank(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("ordinal", candidates.fetch_rank().alias("r")).select("ordinal", "r.*")


@query("fetch_rank_top", f"SELECT CAST(row_number() OVER (ORDER BY score DESC, tier, package, candidate_id, ordinal) AS INTEGER) AS rank, ordinal, score, tier FROM ({_RANK}) ORDER BY rank LIMIT 60")
def fetch_rank_top(spark: SparkSession, d: str) -> DataFrame:
    """The first sixty of the fetch queue with their rank."""
    from pyspark.sql import Window

    rows = _rows(spark, d).select("ordinal", "package", "candidate_id", candidates.fetch_rank().alias("r")).select("ordinal", "package", "candidate_id", "r.*")
    order = [F.desc("score"), F.col("tier"), F.col("package").asc_nulls_last(), F.col("candidate_id").asc_nulls_last(), F.col("ordinal")]
    top = rows.orderBy(*order).limit(60)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "ordinal", "score", "tier")


def _hint_sql() -> str:
    by_cwe = "CASE x " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in candidates.RULE_HINT.items()) + " END"
    words = "lower(concat_ws(' ', package, advisory_id, array_to_string(match_reasons, ' ')))"
    by_text = "CASE " + " ".join(f"WHEN regexp_matches({words}, {quoted(p)}) THEN '{r}'" for p, r in candidates.TEXT_HINT) + " ELSE '' END"
    return f"SELECT ordinal, coalesce(list_filter(list_transform({_CWES}, lambda x: {by_cwe}), lambda x: x IS NOT NULL)[1], CASE WHEN list_contains({_CWES}, 'CWE-327') THEN {by_text} END, '') AS rule FROM candidates"


@query("suggested_rules", _hint_sql())
def suggested_rules(spark: SparkSession, d: str) -> DataFrame:
    words = F.concat_ws(" ", "package", "advisory_id", F.array_join("match_reasons", " "))
    return _rows(spark, d).select("ordinal", candidates.suggested_rule(candidates.record_cwes(), words).alias("rule"))


@query("advisory_match", f"""
WITH a AS (SELECT ordinal, list_filter([package], lambda x: x IS NOT NULL AND x <> '') AS ps, list_sort(list_filter(list_distinct({_CWES}), lambda x: list_contains({_TARGET}, x))) AS hit, regexp_extract(coalesce(static_finding, ''), '(?i)encrypt|decrypt|hash|sign', 0) AS w FROM candidates)
SELECT ordinal, CASE WHEN len(ps) = 0 THEN 'no_package' WHEN len(hit) > 0 OR len(list_filter(ps, lambda p: lower(p) IN {_LIST(candidates.WATCHLIST)})) > 0 OR w <> '' THEN 'matched' ELSE 'out_of_scope' END AS outcome,
  CAST((len(hit) > 0)::INT + (len(list_filter(ps, lambda p: lower(p) IN {_LIST(candidates.WATCHLIST)})) > 0)::INT + (w <> '')::INT AS INTEGER) AS reasons FROM a
""")
def advisory_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether each candidate is in scope by CWE, package or keyword."""
    packages = F.filter(F.array("package"), lambda x: x.isNotNull() & (x != ""))
    found = candidates.match_outcome(packages, candidates.record_cwes(), F.coalesce("static_finding", F.lit("")), "encrypt|decrypt|hash|sign", F.lit(False))
    return _rows(spark, d).select("ordinal", found.alias("m")).select("ordinal", "m.outcome", F.size("m.reasons").alias("reasons"))


@query("csv_filter_reasons", f"""
SELECT CASE WHEN {_HITS} = 0 THEN 'no_target_cwe' WHEN trim({empty('code_vuln')}) = '' OR trim({empty('code_fixed')}) = '' THEN 'blank_side' WHEN code_vuln = code_fixed THEN 'identical' ELSE 'kept' END AS outcome, count(*) AS n FROM candidates GROUP BY 1
""")
def csv_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return candidates.csv_outcomes(_rows(spark, d), candidates.record_cwes())


def _group_keys() -> list:
    present = lambda c: F.nullif(F.col(c), F.lit(""))
    triple = F.when(present("repo_url").isNotNull() & present("fix_commit").isNotNull(), F.concat_ws("\x01", "repo_url", "fix_commit", F.coalesce("file_path", F.lit(""))))
    code = F.nullif(text.digest(F.col("code_vuln")), F.lit(""))
    return [F.coalesce(present("advisory_id"), present("cve_id")), triple, code]


_KEYS_SQL = f"""
SELECT ordinal, 'a' || coalesce(nullif(advisory_id, ''), nullif(cve_id, '')) AS k FROM candidates
UNION ALL SELECT ordinal, 't' || repo_url || chr(1) || fix_commit || chr(1) || {empty('file_path')} FROM candidates WHERE {empty('repo_url')} <> '' AND {empty('fix_commit')} <> ''
UNION ALL SELECT ordinal, 'c' || sha256({collapsed('code_vuln')}) FROM candidates WHERE {empty('code_vuln')} <> ''
"""


_CLUSTERS = f"""
WITH RECURSIVE k AS (SELECT ordinal, k FROM ({_KEYS_SQL}) WHERE k IS NOT NULL), f AS (SELECT k, min(ordinal) AS f FROM k GROUP BY k),
e AS (SELECT DISTINCT k.ordinal AS a, f.f AS b FROM k JOIN f USING (k) WHERE k.ordinal <> f.f), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(o, g) AS (SELECT ordinal, ordinal FROM candidates UNION SELECT s.b, r.g FROM r JOIN s ON s.a = r.o WHERE r.g < s.b)
SELECT o AS ordinal, min(g) AS "group" FROM r GROUP BY o
"""


@query("cluster_dedupe", _CLUSTERS)
def cluster_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The group of each candidate by shared advisory, commit of a file, or code."""
    return graph.connected_groups(_rows(spark, d), "ordinal", _group_keys())


@query("cluster_survivors", f"""
WITH s AS (SELECT ordinal, (CASE WHEN NOT vb AND NOT fb THEN 1000 ELSE 0 END) + CAST({_SCORE} AS INTEGER) AS strength FROM (SELECT *, regexp_full_match(v, '\\s*') AS vb, regexp_full_match(f, '\\s*') AS fb, len(list_filter(regexp_split_to_array(v, '{LINE_END}'), lambda x: NOT regexp_full_match(x, '\\s*'))) AS n
  FROM (SELECT *, {empty('code_vuln')} AS v, {empty('code_fixed')} AS f, {_RESOLVED} AS resolved, {_KIND} AS kind FROM candidates)))
SELECT ordinal, "group", strength FROM ({_CLUSTERS}) JOIN s USING (ordinal) QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY strength DESC, ordinal) = 1
""")
def cluster_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The strongest candidate of each group: a code pair first, then the score."""
    filled = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"^\s*$")
    pair = (filled("code_vuln") & filled("code_fixed")).cast("int")
    # only digests and scores are shuffled, no code
    keys = [k.alias(f"key_{i}") for i, k in enumerate(_group_keys())]
    rows = _rows(spark, d).select("ordinal", (pair * 1000 + candidates.screening_score()).alias("strength"), *keys)
    kept = graph.keep_strongest(rows, "ordinal", [F.col(f"key_{i}") for i in range(len(keys))], F.col("strength"))
    return kept.select("ordinal", "group", "strength")


@query("fetch_queue_greedy")
def fetch_queue_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in order of arrival, each kept if neither its advisory nor its commit was kept before."""
    rows = _rows(spark, d).where((F.coalesce("repo_url", F.lit("")) != "") & (F.coalesce("fix_commit", F.lit("")) != ""))
    rows = rows.select("ordinal", F.coalesce(F.nullif("advisory_id", F.lit("")), F.nullif("cve_id", F.lit(""))).alias("advisory"), F.concat_ws("\x01", "repo_url", "fix_commit").alias("commit"))
    return graph.greedy_two_keys(rows, "ordinal", "advisory", "commit").select("ordinal")


@query("fold_merge")
def fold_merge(spark: SparkSession, d: str) -> DataFrame:
    """Candidates merged by identifier; a longer later row wins and takes what it lacks from the earlier one."""
    rows = _rows(spark, d).select("candidate_id", "ordinal", "advisory_id", "fix_commit", "cve_id", "cwe", "code_fixed")
    return relational.fold_merge(rows, "candidate_id", "ordinal").select("candidate_id", "ordinal", "advisory_id", "fix_commit", "cve_id", "cwe", F.length("code_fixed").alias("fixed_length"))


@query("feedback_stream", "SELECT event_type, count(*) AS n, CAST(sum(value) AS DECIMAL(38, 2)) AS total FROM events GROUP BY event_type")
def feedback_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts and totals by type, kept by a stream in complete mode."""
    stream = feedback.event_stream(spark, d)
    totals = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,2)")).cast("decimal(38,2)").alias("total"))
    return feedback.run_to_table(totals, "complete", "feedback")


@query("stream_once", "SELECT DISTINCT user_id, true AS seen, CAST(1 AS BIGINT) AS n FROM events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """One row for each user that a stream has seen; a key is remembered for the ten years that events may be late."""
    stream = feedback.event_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = feedback.run_to_table(feedback.once(stream, "user_id", "ts", "3650 days"), "append", "once")
    return rows.select("user_id", F.lit(True).alias("seen"), F.lit(1).cast("long").alias("n"))


@query("recent_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 30")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(30)
