"""Queries of the screening operators: tiers, gates, checks, addresses, picks, projections and fixes by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.catalog import query
from auditlake.functions import hashing, text
from auditlake.operators import candidates, dataset, fixtures, metrics, relational, scan, screening, source_ast, tree_rules
from auditlake.queries.audits import _BOTH_SQL, _RANGES_SQL, _RANK_SQL, _RULES_SQL, _TRIAGE_SQL, _detect_sql, _findings, _findings_sql, _LLM_SQL, _metrics_sql, _python_records, _two_engines
from auditlake.queries.candidates import _KIND, _NORMAL, _RESOLVED, _SCORE
from auditlake.queries.sql import LINE_END, collapsed, empty, no_space, quoted
from auditlake.sources.tables import table
from auditlake.streaming import feedback

_BLANK = lambda c: f"regexp_full_match(coalesce({c}, ''), '\\s*')"
_SCORED = f"""
SELECT *, CAST({_SCORE} AS INTEGER) AS score, len(list_filter(coalesce(match_reasons, []), lambda r: starts_with(r, 'pycode-vul:') OR starts_with(r, 'predicted:'))) > 0 AS predicted FROM (
  SELECT *, {_BLANK('code_vuln')} AS vb, {_BLANK('code_fixed')} AS fb, len(list_filter(regexp_split_to_array(v, '{LINE_END}'), lambda x: NOT regexp_full_match(x, '\\s*'))) AS n
  FROM (SELECT *, {empty('code_vuln')} AS v, {empty('code_fixed')} AS f, {_RESOLVED} AS resolved, {_KIND} AS kind FROM candidates))
"""
_TIERS = f"""
SELECT ordinal, package, score, CASE WHEN predicted AND {empty('advisory_id')} = '' AND t = 'P1' THEN 'P2' ELSE t END AS tier FROM (
  SELECT *, CASE WHEN {empty('advisory_id')} = '' AND {empty('cve_id')} = '' THEN 'P3' WHEN {empty('fix_commit')} = '' OR vb THEN 'P3' WHEN kind IN ('test', 'conftest') THEN 'P3'
    WHEN score >= 12 THEN 'P1' WHEN score >= 8 THEN 'P2' ELSE 'P3' END AS t FROM ({_SCORED}))
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates")


def _tiered(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).withColumn("score", candidates.screening_score())
    return rows.select("ordinal", "package", "score", screening.screening_tier(F.col("score")).alias("tier"))


@query("candidate_tiers", f"SELECT ordinal, score, tier FROM ({_TIERS})")
def candidate_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Score without parser terms and tier of every candidate."""
    return _tiered(spark, d).drop("package")


@query("candidate_tiers_parsed")
def candidate_tiers_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Score and tier with the terms for code that parses."""
    both = source_ast.parses_as_python(F.col("code_vuln")) & source_ast.parses_as_python(F.col("code_fixed"))
    rows = _candidates(spark, d).withColumn("both", both).withColumn("score", candidates.screening_score(F.col("both")))
    return rows.select("ordinal", "score", screening.screening_tier(F.col("score")).alias("tier"))


@query("screen_top", f"SELECT CAST(row_number() OVER (ORDER BY score DESC, package NULLS FIRST, ordinal) AS INTEGER) AS rank, ordinal, score FROM ({_TIERS}) ORDER BY rank LIMIT 100")
def screen_top(spark: SparkSession, d: str) -> DataFrame:
    """The hundred highest scores, by package and arrival."""
    order = [F.desc("score"), F.col("package").asc_nulls_first(), F.col("ordinal")]
    top = _tiered(spark, d).orderBy(*order).limit(100)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "ordinal", "score")


@query("code_pairs", f"SELECT ordinal, NOT vb AND NOT fb AS pair, predicted, {empty('fix_commit')} <> '' AND kind = 'production' AS fixed_in_production FROM ({_SCORED})")
def code_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the volume predicate that need no parser."""
    fixed = (F.coalesce("fix_commit", F.lit("")) != "") & (text.path_kind(F.col("file_path")) == "production")
    return _candidates(spark, d).select("ordinal", screening.has_code_pair().alias("pair"), screening.is_predicted().alias("predicted"), fixed.alias("fixed_in_production"))


@query("volume_candidates")
def volume_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with a commit, a production file and code pairs that parse."""
    both = source_ast.parses_as_python(F.col("code_vuln")) & source_ast.parses_as_python(F.col("code_fixed"))
    rows = _candidates(spark, d).where(screening.is_volume(F.lit(True))).withColumn("both", both)
    return rows.where("both").select("ordinal")


_OWN_CWE = f"list_transform([{empty('label.cwe')}], lambda x: {_NORMAL})[1]"


@query("exclusion_reasons", f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lower({empty('label.verdict')}) IN ('reject', 'false', 'negative') THEN 'control_row'
  WHEN regexp_matches(lower({empty('source')}), '^(round4-exp|round4-negative|round4-pos|round4-neg|round5-|round6-|semgrep-rule-fixture|bandit-rule-fixture)') THEN 'synthetic_source'
  WHEN {_BLANK('code')} THEN 'no_code' WHEN trim({empty('rule')}) = '' AND {_OWN_CWE} = '' THEN 'no_taxonomy'
  WHEN NOT regexp_full_match(upper(trim({empty('rule')})), 'CRYPTO-0(0[1-9]|1[0-3])') AND {_OWN_CWE} NOT IN ('CWE-208', 'CWE-256', 'CWE-295', 'CWE-321', 'CWE-326', 'CWE-327', 'CWE-329', 'CWE-338', 'CWE-916') THEN 'outside_taxonomy'
  WHEN NOT regexp_matches(lower(trim({empty('lang')})), '^(py$|python)') AND trim({empty('lang')}) <> '' THEN 'other_language'
  WHEN trim({empty('lang')}) = '' AND lower(regexp_extract({empty('file')}, '(\\.[^./\\\\]+)$', 1)) NOT IN ('', '.py', '.pyi') THEN 'other_file' ELSE 'kept' END AS reason FROM new_triage) GROUP BY reason
""")
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Triage records by the first reason that keeps them from being candidates."""
    reason = screening.exclusion_reason(F.col("code"), F.col("label.verdict"), F.lit(None).cast("boolean"), F.col("source"), F.col("rule"), F.col("label.cwe"), F.col("lang"), F.col("file"))
    return table(spark, d, "new_triage").select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_RULE_KEYS = "regexp_full_match(trim(rule_id), 'CRYPTO-0(0[1-9]|1[0-3])')"


@query("candidate_errors", f"""
SELECT ordinal, array_to_string(list_filter([CASE WHEN {empty('candidate_id')} = '' THEN 'no_id' END, CASE WHEN {empty('source')} = '' THEN 'no_source' END, CASE WHEN NOT k THEN 'class' END,
  CASE WHEN k AND r <> '' AND NOT {_RULE_KEYS} THEN 'unknown_rule' END, CASE WHEN a AND c <> '' AND c NOT IN ('CWE-208', 'CWE-256', 'CWE-295', 'CWE-321', 'CWE-326', 'CWE-327', 'CWE-329', 'CWE-338', 'CWE-916') THEN 'cwe_outside_target' END,
  CASE WHEN k AND {_RULE_KEYS} AND c <> '' AND NOT list_contains(CASE WHEN r <= 'CRYPTO-005' THEN ['CWE-327'] WHEN r = 'CRYPTO-006' THEN ['CWE-329'] WHEN r = 'CRYPTO-007' THEN ['CWE-321'] WHEN r = 'CRYPTO-008' THEN ['CWE-338']
    WHEN r = 'CRYPTO-009' THEN ['CWE-326'] WHEN r = 'CRYPTO-010' THEN ['CWE-326', 'CWE-295'] WHEN r = 'CRYPTO-011' THEN ['CWE-256'] WHEN r = 'CRYPTO-012' THEN ['CWE-916'] ELSE ['CWE-208'] END, c) THEN 'cwe_against_rule' END,
  CASE WHEN a AND {empty('advisory_id')} = '' AND {empty('cve_id')} = '' THEN 'no_advisory' END, CASE WHEN a AND {empty('repo_url')} = '' THEN 'no_repo' END, CASE WHEN a AND {empty('vuln_commit')} = '' AND {empty('fix_commit')} = '' THEN 'no_commit' END,
  CASE WHEN a AND {empty('file_path')} = '' THEN 'no_file' END, CASE WHEN a AND {empty('function_name')} = '' THEN 'no_function' END, CASE WHEN a AND r = '' THEN 'no_rule' END, CASE WHEN a AND c = '' THEN 'no_cwe' END,
  CASE WHEN a AND lower(trim({empty('license')})) IN ('', 'unknown', 'n/a', 'none', 'tbd') THEN 'no_license' END, CASE WHEN a AND {empty('human_verdict')} = '' THEN 'no_verdict' END], lambda x: x IS NOT NULL), ',') AS errors
FROM (SELECT *, trim({empty('rule_id')}) AS r, trim({empty('cwe')}) AS c, coalesce(preliminary_class IN ('A', 'B', 'C', 'D'), false) AS k, coalesce(preliminary_class = 'A', false) AS a FROM candidates)
""")
def candidate_errors(spark: SparkSession, d: str) -> DataFrame:
    """The structural errors of each candidate."""
    return _candidates(spark, d).select("ordinal", F.array_join(screening.structural_errors(), ",").alias("errors"))


@query("licences", f"SELECT ordinal, '' AS hint, CASE WHEN upper(trim({empty('license')})) IN ('NOASSERTION', 'NONE', 'UNKNOWN') THEN '' ELSE trim({empty('license')}) END AS concrete FROM candidates")
def licences(spark: SparkSession, d: str) -> DataFrame:
    """Licences by repository (none of the data's is known) and as given."""
    return _candidates(spark, d).select("ordinal", screening.licence_hint(F.col("repo_url")).alias("hint"), screening.concrete_licence(F.col("license")).alias("concrete"))


@query("merged_verdicts", f"""
SELECT n.ordinal, upper(coalesce(nullif(label.verdict, ''), 'UNCERTAIN')) AS verdict, round_even(coalesce(nullif(TRY_CAST(label.confidence AS DOUBLE), 0), 0.5), 2) AS confidence,
  CASE WHEN upper({empty('label.severity')}) IN ('INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper(label.severity) ELSE coalesce(r.severity, 'MEDIUM') END AS severity
FROM new_triage n LEFT JOIN (SELECT * FROM {_RULES_SQL}) r ON r.rule_id = n.rule
""")
def merged_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers merged into the findings they are about."""
    rows = table(spark, d, "new_triage")
    rules = scan.rule_table(rows).select(F.col("rule_id").alias("rule"), F.col("severity").alias("own"))
    merged = screening.merged_verdict(F.col("label.severity"), F.col("label.verdict"), F.col("label.confidence"), F.col("own"))
    return rows.select("ordinal", "rule", "label").join(F.broadcast(rules), "rule", "left").select("ordinal", merged.alias("m")).select("ordinal", "m.*")


@query("file_categories", f"""
SELECT category, count(*) AS n FROM (SELECT CASE WHEN package = 'itsdangerous' THEN 'hmac-legacy-digest' WHEN package = 'passlib' THEN 'legacy-hash-scheme'
  WHEN contains(p, 'selftest') OR contains(p, '/test_') OR starts_with(p, 'test_') THEN 'test-vector' WHEN contains(p, 'speedtest') THEN 'benchmark' ELSE 'legacy-format' END AS category
FROM (SELECT package, lower({empty('file_path')}) AS p FROM candidates)) GROUP BY category
""")
def file_categories(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select(screening.file_category(F.col("package"), F.col("file_path")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("prefix_leaks", f"""
WITH r AS (SELECT lower(trim(split)) AS s, sha256(code) AS k FROM new_detect WHERE {empty('code')} <> '')
SELECT count(DISTINCT k) AS codes, count(DISTINCT CASE WHEN k IN (SELECT k FROM r WHERE s IN ('train', 'val')) THEN k END) AS leaked FROM r WHERE s = 'test'
""")
def prefix_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct held-out codes, and those that training or validation has too."""
    rows = table(spark, d, "new_detect").where(F.coalesce("code", F.lit("")) != "").select(F.lower(F.trim("split")).alias("s"), F.sha2("code", 256).alias("k")).where(F.col("s").isin("train", "val", "test"))
    sides = rows.groupBy("k").agg(F.max(F.col("s") == "test").alias("held"), F.max(F.col("s") != "test").alias("seen"))
    return sides.agg(F.count_if("held").alias("codes"), F.count_if(F.col("held") & F.col("seen")).alias("leaked"))


@query("id_lists", "SELECT rule, CAST(ordinal // 1000 AS BIGINT) AS stretch, array_to_string(list(coalesce(id, '') ORDER BY ordinal), ' ') AS ids FROM new_detect WHERE rule IS NOT NULL GROUP BY 1, 2")
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    """The identifiers of each rule in order of arrival, a list a stretch of arrivals."""
    rows = table(spark, d, "new_detect").select("rule", "ordinal", F.coalesce("id", F.lit("")).alias("id"))
    return screening.id_lists(rows, "rule", "id", "ordinal").select("rule", "stretch", F.array_join("ids", " ").alias("ids"))


@query("shared_keys", f"""
WITH a AS (SELECT sha256({no_space('code')}) AS k, ordinal FROM new_detect WHERE code IS NOT NULL), b AS (SELECT sha256({no_space('code')}) AS k, ordinal FROM new_triage WHERE code IS NOT NULL)
SELECT k, 'a' AS side, ordinal AS id FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT k, 'b', ordinal FROM b WHERE k IN (SELECT k FROM a)
""")
def shared_keys(spark: SparkSession, d: str) -> DataFrame:
    """The records of two tables whose code is the same without white space."""
    sides = [table(spark, d, name).where(F.col("code").isNotNull()).select("ordinal", F.sha2(text.no_space(F.col("code")), 256).alias("k")) for name in ("new_detect", "new_triage")]
    return screening.shared_keys(*sides, "k", "ordinal")


_HITS = f"SELECT ordinal, list(DISTINCT rule_id) AS hits FROM ({_findings_sql()}) GROUP BY ordinal"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("ordinal").agg(F.collect_set("rule_id").alias("hits"))


@query("backtest_buckets", f"""
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN task = 'detect' AND v AND hits IS NULL THEN 'pos_missing' WHEN task = 'detect' AND NOT v AND s LIKE '%aneg' AND hits IS NOT NULL THEN 'aneg_hit'
  WHEN task = 'detect' AND NOT v AND s LIKE '%bneg' AND hits IS NULL THEN 'bneg_no_fire'
  WHEN task = 'triage' AND {empty('rule')} <> '' AND NOT coalesce(list_contains(hits, rule), false) AND NOT contains(s, 'passlib') AND NOT contains(s, 'real') THEN 'finding_miss' END AS bucket
FROM (SELECT n.task, n.rule, coalesce(n.label.vulnerable, false) AS v, {empty('n.source')} AS s, h.hits FROM new_detect n LEFT JOIN ({_HITS}) h USING (ordinal))) WHERE bucket IS NOT NULL GROUP BY bucket
""")
def backtest_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Records that don't keep to the rules they should show, by what is wrong."""
    rows = table(spark, d, "new_detect").select("ordinal", "task", "label.vulnerable", "source", "rule").join(_hits(spark, d), "ordinal", "left")
    bucket = screening.backtest_bucket(F.col("task"), F.col("vulnerable"), F.col("source"), F.col("rule"), F.col("hits"))
    return rows.select(bucket.alias("bucket")).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))


@query("acceptance_gates", f"""
WITH m AS ({_metrics_sql(_LLM_SQL)}) SELECT 'precision' AS metric, precision::DOUBLE AS value, 0.54::DOUBLE AS "limit", precision > 0.54 AS passed FROM m
UNION ALL SELECT 'accuracy', accuracy, 0.95, accuracy >= 0.95 FROM m UNION ALL SELECT 'false_rate', fp / n, 0.06, fp / n <= 0.06 FROM m
""")
def acceptance_gates(spark: SparkSession, d: str) -> DataFrame:
    """Detection metrics of the mock model against their limits."""
    rows = table(spark, d, "new_detect").select("label", scan.mock_detect(F.col("code")).alias("p"))
    found = metrics.detect_metrics(rows, F.col("label.vulnerable"), F.col("p.vulnerable"), F.col("label.cwe"), F.col("p.cwe")).withColumn("false_rate", F.col("fp") / F.col("n"))
    return screening.gates(found, [("precision", ">", 0.54), ("accuracy", ">=", 0.95), ("false_rate", "<=", 0.06)])


_CONFIDENCE = "CASE lower(trim(label.confidence)) WHEN 'low' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.6 WHEN 'high' THEN 0.9 ELSE coalesce(greatest(0.0, least(1.0, TRY_CAST(label.confidence AS DOUBLE))), 0.5) END"


@query("review_order", f"""
SELECT CAST(row_number() OVER (ORDER BY u, c DESC, w, ordinal) AS INTEGER) AS rank, ordinal FROM (SELECT ordinal, CASE WHEN contains(lower({empty('label.verdict')}), 'confirm') OR contains(lower({empty('label.verdict')}), 'reject') THEN 1 ELSE 0 END AS u,
  {_CONFIDENCE} AS c, {empty('label.cwe')} AS w FROM new_triage) ORDER BY rank LIMIT 100
""")
def review_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred to review: undecided ones, then by confidence, CWE and arrival."""
    rows = table(spark, d, "new_triage").select("ordinal", (text.verdict(F.col("label.verdict")) != "?").cast("int").alias("u"), text.confidence(F.col("label.confidence")).alias("c"), F.coalesce("label.cwe", F.lit("")).alias("w"))
    order = ["u", F.desc("c"), "w", "ordinal"]
    return rows.orderBy(*order).limit(100).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "ordinal")


_SQUEEZED = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '', 'g')"
_FILE_SCORE = f"""
SELECT *, CASE WHEN low = '' OR len(list_filter(folders, lambda x: x IN ('test', 'tests', 'testing', 'testdata', 'fixtures', 'fixture', 'examples', 'example', 'docs', 'doc', 'benchmarks', 'benchmark', 'samples', 'sample'))) > 0
    OR regexp_matches(leaf, '^test_|_test\\.py$|^conftest\\.py$|fixture|example|benchmark') THEN -10000
  ELSE (CASE WHEN length({_SQUEEZED('package')}) >= 3 AND contains({_SQUEEZED('low')}, {_SQUEEZED('package')}) THEN 8 ELSE 0 END) + (CASE WHEN regexp_matches(low, '(^|/)(src|lib|libs)/') THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(low, '^(src|lib|libs)/') THEN 2 ELSE 0 END)
    + (CASE WHEN hits > 0 THEN least(hits, 3) + 4 ELSE 0 END) + least(changed // 10, 4) + (CASE WHEN length(low) <= 80 THEN 1 ELSE 0 END) END AS score
FROM (SELECT *, regexp_extract(low, '([^/]*)$', 1) AS leaf, string_split(low, '/')[:-2] AS folders,
  len(list_filter(['crypt', 'cipher', 'hash', 'key', 'token', 'sign', 'secret', 'ssl', 'tls', 'jwt', 'rsa', 'auth', 'password', 'random', 'cert'], lambda t: contains(regexp_extract(low, '([^/]*)$', 1), t))) AS hits,
  len(list_filter(regexp_split_to_array({empty('code_vuln')}, '{LINE_END}'), lambda x: regexp_matches(x, '^\\+') AND NOT starts_with(x, '+++') OR regexp_matches(x, '^-') AND NOT starts_with(x, '---'))) AS changed
  FROM (SELECT *, lower(replace({empty('file_path')}, chr(92), '/')) AS low FROM candidates))
"""


@query("file_scores", f"SELECT ordinal, CAST(score AS INTEGER) AS score FROM ({_FILE_SCORE})")
def file_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of each candidate's file as the implementation of its fix."""
    return _candidates(spark, d).select("ordinal", candidates.file_score(F.col("file_path"), F.col("code_vuln"), F.col("package")).alias("score"))


@query("primary_files", f"""
SELECT candidate_id, path, CAST(score AS INTEGER) AS score FROM (SELECT candidate_id, CASE WHEN score > -10000 THEN coalesce(file_path, '') END AS path, CASE WHEN score > -10000 THEN score END AS score,
  row_number() OVER (PARTITION BY candidate_id ORDER BY score = -10000, code_vuln IS NULL, score DESC, changed DESC, length({empty('file_path')}), {empty('file_path')}) AS n FROM ({_FILE_SCORE})) WHERE n = 1
""")
def primary_files(spark: SparkSession, d: str) -> DataFrame:
    """The best file of each candidate."""
    return screening.primary_file(_candidates(spark, d), "candidate_id", "file_path", "code_vuln", "package")


_HOST = candidates.CODE_HOST
_OWNER = lambda u, i: f"lower(regexp_replace(regexp_extract({u}, {quoted(_HOST)}, {i}), '\\.git$', ''))"


@query("commit_hints", f"""
WITH r AS (SELECT ordinal, 0 AS i, trim({empty('fix_commit')}) AS h FROM candidates
  UNION ALL SELECT ordinal, i, regexp_extract(u, {quoted(screening.COMMIT_URL)}, 3) FROM (SELECT ordinal, repo_url, generate_subscripts(cross_references, 1) AS i, unnest(cross_references).url AS u FROM candidates)
  WHERE regexp_matches(u, {quoted(screening.COMMIT_URL)}) AND {_OWNER('u', 1)} = {_OWNER('repo_url', 1)} AND {_OWNER('u', 2)} = {_OWNER('repo_url', 2)} AND {_OWNER('repo_url', 1)} <> ''),
f AS (SELECT ordinal, h, min(i) AS i FROM r WHERE h <> '' GROUP BY ordinal, h)
SELECT c.ordinal, coalesce(string_agg(h, ' ' ORDER BY length(h) DESC, i), '') AS commits FROM candidates c LEFT JOIN f USING (ordinal) GROUP BY c.ordinal
""")
def commit_hints(spark: SparkSession, d: str) -> DataFrame:
    """The commits that each candidate names in its own repository, longest first."""
    return _candidates(spark, d).select("ordinal", F.array_join(screening.commit_hashes(F.col("repo_url"), F.col("fix_commit"), F.col("cross_references")), " ").alias("commits"))


_RULED = f"SELECT ordinal, line, rule_id, severity, {_RANK_SQL} AS r FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id)"


@query("top_findings", f"SELECT ordinal, string_agg(rule_id || ':' || line, ' ' ORDER BY r DESC, line, rule_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY r DESC, line, rule_id) AS n FROM ({_RULED})) WHERE n <= 3 GROUP BY ordinal")
def top_findings(spark: SparkSession, d: str) -> DataFrame:
    """The three gravest findings of each record."""
    rows = scan.with_rule(_findings(spark, d)).select("ordinal", F.struct((-scan.severity_rank(F.col("severity"))).alias("r"), "line", "rule_id").alias("f"))
    top = rows.groupBy("ordinal").agg(F.slice(F.array_sort(F.collect_list("f")), 1, 3).alias("fs"))
    return top.select("ordinal", F.array_join(F.transform("fs", lambda f: F.concat_ws(":", f["rule_id"], f["line"])), " ").alias("top"))


@query("gravest_finding", f"SELECT ordinal, arg_max(rule_id, (r, -line, rule_id)) AS rule_id, max(r) AS rank, count(*) AS findings FROM ({_RULED}) GROUP BY ordinal")
def gravest_finding(spark: SparkSession, d: str) -> DataFrame:
    """The gravest finding of each record, of equals the first line and the last rule."""
    rows = scan.with_rule(_findings(spark, d)).select("ordinal", "line", "rule_id", (scan.severity_rank(F.col("severity")) + 1).alias("r"))
    return rows.groupBy("ordinal").agg(F.max_by("rule_id", F.struct("r", -F.col("line"), "rule_id")).alias("rule_id"), F.max("r").alias("rank"), F.count("*").alias("findings"))


@query("addresses", f"""
SELECT ordinal, CASE WHEN regexp_matches(trim({empty('repo_url')}), '^https?://') THEN trim(repo_url) WHEN regexp_full_match(trim({empty('repo_url')}), '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') THEN 'https://forge.example/' || trim(repo_url) ELSE '' END AS repo,
  CASE WHEN rtrim({empty('repo_url')}, '/') = '' OR {empty('fix_commit')} = '' THEN '' ELSE rtrim(repo_url, '/') || '/commit/' || fix_commit END AS fix,
  CASE WHEN {empty('package')} <> '' AND starts_with(replace({empty('file_path')}, chr(92), '/'), 'src/' || package || '/') THEN substr(replace(file_path, chr(92), '/'), length('src/' || package || '/') + 1) ELSE replace({empty('file_path')}, chr(92), '/') END AS path
FROM candidates
""")
def addresses(spark: SparkSession, d: str) -> DataFrame:
    """Repository and commit addresses and relative paths of candidates."""
    repo = screening.repository_url(F.col("repo_url"), "https://forge.example")
    path = screening.relative_path(F.col("file_path"), F.col("package"), "src")
    return _candidates(spark, d).select("ordinal", repo.alias("repo"), screening.commit_url(F.col("repo_url"), F.col("fix_commit")).alias("fix"), path.alias("path"))


@query("finding_texts", f"SELECT ordinal, '[' || {empty('rule')} || '] ' || {empty('finding')} AS message, 'Review ' || {empty('rule')} || ' in ' || {empty('file')} || ' of ' || {empty('source')} || '.' AS filled FROM new_triage")
def finding_texts(spark: SparkSession, d: str) -> DataFrame:
    """Finding messages, and a template with the fields of each record."""
    filled = screening.filled_template(F.lit("Review {rule} in {file} of {source}."), {n: F.col(n) for n in ("rule", "file", "source")})
    return table(spark, d, "new_triage").select("ordinal", screening.finding_text(F.col("rule"), F.col("finding")).alias("message"), filled.alias("filled"))


@query("finding_json", """
SELECT ordinal, '{' || array_to_string(list_filter(['"ordinal":' || ordinal, '"rule":' || to_json(rule)::VARCHAR, '"file":' || to_json(file)::VARCHAR, '"split":' || to_json(split)::VARCHAR], lambda x: x IS NOT NULL AND NOT ends_with(x, ':null')), ',') || '}' AS context FROM new_triage
""")
def finding_json(spark: SparkSession, d: str) -> DataFrame:
    """What is known about a finding, as JSON without nulls."""
    return table(spark, d, "new_triage").select("ordinal", screening.finding_context("ordinal", "rule", "file", "split").alias("context"))


@query("as_lists", f"SELECT ordinal, CAST(CASE WHEN trim({empty('cwe')}) = '' THEN 0 ELSE 1 END AS INTEGER) AS n, trim({empty('cwe')}) AS joined FROM candidates")
def as_lists(spark: SparkSession, d: str) -> DataFrame:
    """Single values as lists."""
    own = screening.as_list(F.col("cwe"))
    return _candidates(spark, d).select("ordinal", F.size(own).alias("n"), F.array_join(own, "|").alias("joined"))


@query("projected_candidates", f"""
SELECT ordinal, 'csv-' || substr(sha1({empty('repo_url')} || '|' || {empty('commit_sha')} || '|' || {empty('file')}), 1, 12) AS candidate_id, 'CSV' AS source, {empty('repo_url')} AS repo_url, {empty('commit_sha')} AS fix_commit, {empty('file')} AS file_path,
  {_OWN_CWE} AS cwe, 'predicted:' || {_OWN_CWE} AS reasons, 'B' AS preliminary_class, false AS verified, coalesce(nullif(license, ''), 'unknown') AS license, code AS code_vuln FROM new_detect WHERE coalesce(label.vulnerable, false) AND NOT {_BLANK('code')} AND {_OWN_CWE} <> ''
""")
def projected_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable records as unverified candidates of class B."""
    own = text.cwe(F.coalesce("label.cwe", F.lit("")))
    rows = table(spark, d, "new_detect").where(F.coalesce("label.vulnerable", F.lit(False)) & ~F.coalesce("code", F.lit("")).rlike(r"^\s*$")).withColumn("own", own).where(F.col("own") != "")
    present = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "ordinal",
        F.concat(F.lit("csv-"), text.local_id(F.col("repo_url"), F.col("commit_sha"), F.col("file"))).alias("candidate_id"),
        F.lit("CSV").alias("source"),
        present("repo_url").alias("repo_url"),
        present("commit_sha").alias("fix_commit"),
        present("file").alias("file_path"),
        F.col("own").alias("cwe"),
        F.concat(F.lit("predicted:"), "own").alias("reasons"),
        F.lit("B").alias("preliminary_class"),
        F.lit(False).alias("verified"),
        text.first_present(F.col("license"), F.lit("unknown")).alias("license"),
        F.col("code").alias("code_vuln"),
    )


@query("projected_records", f"""
SELECT n.ordinal, r.rule_id AS rule, '[' || r.rule_id || '] ' || r.title AS finding, r.cwe, r.severity, CASE WHEN {_KIND.replace("coalesce(file_path, '')", "coalesce(file, '')")} IN ('test', 'conftest') THEN 'Reject' ELSE 'Confirm' END AS verdict
FROM new_detect n JOIN (SELECT ordinal, min(rule_id) AS rule_id FROM ({_findings_sql()}) GROUP BY ordinal) g USING (ordinal) JOIN (SELECT * FROM {_RULES_SQL}) r USING (rule_id)
""")
def projected_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that break a rule as triage records; test files are to be rejected."""
    first = _findings(spark, d).groupBy("ordinal").agg(F.min("rule_id").alias("rule_id"))
    rows = scan.with_rule(first).join(table(spark, d, "new_detect").select("ordinal", "file"), "ordinal")
    verdict = F.when(text.path_kind(F.col("file")).isin("test", "conftest"), "Reject").otherwise("Confirm")
    return rows.select("ordinal", F.col("rule_id").alias("rule"), screening.finding_text(F.col("rule_id"), F.col("title")).alias("finding"), "cwe", "severity", verdict.alias("verdict"))


@query("rule_tiers", f"""
WITH h AS (SELECT DISTINCT ordinal FROM ({_findings_sql('candidates', 'code_vuln')})), r AS (SELECT c.ordinal, h.ordinal IS NOT NULL AS hit, {_KIND} IN ('test', 'conftest') AS test, {empty('cwe')} AS p, sha256({collapsed('code_vuln')}) AS own, sha256({collapsed('code_fixed')}) AS other, NOT {_BLANK('code_fixed')} AS fixed FROM candidates c LEFT JOIN h USING (ordinal))
SELECT ordinal, CASE WHEN hit THEN 'T1' ELSE 'T2' END AS tier FROM r WHERE hit OR NOT test AND p <> ''
UNION ALL SELECT ordinal, 'negative' FROM r WHERE NOT test AND p <> '' AND fixed AND NOT EXISTS (SELECT 1 FROM r q WHERE (q.hit OR NOT q.test AND q.p <> '') AND q.own = r.other)
""")
def rule_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the evidence of their code, and patched sides that may serve as negatives."""
    rows = _candidates(spark, d)
    hits = scan.line_findings(rows, "code_vuln", "ordinal").groupBy("ordinal").agg(F.collect_set("rule_id").alias("hits"))
    test = text.path_kind(F.col("file_path")).isin("test", "conftest")
    joined = rows.select("ordinal", "file_path", "cwe", "code_vuln", "code_fixed").join(hits, "ordinal", "left")
    return screening.tiers(joined, "ordinal", F.col("hits"), test, F.coalesce("cwe", F.lit("")), F.col("code_vuln"), F.col("code_fixed"))


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


@query("safe_functions", f"""
WITH p AS (SELECT ordinal, code, {collapsed('code')} AS k, regexp_split_to_array(code, '{LINE_END}') AS parts, lower({empty('file')}) AS f FROM new_detect WHERE code IS NOT NULL)
SELECT min(ordinal) AS ordinal FROM p WHERE len(CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END) BETWEEN 3 AND 60 AND NOT {_ANY('code', screening.WEAK_TOKENS)} AND {_ANY('code', screening.CRYPTO_TOKENS)}
  AND NOT contains(f, 'test') AND NOT contains(f, 'docs') AND k NOT IN (SELECT {collapsed('code')} FROM detect_eval WHERE code IS NOT NULL) GROUP BY k
""")
def safe_functions(spark: SparkSession, d: str) -> DataFrame:
    """Code that may serve as safe examples, the first of each text that isn't held out."""
    key = lambda c: F.sha2(text.collapsed(c), 256)
    held = table(spark, d, "detect_eval").where(F.col("code").isNotNull()).select(key(F.col("code")).alias("k")).distinct()
    rows = table(spark, d, "new_detect").where(screening.safe_function(F.col("code"), F.col("file"), ["test", "docs"])).select("ordinal", key(F.col("code")).alias("k"))
    return rows.join(held, "k", "left_anti").groupBy("k").agg(F.min("ordinal").alias("ordinal")).select("ordinal")


@query("remediation", f"SELECT ordinal, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, count(*) AS findings, count_if({_RANK_SQL} >= 4) AS high FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id) JOIN (SELECT ordinal, {_TRIAGE_SQL} AS verdict FROM new_detect) USING (ordinal) WHERE verdict = 'Confirm' GROUP BY ordinal")
def remediation(spark: SparkSession, d: str) -> DataFrame:
    """The rules to mend in each file by its confirmed findings."""
    confirmed = table(spark, d, "new_detect").where(scan.mock_triage(F.col("code")) == "Confirm").select("ordinal")
    rows = scan.with_rule(_findings(spark, d)).join(confirmed, "ordinal", "left_semi")
    high = F.count_if(scan.severity_rank(F.col("severity")) >= 3)
    return rows.groupBy("ordinal").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.count("*").alias("findings"), high.alias("high"))


@query("agent_verdicts", f"SELECT ordinal, line::INTEGER AS line, rule_id, coalesce(verdict, 'Confirm') AS verdict FROM ({_findings_sql()}) JOIN (SELECT ordinal, {_TRIAGE_SQL} AS verdict FROM new_detect) USING (ordinal)")
def agent_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with the verdict on its file."""
    rows = scan.line_findings(table(spark, d, "new_detect"), "code", "ordinal", "code")
    return rows.select("ordinal", "line", "rule_id", scan.mock_triage(F.col("code")).alias("verdict"))


@query("whole_file_findings", f"""
SELECT ordinal, 'MODEL' AS rule_id, split_part(p, '|', 1) AS cwe, split_part(p, '|', 2) AS severity, 1 AS line FROM ({_detect_sql('new_detect')}) WHERE p IS NOT NULL AND ordinal NOT IN (SELECT ordinal FROM ({_findings_sql()}))
""")
def whole_file_findings(spark: SparkSession, d: str) -> DataFrame:
    """A finding for each file that the model calls vulnerable and no rule does."""
    found = table(spark, d, "new_detect").select("ordinal", scan.mock_detect(F.col("code")).alias("p")).where("p.vulnerable")
    return found.join(_findings(spark, d).select("ordinal").distinct(), "ordinal", "left_anti").select("ordinal", F.lit("MODEL").alias("rule_id"), "p.cwe", "p.severity", F.lit(1).alias("line"))


_TOKENS = r"greatest(1, CAST(ceil((length(c) - length(regexp_replace(c, '[\x00-\x7F]', '', 'g'))) / 4.0 + length(regexp_replace(c, '[\x00-\x7F]', '', 'g')) / 1.5) AS INTEGER))"


@query("usage_rollup", f"""
SELECT source, count(*) AS messages, CAST(coalesce(sum(CASE WHEN r IN ('user', 'human') THEN t END), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN r IN ('assistant', 'gpt') THEN t END), 0) AS BIGINT) AS completion_tokens
FROM (SELECT source, r, {_TOKENS} AS t FROM (SELECT source, lower(trim(m.role)) AS r, m.content AS c FROM (SELECT source, unnest(messages) AS m FROM trainingdata)) WHERE c IS NOT NULL) GROUP BY source
""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of prompts and answers by source."""
    rows = table(spark, d, "trainingdata").select("source", F.explode("messages").alias("m")).where(F.col("m.content").isNotNull())
    rows = rows.select("source", F.lower(F.trim("m.role")).alias("r"), text.estimated_tokens(F.col("m.content")).cast("long").alias("t"))
    total = lambda *roles: F.coalesce(F.sum(F.when(F.col("r").isin(*roles), F.col("t"))), F.lit(0).cast("long"))
    return rows.groupBy("source").agg(F.count("*").alias("messages"), total("user", "human").alias("prompt_tokens"), total("assistant", "gpt").alias("completion_tokens"))


@query("tree_rule_findings")
def tree_rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the thirteen rules over the syntax trees of Python records."""
    return tree_rules.tree_findings(_python_records(spark, d), "ordinal", F.col("code"))


@query("tree_crypto_findings")
def tree_crypto_findings(spark: SparkSession, d: str) -> DataFrame:
    """The crypto findings of the syntax-tree scanner, with the CWE that their rule stands for."""
    found = source_ast.findings(_python_records(spark, d), "ordinal", F.col("code"))
    own = F.lit(None).cast("string")
    for prefix, number in screening.TREE_CWES.items():
        own = F.when(F.col("rule_id").startswith(prefix), number).otherwise(own)
    return found.withColumn("cwe", own).where(F.col("cwe").isNotNull())


@query("function_lookup")
def function_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The place of the function that each candidate names, in its own code."""
    rows = _candidates(spark, d).where(F.coalesce("function_name", F.lit("")) != "")
    found = source_ast.function_table(rows.select("ordinal", "code_vuln"), "ordinal", F.col("code_vuln"))
    return rows.select("ordinal", F.col("function_name").alias("name")).join(found, ["ordinal", "name"])


@query("candidate_diffs")
def candidate_diffs(spark: SparkSession, d: str) -> DataFrame:
    """The unified diff of the two sides of each candidate that has both."""
    rows = _candidates(spark, d).where(screening.has_code_pair())
    return rows.select("ordinal", source_ast.unified_diff(F.col("code_vuln"), F.col("code_fixed")).alias("diff"))


_FIRES = "CASE rule WHEN 'CRYPTO-008' THEN regexp_matches(regexp_extract(code, '^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*random\\.(\\w+)\\s*\\(', 2), '^(random|randint|randrange|choice|sample|uniform|gauss|triangular|getrandbits|shuffle)$') AND regexp_matches(regexp_extract(code, '^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*random\\.(\\w+)\\s*\\(', 1), '(?i)(key|iv|token|salt|nonce|secret|password)') " + " ".join(f"WHEN '{r}' THEN regexp_matches(code, {quoted(p)})" for r, p in fixtures.FIRES.items()) + " ELSE false END"
_MITIGATED = "CASE rule " + " ".join(f"WHEN '{r}' THEN regexp_matches(code, {quoted(p)})" for r, p in fixtures.MITIGATED.items()) + " ELSE false END"
_HARMLESS = "CASE " + " ".join(f"WHEN regexp_matches(code, {quoted(p)}) THEN '{n}'" for n, p in fixtures.HARMLESS) + " ELSE 'other' END"


@query("fixture_gates", f"SELECT ordinal, CASE WHEN coalesce({_FIRES}, false) THEN 'positive' WHEN coalesce({_MITIGATED}, false) THEN 'negative' ELSE 'none' END AS gate, CASE WHEN rule IN ('CRYPTO-001', 'CRYPTO-002', 'CRYPTO-003', 'CRYPTO-004', 'CRYPTO-005', 'CRYPTO-008', 'CRYPTO-009', 'CRYPTO-010') THEN {_HARMLESS} END AS reason FROM new_detect")
def fixture_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether each record may show its rule or its mitigation, and why a finding on it would be rejected."""
    rule, code = F.col("rule"), F.col("code")
    return table(spark, d, "new_detect").select("ordinal", fixtures.gate(rule, code).alias("gate"), fixtures.harmless_reason(rule, code).alias("reason"))


_PARTS = "CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END"


@query("wrapped_snippets", f"""
SELECT ordinal, 'def process_request():' || chr(10) || coalesce(array_to_string(list_transform(p, lambda x: CASE WHEN regexp_full_match(x, '\\s*') THEN x ELSE '    ' || x END), chr(10)), '') AS wrapped,
  coalesce(array_to_string(list_filter(p, lambda x: NOT regexp_matches(x, {quoted(fixtures.MARK)})), chr(10)), '') AS plain
FROM (SELECT ordinal, {_PARTS} AS p FROM (SELECT ordinal, regexp_split_to_array(code, '{LINE_END}') AS parts FROM new_triage WHERE code IS NOT NULL))
""")
def wrapped_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets as bodies of a function, and without annotations."""
    rows = table(spark, d, "new_triage").where(F.col("code").isNotNull())
    return rows.select("ordinal", fixtures.wrapped(F.col("code")).alias("wrapped"), fixtures.without_marks(F.col("code")).alias("plain"))


@query("audit_prompts", f"""
SELECT ordinal, sha256('Audit this candidate.' || chr(10) || chr(10) || 'Candidate metadata:' || chr(10) || '{{"candidate_id":' || to_json({empty('candidate_id')})::VARCHAR || ',"package":' || to_json({empty('package')})::VARCHAR || ',"cwe":' || to_json({empty('cwe')})::VARCHAR || '}}'
  || chr(10) || chr(10) || 'Vulnerable-side code:' || chr(10) || '```python' || chr(10) || CASE WHEN length({empty('code_vuln')}) > 300 THEN substr(code_vuln, 1, 300) || chr(10) || '[truncated]' ELSE {empty('code_vuln')} END || chr(10) || '```'
  || chr(10) || chr(10) || 'Fixed-side code:' || chr(10) || '```python' || chr(10) || CASE WHEN length({empty('code_fixed')}) > 300 THEN substr(code_fixed, 1, 300) || chr(10) || '[truncated]' ELSE {empty('code_fixed')} END || chr(10) || '```') AS digest FROM candidates
""")
def audit_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each candidate's audit request, its code cut at 300 characters."""
    prompt = screening.audit_prompt(["candidate_id", "package", "cwe"], F.col("code_vuln"), F.col("code_fixed"), 300)
    return _candidates(spark, d).select("ordinal", F.sha2(prompt, 256).alias("digest"))


@query("fixed_sample", "SELECT ordinal FROM new_detect ORDER BY sha256('audit:' || ordinal), ordinal LIMIT 100")
def fixed_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred records by their seeded digest."""
    return hashing.first_by_hash(table(spark, d, "new_detect").select("ordinal"), "ordinal", "audit", 100)


@query("evidence_status", """
WITH s AS (SELECT file, arg_min(code, ordinal) AS text FROM new_detect WHERE file <> '' AND code IS NOT NULL GROUP BY file)
SELECT ordinal, CASE WHEN coalesce(t.file, '') = '' THEN 'no_path' WHEN s.text IS NULL THEN 'no_source' WHEN regexp_full_match(coalesce(t.code, ''), '\\s*') THEN 'no_snippet' WHEN contains(s.text, t.code) THEN 'present' ELSE 'absent' END AS status, sha256(s.text) AS source_sha256
FROM new_triage t LEFT JOIN s ON s.file = t.file
""")
def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether the source that a triage record names holds its code."""
    sources = table(spark, d, "new_detect").where((F.col("file") != "") & F.col("code").isNotNull()).groupBy("file").agg(F.min_by("code", "ordinal").alias("text"))
    found = screening.evidence_status(table(spark, d, "new_triage").select("ordinal", "file", "code"), sources, "file", "code", "text")
    return found.select("ordinal", "status", "source_sha256")


@query("function_cases", f"""
SELECT ordinal, name, CAST(start_line AS INTEGER) AS start_line, count(*) AS findings, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM (
  SELECT f.ordinal, f.line, f.rule_id, arg_min(g.name, g.start_line) AS name, min(g.start_line) AS start_line FROM ({_findings_sql()}) f JOIN ({_RANGES_SQL}) g ON f.ordinal = g.ordinal AND f.line BETWEEN g.start_line AND g.end_line GROUP BY f.ordinal, f.line, f.rule_id)
GROUP BY ordinal, name, start_line
""")
def function_cases(spark: SparkSession, d: str) -> DataFrame:
    """Each outermost function with findings once, with the rules that it breaks."""
    ranges = scan.function_ranges(table(spark, d, "new_detect"), "code", "ordinal")
    found = relational.enclosing(_findings(spark, d).select("ordinal", "line", "rule_id"), ranges, "ordinal", "line", "start_line", "end_line")
    return found.groupBy("ordinal", "name", "start_line").agg(F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


_SIDES = {"eval": "detect_eval", "val": "(SELECT * FROM new_detect WHERE lower(trim(split)) = 'val')", "test": "(SELECT * FROM new_detect WHERE lower(trim(split)) = 'test')"}, {"train": "(SELECT * FROM new_detect WHERE lower(trim(split)) = 'train')", "triage": "new_triage"}
_DIMENSIONS = {"exact": "sha256(code)", "normalized": f"sha256({collapsed('code')})", "nospace": f"sha256({no_space('code')})"}


def _leak_checks_sql() -> str:
    cells = []
    for dimension, key in _DIMENSIONS.items():
        for e, left in _SIDES[0].items():
            for t, right in _SIDES[1].items():
                sides = [f"(SELECT {key} AS k, count(*) AS n FROM {side} WHERE code IS NOT NULL GROUP BY 1)" for side in (left, right)]
                cells.append(f"SELECT '{e}' AS evaluation, '{t}' AS training, '{dimension}' AS dimension, count(*) AS shared_keys, coalesce(sum(a.n), 0)::BIGINT AS left_rows, coalesce(sum(b.n), 0)::BIGINT AS right_rows FROM {sides[0]} a JOIN {sides[1]} b USING (k)")
    return " UNION ALL ".join(cells)


@query("leak_checks", _leak_checks_sql())
def leak_checks(spark: SparkSession, d: str) -> DataFrame:
    """What each evaluation set shares with each training set, by three forms of the code."""
    keyed = lambda df: df.where(F.col("code").isNotNull()).select(F.sha2("code", 256).alias("exact"), F.sha2(text.collapsed(F.col("code")), 256).alias("normalized"), F.sha2(text.no_space(F.col("code")), 256).alias("nospace"))
    part = lambda name: keyed(table(spark, d, "new_detect").where(F.lower(F.trim("split")) == name))
    evaluation = {"eval": keyed(table(spark, d, "detect_eval")), "val": part("val"), "test": part("test")}
    return dataset.leak_matrix(evaluation, {"train": part("train"), "triage": keyed(table(spark, d, "new_triage"))}, {k: k for k in _DIMENSIONS})


@query("leak_checks_by_tree")
def leak_checks_by_tree(spark: SparkSession, d: str) -> DataFrame:
    """The same by the syntax trees of Python code; what doesn't parse shares nothing."""
    keyed = lambda df: df.where(text.language_name(F.col("lang")).eqNullSafe("python")).select(source_ast.tree_key(F.col("code")).alias("tree"))
    part = lambda name: keyed(table(spark, d, "new_detect").where(F.lower(F.trim("split")) == name))
    evaluation = {"eval": keyed(table(spark, d, "detect_eval")), "val": part("val"), "test": part("test")}
    return dataset.leak_matrix(evaluation, {"train": part("train"), "triage": keyed(table(spark, d, "new_triage"))}, {"tree": "tree"})


@query("rule_kinds", "SELECT rule, count_if(label.vulnerable) AS positive, count_if(NOT label.vulnerable) AS negative, count_if(label.vulnerable IS NULL) AS unlabelled FROM new_detect GROUP BY rule")
def rule_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Records of each rule by the kind of their label."""
    v = F.col("label.vulnerable")
    return table(spark, d, "new_detect").groupBy("rule").agg(F.count_if(v).alias("positive"), F.count_if(~v).alias("negative"), F.count_if(v.isNull()).alias("unlabelled"))


@query("top_entries", f"SELECT severity, count(*) AS n FROM (SELECT upper(trim({empty('label.severity')})) AS severity FROM new_triage) GROUP BY severity ORDER BY n DESC, severity LIMIT 6")
def top_entries(spark: SparkSession, d: str) -> DataFrame:
    """The six most frequent severities as they are given."""
    rows = table(spark, d, "new_triage").select(F.upper(F.trim(F.coalesce("label.severity", F.lit("")))).alias("severity"))
    return rows.groupBy("severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "severity").limit(6)


@query("triage_mismatches", f"SELECT ordinal, label.verdict AS truth, {_TRIAGE_SQL} AS predicted FROM new_triage WHERE label.verdict IS DISTINCT FROM {_TRIAGE_SQL}")
def triage_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Triage records on which the mock model differs from the label."""
    rows = table(spark, d, "new_triage").select("ordinal", F.col("label.verdict").alias("truth"), scan.mock_triage(F.col("code")).alias("predicted"))
    return metrics.mismatches(rows, F.col("truth"), F.col("predicted"))


@query("engine_counts", f"SELECT engine, rule_id, count(*) AS n FROM ({_BOTH_SQL}) GROUP BY engine, rule_id")
def engine_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by engine and rule, before they are merged."""
    return _two_engines(spark, d).groupBy("engine", "rule_id").agg(F.count("*").alias("n"))


@query("collected_cwes", f"""
SELECT ordinal, array_to_string(list_concat(list_filter(CASE upper(trim({empty('rule_id')})) {" ".join(f"WHEN '{r}' THEN {sorted(c, reverse=True)}" for r, c in dataset.RULE_CWE.items())} ELSE []::VARCHAR[] END, lambda c: NOT list_contains(own, c)), own), ',') AS cwes
FROM (SELECT ordinal, rule_id, list_filter(list_transform([{empty('cwe')}], lambda x: {_NORMAL}), lambda x: x <> '') AS own FROM candidates)
""")
def collected_cwes(spark: SparkSession, d: str) -> DataFrame:
    """The CWEs of each candidate, those of its rule first."""
    return _candidates(spark, d).select("ordinal", F.array_join(candidates.collected_cwes([F.col("cwe")], F.col("rule_id")), ",").alias("cwes"))


_SLUG = f"substr(regexp_replace(regexp_replace(lower({empty('repo_url')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48)"


@query("content_ids", f"SELECT ordinal, concat_ws('-', {_SLUG}, substr(sha1({no_space('code')}), 1, 8), rule) AS content_id FROM new_detect WHERE code IS NOT NULL")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of records by repository, code and rule."""
    rows = table(spark, d, "new_detect").where(F.col("code").isNotNull())
    return rows.select("ordinal", text.content_id(F.coalesce("repo_url", F.lit("")), F.col("code"), F.col("rule")).alias("content_id"))


@query("key_overlap", "SELECT k, a.n AS left_rows, b.n AS right_rows FROM (SELECT sha256(code) AS k, count(*) AS n FROM new_detect WHERE code IS NOT NULL GROUP BY 1) a JOIN (SELECT sha256(code) AS k, count(*) AS n FROM new_triage WHERE code IS NOT NULL GROUP BY 1) b USING (k)")
def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The codes that two tables share, with their rows on either side."""
    sides = [table(spark, d, name).select(F.sha2("code", 256).alias("k")) for name in ("new_detect", "new_triage")]
    return relational.key_overlap(*sides, "k")


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, counted by a stream in windows."""
    # times without zone are taken as UTC, whatever the zone of the session
    stream = feedback.event_stream(spark, d).withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")))
    counts = feedback.windowed_counts(stream, "ts", "1 day", "3650 days", "event_type")
    rows = feedback.run_to_table(counts, "complete", "windows")
    return rows.select(F.expr("timestampadd(MICROSECOND, unix_micros(start), TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("start"), "event_type", "n")


@query("safe_names", "SELECT ordinal, CASE WHEN n = '' THEN 'snippet.txt' ELSE n END AS name FROM (SELECT ordinal, coalesce(regexp_replace(regexp_replace(regexp_extract(file_path, '([^/\\\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', ''), '') AS n FROM candidates)")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """File names that are safe to store under."""
    return _candidates(spark, d).select("ordinal", text.safe_name(F.col("file_path")).alias("name"))


@query("file_manifest", "SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text))::INTEGER AS bytes, sha256(text) AS sha256, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INTEGER AS line_count FROM documents WHERE text IS NOT NULL")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Bytes, digest and filled lines of every document."""
    files = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return dataset.file_manifest(files)


@query("patch_sides", f"""
SELECT ordinal, {", ".join(f"coalesce(array_to_string(list_transform(list_filter(p, lambda x: NOT regexp_matches(x, '^(@@|diff |index |--- |[+]{{3}} |[\\\\])') AND (starts_with(x, ' ') OR starts_with(x, '{side}') OR x = '')), lambda x: substr(x, 2)), chr(10)), '') AS {name}" for side, name in (("-", "before"), ("+", "after")))}
FROM (SELECT ordinal, {_PARTS} AS p FROM (SELECT ordinal, regexp_split_to_array(code_vuln, '{LINE_END}') AS parts FROM candidates WHERE code_vuln IS NOT NULL))
""")
def patch_sides(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of what a code field says as a diff."""
    rows = _candidates(spark, d).where(F.col("code_vuln").isNotNull())
    return rows.select("ordinal", *(text.patch_side(F.col("code_vuln"), side).alias(name) for side, name in (("-", "before"), ("+", "after"))))


@query("dedented_snippets")
def dedented_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets without annotations and common indentation."""
    rows = table(spark, d, "new_triage").where(F.col("code").isNotNull())
    return rows.select("ordinal", source_ast.dedented(fixtures.without_marks(F.col("code"))).alias("code"))
