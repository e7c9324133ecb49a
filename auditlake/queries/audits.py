"""Queries that scan source text: line rules, findings, verdicts, metrics, fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.catalog import query
from auditlake.functions import text
from auditlake.operators import metrics, relational, scan, source_ast
from auditlake.plans.skew import spread
from auditlake.queries.sql import LINE_END, empty, lines, quoted
from auditlake.sources.tables import table

_STRIP = r"regexp_replace(raw, '^[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')"


def _lines(spark: SparkSession, d: str, name: str = "new_detect") -> DataFrame:
    return scan.source_lines(table(spark, d, name), "code", "ordinal")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return scan.line_findings(table(spark, d, "new_detect"), "code", "ordinal")


def _findings_sql(table_name: str = "new_detect", column: str = "code") -> str:
    hits = [f"CASE WHEN regexp_matches(raw, {quoted('(?i)' + p)}) THEN '{r}' END" for r, p in scan.LINE_PATTERNS.items()]
    hits += [f"CASE WHEN TRY_CAST(regexp_extract(raw, {quoted('(?i)' + p)}, 1) AS BIGINT) < {least} THEN '{r}' END" for r, p, least in scan.NUMBER_PATTERNS]
    return f"""
SELECT DISTINCT ordinal, line, raw, rule_id FROM (
  SELECT ordinal, line, raw, unnest([{", ".join(hits)}]) AS rule_id FROM ({lines(table_name, column, 'ordinal')})
  WHERE {_STRIP} <> '' AND NOT regexp_matches({_STRIP}, '{scan.COMMENT}')
) WHERE rule_id IS NOT NULL
"""


_RULES_SQL = "(VALUES " + ", ".join(f"({quoted(r)}, {quoted(t)}, {quoted(c)}, {quoted(s)})" for r, (t, c, s) in scan.RULES.items()) + ") AS rules(rule_id, title, cwe, severity)"


@query("rule_hits_per_record", f"SELECT ordinal, count(*) AS findings, count(DISTINCT rule_id) AS rules, min(line) AS first_line FROM ({_findings_sql()}) GROUP BY ordinal")
def rule_hits_per_record(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the thirteen line rules by record; the flagship query."""
    return _findings(spark, d).groupBy("ordinal").agg(F.count("*").alias("findings"), F.count_distinct("rule_id").alias("rules"), F.min("line").alias("first_line"))


@query("rule_findings", f"SELECT ordinal, CAST(line AS INTEGER) AS line, rule_id, {_STRIP} AS snippet, title, cwe, severity FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id)")
def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    return scan.with_rule(_findings(spark, d)).select("ordinal", "line", "rule_id", "snippet", "title", "cwe", "severity")


@query("rule_counts", f"SELECT rule_id, count(*) AS hits, count(DISTINCT ordinal) AS records FROM ({_findings_sql()}) GROUP BY rule_id")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("rule_id").agg(F.count("*").alias("hits"), F.count_distinct("ordinal").alias("records"))


_BOTH_SQL = f"""
SELECT ordinal, line, rule_id, severity, 1 AS engine FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id)
UNION ALL SELECT ordinal, line, 'CRYPTO-010', 'CRITICAL', 0 FROM ({lines('new_detect', 'code', 'ordinal')}) WHERE contains(raw, 'verify=False')
"""


def _two_engines(spark: SparkSession, d: str) -> DataFrame:
    return scan.engine_findings(table(spark, d, "new_detect"), "code", {"verify=False": ("CRYPTO-010", "CRITICAL")}, "ordinal")


_RANK_SQL = "list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)"


@query("findings_dedupe", f"SELECT ordinal, CAST(line AS INTEGER) AS line, rule_id, severity, engine FROM ({_BOTH_SQL}) QUALIFY row_number() OVER (PARTITION BY ordinal, line, rule_id ORDER BY {_RANK_SQL} DESC, engine) = 1")
def findings_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Findings of two engines, the most severe of each rule and line."""
    return scan.keep_most_severe(_two_engines(spark, d), ["ordinal", "line", "rule_id"], "engine").select("ordinal", "line", "rule_id", "severity", "engine")


@query("findings_order", f"SELECT ordinal, CAST(line AS INTEGER) AS line, rule_id, severity FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id) ORDER BY {_RANK_SQL} DESC, ordinal DESC, line DESC, rule_id DESC LIMIT 100")
def findings_order(spark: SparkSession, d: str) -> DataFrame:
    """The hundred first findings by severity, record and line, all descending."""
    rows = scan.with_rule(_findings(spark, d)).select("ordinal", "line", "rule_id", "severity")
    return rows.orderBy(scan.severity_rank(F.col("severity")).desc(), F.desc("ordinal"), F.desc("line"), F.desc("rule_id")).limit(100)


@query(
    "finding_context",
    f"""
WITH f AS ({_findings_sql()}), p AS (SELECT ordinal, regexp_split_to_array(code, '{LINE_END}') AS parts FROM new_detect WHERE code IS NOT NULL),
q AS (SELECT ordinal, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM p)
SELECT f.ordinal, CAST(line AS INTEGER) AS line, rule_id, array_to_string(parts[greatest(1, line - 3):least(len(parts), line + 4)], chr(10)) AS context, rule_id || ':' || f.ordinal || ':' || line AS fingerprint FROM f JOIN q USING (ordinal)
""",
)
def finding_context(spark: SparkSession, d: str) -> DataFrame:
    """Each finding with the lines from three before to four after."""
    rows = table(spark, d, "new_detect").select("ordinal", "code")
    hits = scan.line_findings(rows, "code", "ordinal", "code")
    return hits.select("ordinal", "line", "rule_id", scan.context(F.col("code"), F.col("line"), 3, 4).alias("context"), F.concat_ws(":", "rule_id", "ordinal", "line").alias("fingerprint"))


@query("severity_summary", f"SELECT s.severity, count(f.rule_id) AS n FROM (VALUES ('INFO'), ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) AS s(severity) LEFT JOIN (SELECT rule_id, severity FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id)) f USING (severity) GROUP BY s.severity")
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return scan.severity_summary(scan.with_rule(_findings(spark, d)))


@query("threshold_gate", f"SELECT count_if({_RANK_SQL} >= 4) > 0 AS exceeded, count(*) AS findings FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id)")
def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    return scan.exceeds(scan.with_rule(_findings(spark, d)), "HIGH")


_RISK_SQL = f"""
WITH f AS (SELECT ordinal, severity FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id)),
s AS (SELECT ordinal, CAST(least(100.0, round_even(sum(CASE severity WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 12 ELSE 8 END * 0.5), 0)) AS INTEGER) AS score FROM f GROUP BY ordinal)
SELECT ordinal, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'INFO' END AS level FROM s
"""


@query("risk_score", _RISK_SQL)
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    """The risk of each record from its findings, all confirmed with confidence one half."""
    return scan.risk_score(scan.with_rule(_findings(spark, d)), "ordinal", F.lit("CONFIRMED"), F.lit(0.5))


@query("insights", f"SELECT grouping(cwe) AS g_cwe, grouping(rule_id) AS g_rule, cwe, rule_id, count(*) AS n FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id) GROUP BY GROUPING SETS ((cwe), (rule_id))")
def insights(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.with_rule(_findings(spark, d)).select("cwe", "rule_id").toDF("cwe", "rule_id")
    return rows.groupingSets([[F.col("cwe")], [F.col("rule_id")]], F.col("cwe"), F.col("rule_id")).agg(F.grouping("cwe").cast("long").alias("g_cwe"), F.grouping("rule_id").cast("long").alias("g_rule"), F.count("*").alias("n")).select("g_cwe", "g_rule", "cwe", "rule_id", "n")


def _detect_sql(table_name: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(code, {quoted('(?i)' + p)}) THEN '{c}|{s}'" for p, c, s in scan.DETECT_SIGNALS)
    return f"SELECT ordinal, label.vulnerable AS truth, label.cwe AS true_cwe, CASE {cases} END AS p FROM {table_name}"


@query("mock_detect", f"SELECT ordinal, p IS NOT NULL AS vulnerable, coalesce(split_part(p, '|', 1), '') AS cwe, coalesce(split_part(p, '|', 2), '') AS severity FROM ({_detect_sql('new_detect')})")
def mock_detect(spark: SparkSession, d: str) -> DataFrame:
    """The first signal of each record."""
    return table(spark, d, "new_detect").select("ordinal", scan.mock_detect(F.col("code")).alias("p")).select("ordinal", "p.*")


_TRIAGE_SQL = f"CASE WHEN regexp_matches(code, {quoted(scan.TEST_DEF)}) OR contains(lower(substr(code, 1, 300)), '/test') THEN 'Reject' ELSE 'Confirm' END"


@query("mock_triage", f"SELECT ordinal, {_TRIAGE_SQL} AS verdict FROM new_triage")
def mock_triage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "new_triage").select("ordinal", scan.mock_triage(F.col("code")).alias("verdict"))


def _metrics_sql(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {lead}n, tp, fp, fn, tn, cwe_total, cwe_hits, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy, cwe_hits / nullif(cwe_total, 0) AS cwe_accuracy
FROM (SELECT {lead}count(*) AS n, count_if(t AND v) AS tp, count_if(NOT t AND v) AS fp, count_if(t AND NOT v) AS fn, count_if(NOT t AND NOT v) AS tn, count_if(t AND v AND tc <> '') AS cwe_total, count_if(t AND v AND tc <> '' AND starts_with(pc, tc)) AS cwe_hits FROM ({source}){group})
"""


_LLM_SQL = f"SELECT 'llm' AS system, coalesce(truth, false) AS t, p IS NOT NULL AS v, coalesce(true_cwe, '') AS tc, coalesce(split_part(p, '|', 1), '') AS pc FROM ({_detect_sql('new_detect')})"
_STATIC_SQL = f"""
SELECT 'static' AS system, coalesce(n.label.vulnerable, false) AS t, f.ordinal IS NOT NULL AS v, {empty('n.label.cwe')} AS tc, {empty('f.cwe')} AS pc FROM new_detect n
LEFT JOIN (SELECT ordinal, min(rule_id) AS r FROM ({_findings_sql()}) GROUP BY ordinal) g USING (ordinal) LEFT JOIN (SELECT rule_id, cwe, 1 AS ordinal FROM {_RULES_SQL}) f ON f.rule_id = g.r
"""


def _systems(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts of the model's signals and of the line rules on every record, from one scan."""
    new = spread(table(spark, d, "new_detect").select("ordinal", F.col("label.vulnerable").alias("t"), F.col("label.cwe").alias("tc"), "code"), "ordinal")
    # ordinal tells records apart, so the other columns only ride along
    rows = new.select("ordinal", "t", "tc", "code", scan.mock_detect(F.col("code")).alias("p"))
    first = scan.first_rule(rows.select("ordinal", "t", "tc", F.col("p.vulnerable").alias("pv"), F.col("p.cwe").alias("pc"), "code"), "code", "ordinal", "t", "tc", "pv", "pc")
    cwes = F.create_map(*(F.lit(x) for rule, (_, cwe, _) in scan.RULES.items() for x in (rule, cwe)))
    both = F.array(
        F.struct(F.lit("llm").alias("system"), F.col("pv").alias("v"), "pc"),
        F.struct(F.lit("static").alias("system"), F.col("rule_id").isNotNull().alias("v"), cwes[F.col("rule_id")].alias("pc")),
    )
    return first.select("t", "tc", F.explode(both).alias("s")).select("t", "tc", "s.*")


@query("metrics_by_system", _metrics_sql(f"{_LLM_SQL} UNION ALL {_STATIC_SQL}", "system"))
def metrics_by_system(spark: SparkSession, d: str) -> DataFrame:
    """Detection metrics of the line rules and of the mock model."""
    rows = _systems(spark, d)
    return metrics.detect_metrics(rows, F.col("t"), F.col("v"), F.col("tc"), F.col("pc"), "system")


@query("detect_metrics", _metrics_sql(_LLM_SQL))
def detect_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "new_detect").select("label", scan.mock_detect(F.col("code")).alias("p"))
    return metrics.detect_metrics(rows, F.col("label.vulnerable"), F.col("p.vulnerable"), F.col("label.cwe"), F.col("p.cwe"))


@query(
    "triage_metrics",
    f"""
SELECT *, coalesce(kept_true / nullif(gt_confirm, 0), 0) AS confirm_recall, coalesce(kept_false / nullif(gt_reject, 0), 0) AS fpr, (kept_true + dropped_false) / n AS accuracy FROM (
  SELECT count(*) AS n, count_if(t) AS gt_confirm, count_if(NOT t) AS gt_reject, count_if(t AND p) AS kept_true, count_if(NOT t AND p) AS kept_false, count_if(NOT t AND NOT p) AS dropped_false
  FROM (SELECT coalesce(label.verdict = 'Confirm', false) AS t, {_TRIAGE_SQL} = 'Confirm' AS p FROM new_triage))
""",
)
def triage_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "new_triage").select("label", scan.mock_triage(F.col("code")).alias("p"))
    return metrics.triage_metrics(rows, F.col("label.verdict"), F.col("p"))


@query(
    "probe_summary",
    f"""
SELECT n, "right", hits, false_hits, "right" / nullif(n, 0) AS accuracy, hits / nullif(confirms, 0) AS recall, false_hits / nullif(rejects, 0) AS fpr FROM (
  SELECT count(*) AS n, count_if(t = p) AS "right", count_if(t = 'Confirm' AND p = 'Confirm') AS hits, count_if(t = 'Reject' AND p = 'Confirm') AS false_hits, count_if(t = 'Confirm') AS confirms, count_if(t = 'Reject') AS rejects
  FROM (SELECT label.verdict AS t, {_TRIAGE_SQL} AS p FROM new_triage WHERE label.verdict IS NOT NULL))
""",
)
def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "new_triage").where(F.col("label.verdict").isNotNull()).select("label", scan.mock_triage(F.col("code")).alias("p"))
    return metrics.probe_summary(rows, F.col("label.verdict"), F.col("p"))


@query(
    "metric_delta",
    f"""
WITH a AS (SELECT lang, count_if(truth AND p IS NOT NULL) AS tp, count_if(NOT truth AND p IS NOT NULL) AS fp FROM (SELECT n.lang, x.* FROM new_detect n JOIN ({_detect_sql('new_detect')}) x USING (ordinal)) GROUP BY lang),
b AS (SELECT n.lang, count_if(n.label.vulnerable AND g.ordinal IS NOT NULL) AS tp, count_if(NOT n.label.vulnerable AND g.ordinal IS NOT NULL) AS fp FROM new_detect n LEFT JOIN (SELECT DISTINCT ordinal FROM ({_findings_sql()})) g USING (ordinal) GROUP BY n.lang)
SELECT lang, a.tp AS tp_before, b.tp AS tp_after, b.tp - a.tp AS tp_delta, a.fp AS fp_before, b.fp AS fp_after, b.fp - a.fp AS fp_delta FROM a JOIN b USING (lang)
""",
)
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    """The change of true and false positives, by language, from the mock model to the line rules."""
    new = table(spark, d, "new_detect")
    counts = lambda df: df.groupBy("lang").agg(F.count_if(F.col("vulnerable") & F.col("v")).alias("tp"), F.count_if(~F.col("vulnerable") & F.col("v")).alias("fp"))
    before = counts(new.select("lang", "label.vulnerable", scan.mock_detect(F.col("code"))["vulnerable"].alias("v")))
    hit = _findings(spark, d).select("ordinal").distinct().withColumn("v", F.lit(True))
    after = counts(new.select("ordinal", "lang", "label.vulnerable").join(hit, "ordinal", "left").withColumn("v", F.coalesce("v", F.lit(False))))
    return metrics.metric_delta(before, after, "lang", "tp", "fp")


def _fixed_sql(raw: str) -> str:
    for _, pattern, replacement in scan.FIXES:
        sql = replacement.replace("${1}", "\\1")
        for i in "123":
            sql = sql.replace(f"${i}", f"\\{i}")
        raw = f"regexp_replace({raw}, {quoted(pattern)}, {quoted(sql)}, 'g')"
    return raw


@query("mechanical_fix", f"SELECT ordinal, CAST(line AS INTEGER) AS line, rtrim(raw) AS before, rtrim(fixed) AS after FROM (SELECT *, {_fixed_sql('raw')} AS fixed FROM ({lines('new_detect', 'code', 'ordinal')})) WHERE fixed <> raw")
def mechanical_fix(spark: SparkSession, d: str) -> DataFrame:
    """The lines that the mechanical fixes change."""
    return scan.fix_changes(table(spark, d, "new_detect"), "code", "ordinal")


_DEF = r"^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)"
_RANGES_SQL = f"""
WITH r AS (SELECT ordinal, line, length(regexp_extract(raw, '^([ \\t]*)', 1)) AS indent, regexp_extract(raw, '{_DEF}', 1) AS name FROM ({lines('new_detect', 'code', 'ordinal')}) WHERE NOT regexp_matches(raw, '^\\s*$')),
l AS (SELECT ordinal, max(line) AS last_line FROM r GROUP BY ordinal), h AS (SELECT ordinal, name, line AS start_line, indent FROM r WHERE name <> ''),
e AS (SELECT h.ordinal, h.name, h.start_line, min(r.line) - 1 AS end_line FROM h JOIN r ON r.ordinal = h.ordinal AND r.line > h.start_line AND r.indent <= h.indent GROUP BY ALL)
SELECT h.ordinal, h.name, CAST(h.start_line AS INTEGER) AS start_line, CAST(coalesce(e.end_line, l.last_line) AS INTEGER) AS end_line FROM h JOIN l USING (ordinal) LEFT JOIN e USING (ordinal, name, start_line)
"""


@query("function_ranges", _RANGES_SQL)
def function_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The functions of every record by indentation."""
    return scan.function_ranges(table(spark, d, "new_detect"), "code", "ordinal")


@query(
    "range_enclosing",
    f"""
WITH f AS ({_findings_sql()}), g AS ({_RANGES_SQL})
SELECT f.ordinal, CAST(f.line AS INTEGER) AS line, f.rule_id, arg_min(g.name, g.start_line) AS name, CAST(min(g.start_line) AS INTEGER) AS start_line
FROM f JOIN g ON f.ordinal = g.ordinal AND f.line BETWEEN g.start_line AND g.end_line GROUP BY f.ordinal, f.line, f.rule_id
""",
)
def range_enclosing(spark: SparkSession, d: str) -> DataFrame:
    """Each finding with the outermost function around it."""
    points = _findings(spark, d).select("ordinal", "line", "rule_id")
    ranges = scan.function_ranges(table(spark, d, "new_detect"), "code", "ordinal")
    return relational.enclosing(points, ranges, "ordinal", "line", "start_line", "end_line").select("ordinal", "line", "rule_id", "name", "start_line")


@query(
    "forward_asof",
    f"""
WITH l AS ({lines('new_triage', 'code', 'ordinal')}),
n AS (SELECT ordinal, line, raw, min(CASE WHEN NOT regexp_matches(raw, '^\\s*(#|//|$)') THEN line END) OVER (PARTITION BY ordinal ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target FROM l)
SELECT ordinal, CAST(line AS INTEGER) AS line, CAST(target AS INTEGER) AS target FROM n WHERE regexp_matches(raw, '^\\s*(#|//)')
""",
)
def forward_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each comment line with the next line of code."""
    rows = _lines(spark, d, "new_triage").withColumn("target", relational.forward_as_of("ordinal", "line", ~F.col("raw").rlike(r"^\s*(#|//|$)")))
    return rows.where(F.col("raw").rlike(r"^\s*(#|//)")).select("ordinal", "line", "target")


@query("running_depth", f"SELECT ordinal, CAST(line AS INTEGER) AS line, CAST(sum(length(regexp_replace(raw, '[^{{]', '', 'g')) - length(regexp_replace(raw, '[^}}]', '', 'g'))) OVER (PARTITION BY ordinal ORDER BY line) AS BIGINT) AS depth FROM ({lines('new_triage', 'code', 'ordinal')})")
def running_depth(spark: SparkSession, d: str) -> DataFrame:
    """The depth of braces after each line."""
    return scan.brace_depth(table(spark, d, "new_triage"), "code", "ordinal")


@query(
    "carry_forward",
    f"""
SELECT ordinal, CAST(line AS INTEGER) AS line, last_value(nullif(regexp_extract(raw, '{_DEF}', 1), '') IGNORE NULLS) OVER (PARTITION BY ordinal ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name FROM ({lines('new_triage', 'code', 'ordinal')})
""",
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each line with the last function header above it."""
    rows = _lines(spark, d, "new_triage").withColumn("head", F.nullif(F.regexp_extract("raw", _DEF, 1), F.lit("")))
    return rows.select("ordinal", "line", relational.carry_forward("head", "ordinal", "line").alias("name"))


@query("running_id", "SELECT ordinal, printf('fx-%s-%02d', coalesce(rule, 'none'), row_number() OVER (PARTITION BY rule ORDER BY ordinal)) AS new_id FROM new_triage")
def running_id(spark: SparkSession, d: str) -> DataFrame:
    return relational.running_ids(table(spark, d, "new_triage").select("ordinal", "rule"), "rule", "ordinal", "fx").select("ordinal", "new_id")


def _python_records(spark: SparkSession, d: str) -> DataFrame:
    """Records in Python by any spelling."""
    rows = table(spark, d, "new_detect").where(text.language_name(F.col("lang")).eqNullSafe("python") & F.col("code").isNotNull())
    return spread(rows.select("ordinal", "code"), "ordinal")


@query("python_ast_findings")
def python_ast_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the syntax-tree scanner in Python records."""
    rows = _python_records(spark, d)
    return source_ast.findings(rows.select("ordinal", "code"), "ordinal", F.col("code"))


@query("ast_functions")
def ast_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions of Python records by their syntax trees."""
    rows = _python_records(spark, d)
    return source_ast.function_table(rows.select("ordinal", "code"), "ordinal", F.col("code"))


@query("c_findings")
def c_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the C scanner over every record."""
    rows = table(spark, d, "new_detect").where(F.col("code").isNotNull()).select("ordinal", "code")
    return source_ast.findings(spread(rows, "ordinal"), "ordinal", F.col("code"), source_ast.scan_c)


@query("unsafe_c_calls", f"""
SELECT ordinal, CAST(line AS INTEGER) AS line, 'c-unsafe-api-' || call AS rule_id, CASE WHEN call = 'gets' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM (
  SELECT ordinal, line, unnest(regexp_extract_all(code, {quoted(scan.UNSAFE_C)}, 1)) AS call FROM (SELECT ordinal, line, regexp_replace(raw, '//.*', '', 'g') AS code FROM ({lines('new_detect', 'code', 'ordinal')})) WHERE NOT regexp_matches(code, '^\\s*$|^\\s*\\*'))
""")
def unsafe_c_calls(spark: SparkSession, d: str) -> DataFrame:
    return scan.unsafe_c_calls(table(spark, d, "new_detect"), "code", "ordinal")


@query("capability_matrix", f"""
SELECT rule, count_if(vulnerable) AS positives, count_if(vulnerable AND hit) AS detected, count_if(NOT vulnerable) AS negatives, count_if(NOT vulnerable AND NOT hit) AS clean
FROM (SELECT n.rule, n.label.vulnerable AS vulnerable, g.rule_id IS NOT NULL AS hit FROM new_detect n LEFT JOIN (SELECT DISTINCT ordinal, rule_id FROM ({_findings_sql()})) g ON g.ordinal = n.ordinal AND g.rule_id = n.rule WHERE n.rule IS NOT NULL) GROUP BY rule
""")
def capability_matrix(spark: SparkSession, d: str) -> DataFrame:
    """For each rule, the positives it finds and the negatives it leaves."""
    hits = _findings(spark, d).select("ordinal", F.col("rule_id").alias("rule")).distinct().withColumn("hit", F.lit(True))
    rows = table(spark, d, "new_detect").where(F.col("rule").isNotNull()).select("ordinal", "rule", "label.vulnerable").join(hits, ["ordinal", "rule"], "left")
    v, h = F.col("vulnerable"), F.coalesce("hit", F.lit(False))
    return rows.groupBy("rule").agg(F.count_if(v).alias("positives"), F.count_if(v & h).alias("detected"), F.count_if(~v).alias("negatives"), F.count_if(~v & ~h).alias("clean"))


@query("set_anti_join", f"""
WITH s AS (SELECT DISTINCT ordinal, cwe FROM ({_findings_sql()}) JOIN {_RULES_SQL} USING (rule_id)),
m AS (SELECT ordinal, split_part(p, '|', 1) AS cwe FROM ({_detect_sql('new_detect')}) WHERE p IS NOT NULL)
SELECT m.ordinal, m.cwe FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ordinal = m.ordinal AND s.cwe = m.cwe)
""")
def set_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Model detections whose CWE no finding of the same record has."""
    static = scan.with_rule(_findings(spark, d)).select("ordinal", "cwe").distinct()
    model = table(spark, d, "new_detect").select("ordinal", scan.mock_detect(F.col("code")).alias("p")).where("p.vulnerable").select("ordinal", "p.cwe")
    return model.join(static, ["ordinal", "cwe"], "left_anti")


def ranked(df: DataFrame, *order: object) -> DataFrame:
    """``df`` with a rank from 1 in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("line_numbers_removed", f"""
WITH p AS (SELECT ordinal, code, regexp_split_to_array(code, '{LINE_END}') AS parts FROM new_detect WHERE code <> ''), q AS (SELECT ordinal, code, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM p),
n AS (SELECT *, len(list_filter(parts, lambda x: trim(x) <> '')) AS filled, len(list_filter(parts, lambda x: trim(x) <> '' AND regexp_matches(x, '^\\s*\\d+:'))) AS numbered FROM q)
SELECT ordinal, array_to_string(list_transform(parts, lambda x: regexp_replace(x, '^\\s*\\d+: ?', '')), chr(10)) AS code FROM n WHERE numbered > 0 AND numbered * 2 >= filled
""")
def line_numbers_removed(spark: SparkSession, d: str) -> DataFrame:
    """Records whose lines are numbered, without the numbers."""
    rows = table(spark, d, "new_detect").select("ordinal", "code", text.without_line_numbers(F.col("code")).alias("plain"))
    return rows.where(F.col("plain") != F.col("code")).select("ordinal", F.col("plain").alias("code"))


_HEAD = r"^@@ -(\d+)(?:,\d+)? \+(\d+)"


@query("changed_lines", f"""
WITH l AS ({lines('new_detect', 'code', 'ordinal')}), h AS (SELECT *, TRY_CAST(regexp_extract(raw, '{_HEAD}', 1) AS INTEGER) AS o, TRY_CAST(regexp_extract(raw, '{_HEAD}', 2) AS INTEGER) AS n FROM l),
g AS (SELECT ordinal, line, raw, last_value(CASE WHEN o IS NOT NULL THEN line END IGNORE NULLS) OVER w AS hunk, last_value(o IGNORE NULLS) OVER w AS o, last_value(n IGNORE NULLS) OVER w AS n FROM h WINDOW w AS (PARTITION BY ordinal ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, substr(raw, 1, 1) AS side, coalesce(sum(CASE WHEN substr(raw, 1, 1) = '+' THEN 0 ELSE 1 END) OVER v, 0) AS olds, coalesce(sum(CASE WHEN substr(raw, 1, 1) = '-' THEN 0 ELSE 1 END) OVER v, 0) AS news FROM g WHERE line > hunk AND NOT starts_with(raw, chr(92)) WINDOW v AS (PARTITION BY ordinal, hunk ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ordinal, side, CAST(CASE side WHEN '-' THEN o + olds ELSE n + news END AS INTEGER) AS line FROM b WHERE side IN ('-', '+')
""")
def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that the diffs among the records remove and add."""
    return scan.changed_lines(table(spark, d, "new_detect"), "code", "ordinal")


@query("coerced_labels", f"""
SELECT ordinal, CASE upper(trim({empty('label.severity')})) WHEN 'WARNING' THEN 'MEDIUM' WHEN 'ERROR' THEN 'HIGH' WHEN 'INFO' THEN 'INFO' WHEN 'LOW' THEN 'LOW' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'HIGH' THEN 'HIGH' WHEN 'CRITICAL' THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
  CASE WHEN contains(lower({empty('label.verdict')}), 'confirm') THEN 'Confirm' WHEN contains(lower({empty('label.verdict')}), 'reject') THEN 'Reject' ELSE '?' END AS verdict,
  CASE lower(trim(label.confidence)) WHEN 'low' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.6 WHEN 'high' THEN 0.9 ELSE coalesce(greatest(0.0, least(1.0, TRY_CAST(label.confidence AS DOUBLE))), 0.5) END AS confidence
FROM new_triage
""")
def coerced_labels(spark: SparkSession, d: str) -> DataFrame:
    """Severity, verdict and confidence of triage labels in their normal forms."""
    return table(spark, d, "new_triage").select("ordinal", text.severity(F.col("label.severity")).alias("severity"), text.verdict(F.col("label.verdict")).alias("verdict"), text.confidence(F.col("label.confidence")).alias("confidence"))


@query("lookup_status", f"""
WITH o AS (SELECT repo_url, max(coalesce(license, '') <> '') AS ok FROM new_triage WHERE repo_url IS NOT NULL GROUP BY repo_url)
SELECT n.ordinal, CASE WHEN o.ok IS NULL THEN 'missing' WHEN o.ok THEN 'attached' ELSE 'invalid' END AS status FROM new_detect n LEFT JOIN o USING (repo_url)
""")
def lookup_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether triage knows each record's repository, with a licence or without."""
    known = table(spark, d, "new_triage").where(F.col("repo_url").isNotNull()).groupBy("repo_url").agg(F.max(F.coalesce("license", F.lit("")) != "").alias("ok"))
    return relational.lookup_status(table(spark, d, "new_detect").select("ordinal", "repo_url"), known, "repo_url", F.col("ok")).select("ordinal", "status")


@query("positional_split", "SELECT ordinal, CASE WHEN p <= 8 THEN 'train' WHEN p <= 9 THEN 'val' WHEN p <= 11 THEN 'test' END AS split FROM (SELECT ordinal, row_number() OVER (PARTITION BY source, rule ORDER BY ordinal) AS p FROM new_triage)")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    """The first eight rows of each source and rule to train, one to val and two to test."""
    rows = table(spark, d, "new_triage").select("ordinal", F.struct("source", "rule").alias("g"))
    return relational.positional_split(rows, "g", "ordinal", {"train": 8, "val": 1, "test": 2}).select("ordinal", "split")
