"""Line-level scanning of source text with Spark expressions only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import lines
from auditlake.plans.skew import spread

# The rules, what they mean, and their patterns. The engine that checks them by SQL has no look-around, so
# the password rule and the comparison signal spell out what may follow; they match the same lines.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
WEIGHTS = {"CRITICAL": 40, "HIGH": 25, "MEDIUM": 12, "LOW": 5, "INFO": 1}
RULES = {
    "CRYPTO-001": ("Weak hash: MD5", "CWE-327", "MEDIUM"),
    "CRYPTO-002": ("Weak hash: SHA-1", "CWE-327", "MEDIUM"),
    "CRYPTO-003": ("Weak block cipher: DES/3DES", "CWE-327", "HIGH"),
    "CRYPTO-004": ("Deprecated cipher: RC4", "CWE-327", "HIGH"),
    "CRYPTO-005": ("AES ECB mode", "CWE-327", "HIGH"),
    "CRYPTO-006": ("Predictable or hard-coded IV", "CWE-329", "HIGH"),
    "CRYPTO-007": ("Hard-coded cryptographic key", "CWE-321", "HIGH"),
    "CRYPTO-008": ("Weak randomness for secrets", "CWE-338", "HIGH"),
    "CRYPTO-009": ("Weak key length or curve", "CWE-326", "HIGH"),
    "CRYPTO-010": ("Insecure TLS configuration", "CWE-326", "HIGH"),
    "CRYPTO-011": ("Plaintext password", "CWE-256", "HIGH"),
    "CRYPTO-012": ("Weak key derivation parameters", "CWE-916", "HIGH"),
    "CRYPTO-013": ("Timing-unsafe comparison", "CWE-208", "MEDIUM"),
}
LINE_PATTERNS = {
    "CRYPTO-001": r"""hashlib\.md5\s*\(|hashlib\.new\s*\(\s*["']md5["']""",
    "CRYPTO-002": r"""hashlib\.sha1\s*\(|hashlib\.new\s*\(\s*["']sha-?1["']""",
    "CRYPTO-003": r"Crypto\.Cipher\.DES3?\b|\bDES3?\.new\s*\(|import\s+DES3?\b",
    "CRYPTO-004": r"\bARC4\b|\bRC4\b",
    "CRYPTO-005": r"MODE_ECB|modes\.ECB",
    "CRYPTO-006": r"""\b(?:iv|nonce)\s*=\s*(?:b|rb)?["'][^"']*["']|modes\.(?:CBC|CFB|OFB)\s*\(\s*(?:b)?["']["']\s*\)|(?:MODE_CBC|MODE_CFB|MODE_OFB)[^#\n]*bytes\s*\(\s*16\s*\)""",
    "CRYPTO-007": r"""(?:AES\.new|Fernet|Cipher)\s*\(\s*(?:b|rb)?["'][^"']{6,}["']|\b(?:key|secret|api_key|private_key)\s*=\s*(?:b|rb)?["'][^"']{6,}["']""",
    "CRYPTO-008": r"\b(?:iv|key|token|salt|nonce|secret|password)\w*\s*=\s*random\.",
    "CRYPTO-009": r"RSA\.generate\s*\(\s*(?:512|768|1024)\s*\)|SECP192R1|SECP160R1|SECP112R1|SECT163",
    "CRYPTO-010": r"PROTOCOL_SSLv[23]|PROTOCOL_TLSv1(?:_1)?\b|_create_unverified_context|CERT_NONE|verify\s*=\s*False",
    "CRYPTO-011": r"\.\s*(?:password|passwd|pwd)\s*=\s*(?:[^=]|$)|\bset_(?:password|passwd|pwd)\s*\(",
    "CRYPTO-013": r"\b\w*(?:password|passwd|pwd|token|secret|digest|hash|signature|mac)\w*\s*(?:==|!=)\s*[A-Za-z_]",
}
NUMBER_PATTERNS = [
    ("CRYPTO-012", r"pbkdf2_hmac\s*\([^)]*?,\s*(\d{1,7})\s*[,)]", 100_000),
    ("CRYPTO-012", r"bcrypt\.gensalt\s*\(\s*rounds\s*=\s*(\d+)\s*\)", 12),
    ("CRYPTO-012", r"scrypt\s*\([^)]*?n\s*=\s*(\d+)", 16_384),
    ("CRYPTO-009", r"RSA\.generate\s*\(\s*(\d{3,5})\s*\)", 2_048),
]
COMMENT = r"^(#|//|/\*|\*)"
#: Literal parts, in lower case, of which a line that matches has at least one.
HINTS = {
    "CRYPTO-001": ["hashlib"],
    "CRYPTO-002": ["hashlib"],
    "CRYPTO-003": ["des"],
    "CRYPTO-004": ["rc4"],
    "CRYPTO-005": ["ecb"],
    "CRYPTO-006": ["iv", "nonce", "cbc", "cfb", "ofb"],
    "CRYPTO-007": ["aes.new", "fernet", "cipher", "key", "secret"],
    "CRYPTO-008": ["random."],
    "CRYPTO-009": ["rsa.generate", "secp", "sect163"],
    "CRYPTO-010": ["protocol_", "_create_unverified_context", "cert_none", "verify"],
    "CRYPTO-011": ["passw", "pwd"],
    "CRYPTO-013": ["==", "!="],
}
NUMBER_HINTS = ["pbkdf2_hmac", "bcrypt", "scrypt", "rsa.generate"]
DETECT_SIGNALS = [
    (r"""hashlib\.md5|hashlib\.new\(\s*["']md5""", "CWE-327", "MEDIUM"),
    (r"""hashlib\.sha1|hashlib\.new\(\s*["']sha1""", "CWE-327", "MEDIUM"),
    (r"AES\.MODE_ECB|modes\.ECB", "CWE-327", "HIGH"),
    (r"""AES\.new\([^)]*,\s*(b?"\s*"|bytes\(\s*16\s*\))|modes\.CBC\(\s*b?""\)""", "CWE-329", "HIGH"),
    (r"""AES\.new\(\s*b?["'][^"']+["']""", "CWE-321", "HIGH"),
    (r"(?:iv|salt|token|nonce|secret|password)\s*=\s*random\.", "CWE-338", "HIGH"),
    (r"RSA\.generate\(\s*(?:512|768|1024)\s*\)", "CWE-326", "HIGH"),
    (r"PROTOCOL_(SSLv3|SSLv2|TLSv1\b|TLSv1_1)|_create_unverified_context|CERT_NONE|verify=False", "CWE-326", "HIGH"),
    (r"(?:\.password|\.passwd|\.pwd)\s*=(?:[^=!]|$)", "CWE-256", "HIGH"),
    (r"pbkdf2_hmac\([^)]*,\s*\d{1,5}\s*\)|PBKDF2\([^)]*\d{1,5}\s*\)", "CWE-916", "HIGH"),
    (
        r"(?:password|passwd|pwd|token|secret|hash|digest|signature|cookie|mac|guess|attempt|provided|input)(?:[^A-Za-z0-9_]|$)\s*(?:==|!=)\s*[A-Za-z0-9_.]*(?:password|passwd|pwd|token|secret|hash|digest|signature|cookie|mac|guess|attempt|provided|input)(?:[^A-Za-z0-9_]|$)",
        "CWE-208",
        "MEDIUM",
    ),
    (r"os\.system\(|subprocess\.(?:Popen|call|run)\([^)]*\+", "CWE-078", "HIGH"),
    (r"pickle\.(?:loads?|load)\(", "CWE-502", "HIGH"),
    (r"yaml\.load\(", "CWE-502", "HIGH"),
    (r"\beval\(|\bexec\(", "CWE-094", "HIGH"),
    (r"""cursor\.execute\([^)]*[+%]|\.execute\(\s*f["']""", "CWE-089", "HIGH"),
]
TEST_DEF = r"(?m)^(async\s+)?def\s+test_"
FIXES = [
    ("CRYPTO-001", r"hashlib\.md5\s*\(", "hashlib.sha256("),
    ("CRYPTO-001", r"""(?i)(hashlib\.new\s*\(\s*)(["'])md5(["'])""", "$1$2sha256$3"),
    ("CRYPTO-002", r"hashlib\.sha1\s*\(", "hashlib.sha256("),
    ("CRYPTO-002", r"""(?i)(hashlib\.new\s*\(\s*)(["'])sha-?1(["'])""", "$1$2sha256$3"),
    ("CRYPTO-009", r"RSA\.generate\s*\(\s*(?:512|768|1024)\s*\)", "RSA.generate(3072)"),
    ("CRYPTO-010", r"verify\s*=\s*False", "verify=True"),
    ("CRYPTO-010", r"ssl\.SSLContext\s*\(\s*ssl\.PROTOCOL_(?:SSLv[23]|TLSv1(?:_1)?)\s*\)", "ssl.create_default_context()"),
    ("CRYPTO-012", r"(pbkdf2_hmac\s*\([^)]*?,\s*)(\d{1,6})(\s*[,)])", "${1}600000$3"),
    ("CRYPTO-012", r"(bcrypt\.gensalt\s*\(\s*rounds\s*=\s*)(\d+)(\s*\))", "${1}12$3"),
    ("CRYPTO-012", r"(scrypt\s*\([^)]*?n\s*=\s*)(\d+)(\s*)", "${1}16384$3"),
]
#: Literal parts of which a line that a fix changes has at least one.
FIX_HINTS = ["hashlib", "RSA.generate", "verify", "ssl.SSLContext", "pbkdf2_hmac", "bcrypt", "scrypt"]
UNSAFE_C = r"\b(strcpy|strcat|gets|sprintf|scanf)\s*\("


def severity_rank(severity: Column) -> Column:
    """The place of a severity from INFO, 0; unknown ones count 0."""
    return F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1)


def rule_table(df: DataFrame) -> DataFrame:
    """(rule_id, title, cwe, severity) of the thirteen rules."""
    return df.sparkSession.createDataFrame([(k, *v) for k, v in RULES.items()], "rule_id string, title string, cwe string, severity string")


def source_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``df`` with a row for each line of a text: line numbers from 1, and the raw line."""
    return df.select(*keep, F.posexplode(lines(F.col(text))).alias("at", "raw")).select(*keep, (F.col("at") + 1).alias("line"), "raw")


def _may_match(low: Column, hints: list[str]) -> Column:
    out = low.contains(hints[0])
    for hint in hints[1:]:
        out = out | low.contains(hint)
    return out


def line_rules(raw: Column, low: Column) -> Column:
    """The sorted distinct rules that a line breaks, null for blank lines and comments; ``low`` is it in lower case.

    A pattern is only tried on lines that hold one of its literal parts, since a search for a part costs far less.
    """
    plain = [F.when(_may_match(low, HINTS[rule]) & raw.rlike(f"(?i){p}"), rule) for rule, p in LINE_PATTERNS.items()]
    numbers = [F.when(low.contains(hint) & (F.regexp_extract(raw, f"(?i){p}", 1).try_cast("bigint") < least), rule) for (rule, p, least), hint in zip(NUMBER_PATTERNS, NUMBER_HINTS, strict=True)]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*plain, *numbers))))
    skipped = ~raw.rlike(r"(?U)\S") | raw.rlike(r"(?U)^\s*(#|//|/\*|\*)")
    return F.when(~skipped, found)


def _ruled_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., line, raw, low) of every line; ``low`` is a column of its own, so that it is computed once for all rules."""
    return source_lines(spread(df.select(*dict.fromkeys([*keep, text])), keep[0]), text, *keep).withColumn("low", F.lower("raw"))


def line_findings(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each rule and line: (keep..., line, rule_id, column_at, snippet)."""
    rows = _ruled_lines(df, text, *keep)
    stripped = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    # the outer explode keeps the optimizer from computing the rules once more for a filter before it
    hits = rows.select(*keep, "line", "raw", F.explode_outer(line_rules(F.col("raw"), F.col("low"))).alias("rule_id")).where(F.col("rule_id").isNotNull())
    hits = hits.select(*keep, "line", "rule_id", F.length(F.regexp_extract("raw", r"(?U)^(\s*)", 1)).alias("column_at"), stripped.alias("snippet"))
    return hits.select(*keep, "line", "rule_id", "column_at", "snippet")


def engine_findings(df: DataFrame, text: str, literals: dict[str, tuple[str, str]], *keep: str) -> DataFrame:
    """(keep..., line, rule_id, severity, engine): the line rules, engine 1, and literal searches, engine 0, in one pass.

    ``literals`` gives a rule and severity for each text that a line may hold; comments count for these.
    """
    severities = F.create_map(*(F.lit(x) for rule, (_, _, severity) in RULES.items() for x in (rule, severity)))
    own = F.transform(F.coalesce(line_rules(F.col("raw"), F.col("low")), F.array().cast("array<string>")), lambda r: F.struct(r.alias("rule_id"), severities[r].alias("severity"), F.lit(1).alias("engine")))
    other = F.array_compact(F.array(*(F.when(F.col("raw").contains(part), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(0).alias("engine"))) for part, (rule, severity) in literals.items())))
    found = _ruled_lines(df, text, *keep).select(*keep, "line", F.explode_outer(F.concat(own, other)).alias("f"))
    return found.where(F.col("f").isNotNull()).select(*keep, "line", "f.*")


def first_rule(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., rule_id): each row with its smallest rule, null if it breaks none; ``keep`` tells rows apart.

    The lines of a row lie in one task, so they are combined before the shuffle.
    """
    rows = spread(df, keep[0]).select(*keep, F.explode_outer(lines(F.col(text))).alias("raw")).withColumn("low", F.lower("raw"))
    return rows.select(*keep, F.array_min(line_rules(F.col("raw"), F.col("low"))).alias("r")).groupBy(*keep).agg(F.min("r").alias("rule_id"))


def with_rule(findings: DataFrame) -> DataFrame:
    """Findings with title, CWE and severity; thirteen rules, so they are broadcast."""
    return findings.join(F.broadcast(rule_table(findings)), "rule_id", "left").withColumns({"severity": F.coalesce("severity", F.lit("MEDIUM")), "cwe": F.coalesce("cwe", F.lit("CWE-UNKNOWN"))})


def keep_most_severe(findings: DataFrame, keys: list[str], engine_ordinal: str) -> DataFrame:
    """One finding for each key: the most severe, and of equal ones that of the earliest engine."""
    row = F.struct(*findings.columns)
    order = F.struct(-severity_rank(F.col("severity")), F.col(engine_ordinal))
    return findings.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def context(text: Column, line: Column, before: int, after: int) -> Column:
    """The lines around a line, as one text, ends cut at the file's."""
    all_lines = lines(text)
    start = F.greatest(F.lit(1), line - before)
    return F.array_join(F.slice(all_lines, start, F.greatest(F.lit(0), F.least(F.size(all_lines), line + after) - start + 1)), "\n")


def mock_detect(code: Column) -> Column:
    """The first signal that a code shows, as (vulnerable, cwe, severity); none is safe."""
    out = F.struct(F.lit(False).alias("vulnerable"), F.lit("").alias("cwe"), F.lit("").alias("severity"))
    for pattern, cwe, severity in reversed(DETECT_SIGNALS):
        out = F.when(code.rlike(f"(?i){pattern}"), F.struct(F.lit(True).alias("vulnerable"), F.lit(cwe).alias("cwe"), F.lit(severity).alias("severity"))).otherwise(out)
    return out


def mock_triage(code: Column) -> Column:
    """``Reject`` for test code, else ``Confirm``."""
    return F.when(code.rlike(TEST_DEF) | F.lower(F.substring(code, 1, 300)).contains("/test"), "Reject").otherwise("Confirm")


def fixed_line(raw: Column) -> Column:
    """A line after the mechanical fixes of all rules, in order.

    No fix makes a line match another, so lines without any of their literal parts are returned as they are.
    """
    fixed = raw
    for _, pattern, replacement in FIXES:
        fixed = F.regexp_replace(fixed, pattern, replacement.replace("${1}", "$1"))
    return F.when(_may_match(raw, FIX_HINTS) | _may_match(F.lower(raw), ["hashlib"]), fixed).otherwise(raw)


def fix_changes(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., line, before, after): the lines that the mechanical fixes change."""
    rows = source_lines(df, text, *keep).where(_may_match(F.col("raw"), FIX_HINTS) | _may_match(F.lower("raw"), ["hashlib"]))
    rows = rows.withColumn("after", fixed_line(F.col("raw")))
    return rows.where(F.col("after") != F.col("raw")).select(*keep, "line", F.rtrim("raw").alias("before"), F.rtrim("after").alias("after"))


def risk_score(findings: DataFrame, group: str, verdict: Column, confidence: Column) -> DataFrame:
    """(group, score, level): weights times confidence, half if uncertain, none if rejected, at most 100."""
    weight = F.lit(8)
    for name, points in WEIGHTS.items():
        weight = F.when(F.col("severity") == name, points).otherwise(weight)
    factor = F.when(verdict == "REJECTED", 0.0).when(verdict == "CONFIRMED", confidence).otherwise(confidence * 0.5)
    scored = findings.groupBy(group).agg(F.least(F.lit(100.0), F.bround(F.sum(weight * factor))).cast("int").alias("score"))
    s = F.col("score")
    return scored.withColumn("level", F.when(s >= 75, "CRITICAL").when(s >= 50, "HIGH").when(s >= 20, "MEDIUM").when(s > 0, "LOW").otherwise("INFO"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """(severity, n) with a row for every severity."""
    levels = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def exceeds(findings: DataFrame, threshold: str = "MEDIUM", most: dict[str, int] | None = None) -> DataFrame:
    """One row: whether any finding reaches the threshold, or a severity has more than its maximum."""
    over = [F.count_if(F.col("severity") == s) > n for s, n in (most or {}).items()]
    reached = F.count_if(severity_rank(F.col("severity")) >= SEVERITIES.index(threshold)) > 0
    for x in over:
        reached = reached | x
    return findings.agg(reached.alias("exceeded"), F.count("*").alias("findings"))


_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)")
_INDENT = re.compile(r"[ \t]*")
_BLANK = " \t\n\x0b\f\r"


def indented_functions(text: str | None) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of the functions of a text by indentation, in one pass with a stack of open ones."""
    found: list[tuple[str, int, int]] = []
    opened: list[tuple[int, str, int]] = []
    last = 0
    for number, line in enumerate((text or "").splitlines(), 1):
        if not line.strip(_BLANK):
            continue
        indent = _INDENT.match(line).end()
        while opened and indent <= opened[-1][0]:
            _, name, first = opened.pop()
            found.append((name, first, number - 1))
        head = _DEF.match(line)
        if head:
            opened.append((indent, head[1], number))
        last = number
    return found + [(name, first, last) for _, name, first in opened]


def function_ranges(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, name, start_line, end_line): the functions of Python text by indentation.

    A function ends before the next line that is not blank and not indented deeper than its header. Only texts that
    hold a header reach a Python worker.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *f) for k, t in zip(batch[key], batch[text], strict=True) for f in indented_functions(t)]
            yield pd.DataFrame(rows, columns=[key, "name", "start_line", "end_line"])

    rows = spread(df.select(key, text), key).where(F.col(text).contains("def"))
    return rows.mapInPandas(run, f"`{key}` {kind}, name string, start_line int, end_line int")


def brace_depth(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line, depth): the depth of braces after each line."""
    rows = source_lines(df, text, key)
    change = F.length(F.regexp_replace("raw", r"[^{]", "")) - F.length(F.regexp_replace("raw", r"[^}]", ""))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, "line", F.sum(change).over(w).alias("depth"))


def annotations(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line, kind, rule): ``ruleid`` and ``ok`` marks; a bare ``ok`` has the rule of the mark before it."""
    rows = source_lines(df, text, key)
    named = r"^\s*(?:#|//)\s*(ruleid|deepruleid|ok|todoruleid|todook)\s*:\s*([A-Za-z0-9_.\-]+)"
    mark = F.regexp_extract("raw", named, 1)
    bare = F.col("raw").rlike(r"^\s*(?:#|//)\s*ok\s*:?\s*$")
    marked = rows.where((mark != "") | bare).withColumns({"kind": F.when(mark.isin("ruleid", "deepruleid"), "ruleid").otherwise("ok"), "own": F.nullif(F.regexp_extract("raw", named, 2), F.lit(""))})
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("rule", F.last("own", ignorenulls=True).over(w)).where(F.col("rule").isNotNull()).select(key, "line", "kind", "rule")


def unsafe_c_calls(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line, rule_id, severity): unsafe C calls in lines, ``//`` comments left out."""
    rows = source_lines(df, text, key).withColumn("code", F.regexp_replace("raw", r"//.*", ""))
    kept = rows.where(~F.col("code").rlike(r"^\s*$|^\s*\*"))
    calls = kept.select(key, "line", F.explode(F.regexp_extract_all("code", F.lit(UNSAFE_C), F.lit(1))).alias("call"))
    return calls.select(key, "line", F.concat(F.lit("c-unsafe-api-"), "call").alias("rule_id"), F.when(F.col("call") == "gets", "CRITICAL").otherwise("HIGH").alias("severity"))


def changed_lines(df: DataFrame, patch: str, key: str) -> DataFrame:
    """(key, side, line): lines that unified diffs remove (``-``, old numbers) or add (``+``, new numbers).

    A hunk's header sets both counters; context moves both, a removed line the old and an added one the new.
    """
    rows = source_lines(df, patch, key)
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)"
    rows = rows.withColumns({"old": F.regexp_extract("raw", head, 1).try_cast("int"), "new": F.regexp_extract("raw", head, 2).try_cast("int")})
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"hunk": F.last(F.when(F.col("old").isNotNull(), F.col("line")), ignorenulls=True).over(upto), "old": F.last("old", ignorenulls=True).over(upto), "new": F.last("new", ignorenulls=True).over(upto)})
    body = rows.where(F.col("hunk").isNotNull() & (F.col("line") > F.col("hunk")) & ~F.col("raw").startswith("\\"))
    inside = Window.partitionBy(key, "hunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    sign = F.substring("raw", 1, 1)
    before = lambda other: F.coalesce(F.sum(F.when(sign == other, 0).otherwise(1)).over(inside), F.lit(0))
    numbered = body.select(key, sign.alias("side"), F.when(sign == "-", F.col("old") + before("+")).otherwise(F.col("new") + before("-")).cast("int").alias("line"))
    return numbered.where(F.col("side").isin("-", "+"))
