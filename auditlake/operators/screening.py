"""Screening of candidates and local records: tiers, gates, structural checks, addresses, projections and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import bounded, collapsed, cwe, lines, path_kind
from auditlake.operators import candidates, scan
from auditlake.operators.candidates import first_failing
from auditlake.operators.dataset import RULE_CWE, TARGET_CWES

# Classes, spellings of missing values, licences, sources, prefixes and tokens.
CLASSES = ["A", "B", "C", "D"]
COARSE_CWES = sorted({*TARGET_CWES, "CWE-208", "CWE-256", "CWE-295"})
NO_LICENSE = ["unknown", "n/a", "none", "tbd"]
NO_SPDX = ["NOASSERTION", "NONE", "UNKNOWN"]
LICENSES = {
    "urllib3/urllib3": "MIT",
    "django/django": "BSD-3-Clause",
    "jpadilla/pyjwt": "MIT",
    "pyca/cryptography": "Apache-2.0 OR BSD-3-Clause",
    "paramiko/paramiko": "LGPL-2.1-or-later",
    "mpdavis/python-jose": "MIT",
    "authlib/authlib": "BSD-3-Clause",
    "sybrenstuvel/python-rsa": "Apache-2.0",
    "oauthlib/oauthlib": "BSD-3-Clause",
}
PREDICTED = ["pycode-vul:", "predicted:"]
SYNTHETIC = ["round4-exp", "round4-negative", "round4-pos", "round4-neg", "round5-", "round6-", "semgrep-rule-fixture", "bandit-rule-fixture"]
TREE_CWES = {"python-weak-hash": "CWE-327", "python-hardcoded-secret": "CWE-321", "python-no-tls-verify": "CWE-295"}
WEAK_TOKENS = ["hashlib.md5(", "hashlib.sha1(", "DES.new(", "DES3.new(", "ARC4.new(", "MODE_ECB", "modes.ECB(", "verify=False", "PROTOCOL_TLSv1", "PROTOCOL_SSLv2", "PROTOCOL_SSLv3", "CERT_NONE", "_create_unverified_context"]
CRYPTO_TOKENS = ["hashlib.", "hmac.", "secrets.", "os.urandom", "from Crypto", "Crypto.", "cryptography.", "ssl.", "Fernet(", "AES.new", "AES.MODE", "algorithms.AES", "RSA.generate", "RSA.import", "HKDF(", "scrypt(", "pbkdf2", "argon2", "bcrypt", "ChaCha20", "compare_digest"]
COMMIT_URL = r"^https?://(?:www\.)?[^/]+/([^/]+)/([^/#?]+)/commit/([0-9a-fA-F]{7,40})"

_text = lambda name: F.coalesce(F.col(name), F.lit(""))
_filled = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"^\s*$")
_starts = lambda c, prefixes: F.coalesce(F.greatest(*(c.startswith(p) for p in prefixes)), F.lit(False))


def has_code_pair() -> Column:
    """Both sides of the code are there."""
    return _filled(F.col("code_vuln")) & _filled(F.col("code_fixed"))


def is_predicted() -> Column:
    """A reason says that only a model or data set predicts the label."""
    reasons = F.coalesce("match_reasons", F.array().cast("array<string>"))
    return F.exists(reasons, lambda r: _starts(r, PREDICTED))


def is_volume(both_parse: Column) -> Column:
    """A commit, a code pair that parses and a production file, whatever the advisory."""
    return (_text("fix_commit") != "") & has_code_pair() & (path_kind(F.col("file_path")) == "production") & both_parse


def screening_tier(score: Column) -> Column:
    """P1 from 12 points, P2 from 8, else P3; no advisory, no commit or code, and test files are P3 whatever the score.

    A candidate that only a model predicts, without an advisory id, is P2 at most.
    """
    advisory = _text("advisory_id") != ""
    tier = (
        F.when(~advisory & (_text("cve_id") == ""), "P3")
        .when((_text("fix_commit") == "") | ~_filled(F.col("code_vuln")), "P3")
        .when(path_kind(F.col("file_path")).isin("test", "conftest"), "P3")
        .when(score >= 12, "P1")
        .when(score >= 8, "P2")
        .otherwise("P3")
    )
    return F.when(is_predicted() & ~advisory & (tier == "P1"), "P2").otherwise(tier)


def structural_errors() -> Column:
    """The names of what is wrong with a candidate, in a fixed order; class A asks for the whole chain of evidence.

    A row without identifier or source says so; an unknown class is the last error that is looked for.
    """
    klass, rule, own = F.col("preliminary_class"), F.trim(_text("rule_id")), F.trim(_text("cwe"))
    known = klass.isNotNull() & klass.isin(CLASSES)
    a = klass == "A"
    allowed = F.lit(False)
    for name, cwes in RULE_CWE.items():
        allowed = allowed | ((rule == name) & own.isin(cwes))
    strict = {
        "no_advisory": (_text("advisory_id") == "") & (_text("cve_id") == ""),
        "no_repo": _text("repo_url") == "",
        "no_commit": (_text("vuln_commit") == "") & (_text("fix_commit") == ""),
        "no_file": _text("file_path") == "",
        "no_function": _text("function_name") == "",
        "no_rule": rule == "",
        "no_cwe": own == "",
        "no_license": F.trim(_text("license")).isin("") | F.lower(F.trim(_text("license"))).isin(NO_LICENSE),
        "no_verdict": _text("human_verdict") == "",
    }
    checks = [
        F.when(_text("candidate_id") == "", "no_id"),
        F.when(_text("source") == "", "no_source"),
        F.when(~known, "class"),
        F.when(known & (rule != "") & ~rule.isin(list(RULE_CWE)), "unknown_rule"),
        F.when(a & (own != "") & ~own.isin(COARSE_CWES), "cwe_outside_target"),
        F.when(known & rule.isin(list(RULE_CWE)) & (own != "") & ~allowed, "cwe_against_rule"),
        *(F.when(a & bad, name) for name, bad in strict.items()),
    ]
    return F.array_compact(F.array(*checks))


def exclusion_reason(code: Column, verdict: Column, vulnerable: Column, source: Column, rule: Column, own_cwe: Column, language: Column, path: Column) -> Column:
    """Why a local record is no candidate: the first reason that holds, null if none does."""
    low = F.lower(F.coalesce(verdict, F.lit("")))
    rule, lang = F.upper(F.trim(F.coalesce(rule, F.lit("")))), F.lower(F.trim(F.coalesce(language, F.lit(""))))
    own = F.coalesce(cwe(own_cwe), F.lit(""))
    suffix = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[^./\\]+)$", 1))
    return first_failing(
        {
            "control_row": ~(F.coalesce(~vulnerable, F.lit(False)) | low.isin("reject", "false", "negative")),
            "synthetic_source": ~_starts(F.lower(F.coalesce(source, F.lit(""))), SYNTHETIC),
            "no_code": _filled(code),
            "no_taxonomy": (rule != "") | (own != ""),
            "outside_taxonomy": rule.isin(list(RULE_CWE)) | own.isin(TARGET_CWES),
            "other_language": (lang == "") | (lang == "py") | lang.startswith("python"),
            "other_file": (lang != "") | (suffix == "") | suffix.isin(".py", ".pyi"),
        }
    )


def licence_hint(repo_url: Column) -> Column:
    """The licence of a known repository by its ``owner/name``; empty for any other."""
    slug = F.concat_ws("/", F.regexp_extract(repo_url, candidates.CODE_HOST, 1), F.regexp_replace(F.regexp_extract(repo_url, candidates.CODE_HOST, 2), r"\.git$", ""))
    known = F.create_map(*(F.lit(x) for pair in LICENSES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, slug), F.lit(""))


def concrete_licence(spdx: Column) -> Column:
    """A licence identifier, empty for the spellings that say there is none."""
    own = F.trim(F.coalesce(spdx, F.lit("")))
    return F.when(F.upper(own).isin(NO_SPDX), "").otherwise(own)


def merged_verdict(severity: Column, verdict: Column, confidence: Column, own_severity: Column) -> Column:
    """(verdict, confidence, severity) of a finding by a model's answer.

    The verdict is upper case, UNCERTAIN if there is none; the confidence has two decimals, 0.5 if there is none or it
    is 0; a severity that isn't one leaves the finding's own, MEDIUM if it has none.
    """
    level = F.upper(F.coalesce(severity, F.lit("")))
    number = F.nullif(confidence.try_cast("double"), F.lit(0.0))
    return F.struct(
        F.upper(F.coalesce(F.nullif(verdict, F.lit("")), F.lit("UNCERTAIN"))).alias("verdict"),
        F.bround(F.coalesce(number, F.lit(0.5)), 2).alias("confidence"),
        F.when(level.isin(scan.SEVERITIES), level).otherwise(F.coalesce(own_severity, F.lit("MEDIUM"))).alias("severity"),
    )


def file_category(repo: Column, path: Column) -> Column:
    """Why a weak primitive in a library is no defect, by repository first and path next."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(repo == "itsdangerous", "hmac-legacy-digest")
        .when(repo == "passlib", "legacy-hash-scheme")
        .when(low.contains("selftest") | low.contains("/test_") | low.startswith("test_"), "test-vector")
        .when(low.contains("speedtest"), "benchmark")
        .otherwise("legacy-format")
    )


def commit_hashes(repo_url: Column, fix_commit: Column, references: Column) -> Column:
    """The distinct commits of a candidate, its own first and then those of references to its repository; longest first.

    Equally long ones keep their order.
    """
    owner = lambda u, i: F.lower(F.regexp_replace(F.regexp_extract(u, candidates.CODE_HOST, i), r"\.git$", ""))
    urls = F.transform(F.coalesce(references, F.array().cast("array<struct<type:string,url:string>>")), lambda r: F.coalesce(r["url"], F.lit("")))
    same = F.filter(urls, lambda u: u.rlike(COMMIT_URL) & (owner(u, 1) == owner(repo_url, 1)) & (owner(u, 2) == owner(repo_url, 2)) & (owner(repo_url, 1) != ""))
    every = F.concat(F.array(F.trim(F.coalesce(fix_commit, F.lit("")))), F.transform(same, lambda u: F.regexp_extract(u, COMMIT_URL, 3)))
    every = F.array_distinct(F.filter(every, lambda x: x != ""))
    placed = F.transform(every, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def repository_url(raw: Column, host: str) -> Column:
    """A repository's address: web addresses as they are, ``owner/name`` under ``host``, else empty."""
    own = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(own.rlike("^https?://"), own).when(own.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), F.concat(F.lit(host.rstrip("/") + "/"), own)).otherwise("")


def commit_url(repo_url: Column, commit: Column) -> Column:
    """The address of a commit; empty without repository or commit."""
    repo = F.regexp_replace(F.coalesce(repo_url, F.lit("")), "/+$", "")
    return F.when((repo == "") | (F.coalesce(commit, F.lit("")) == ""), "").otherwise(F.concat(repo, F.lit("/commit/"), commit))


def relative_path(path: Column, package: Column, root: str) -> Column:
    """A path with slashes and without the folder of its package under ``root``."""
    plain = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    prefix = F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(package, F.lit("")), F.lit("/"))
    return F.when((F.coalesce(package, F.lit("")) != "") & F.startswith(plain, prefix), F.substring(plain, F.length(prefix) + 1, F.length(plain))).otherwise(plain)


def as_list(value: Column) -> Column:
    """A text as a list: a JSON array of texts, or itself; none for null and empty text."""
    own = F.trim(F.coalesce(value, F.lit("")))
    return F.when(own == "", F.array().cast("array<string>")).when(own.startswith("["), F.coalesce(F.from_json(own, "array<string>"), F.array(own))).otherwise(F.array(own))


def finding_text(rule: Column, message: Column) -> Column:
    """``[rule] message``."""
    return F.concat(F.lit("["), F.coalesce(rule, F.lit("")), F.lit("] "), F.coalesce(message, F.lit("")))


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced by each value; null values are empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def finding_context(*names: str) -> Column:
    """The columns that aren't null, as JSON in the given order."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "true"})


def primary_file(df: DataFrame, group: str, path: str, patch: str, package: str) -> DataFrame:
    """(group, path, score): of each group's files the best implementation of the fix; null if it has none.

    Files with a patch come first, then by score, changed lines, short and small names. One combined aggregation, so a
    group of any size arrives as one row a task.
    """
    score = candidates.file_score(F.col(path), F.col(patch), F.col(package))
    changed = F.size(F.filter(lines(_text(patch)), lambda x: x.rlike(r"^(\+(?!\+\+)|-(?!--))")))
    place = F.struct(F.col(patch).isNull().cast("int").alias("late"), (-score).alias("s"), (-changed).alias("c"), F.length(_text(path)).alias("l"), _text(path).alias("path"))
    rows = df.select(F.col(group), F.when(score > -10_000, place).alias("p"))
    best = rows.groupBy(group).agg(F.min("p").alias("p"))
    return best.select(group, F.col("p.path").alias("path"), (-F.col("p.s")).alias("score"))


def backtest_bucket(task: Column, vulnerable: Column, source: Column, rule: Column, hits: Column) -> Column:
    """What a record does against the rules that it should show: null if it keeps to them.

    ``hits`` are its rules. Library and real-project sources of triage records need not show theirs.
    """
    none = F.size(F.coalesce(hits, F.array().cast("array<string>"))) == 0
    source, rule = F.coalesce(source, F.lit("")), F.coalesce(rule, F.lit(""))
    bad = F.coalesce(vulnerable, F.lit(False))
    exempt = source.contains("passlib") | source.contains("real")
    detect = F.when(bad & none, "pos_missing").when(~bad & source.endswith("aneg") & ~none, "aneg_hit").when(~bad & source.endswith("bneg") & none, "bneg_no_fire")
    triage = F.when((rule != "") & ~F.coalesce(F.array_contains(hits, rule), F.lit(False)) & ~exempt, "finding_miss")
    return F.when(task == "detect", detect).when(task == "triage", triage)


def gates(metrics: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """(metric, value, limit, passed) of a one-row table of metrics against (metric, ``>``, ``>=`` or ``<=``, limit)."""
    rows = []
    for name, how, limit in limits:
        value = F.col(name)
        passed = value > limit if how == ">" else value >= limit if how == ">=" else value <= limit
        rows.append(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), passed.alias("passed")))
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def safe_function(code: Column, path: Column, skipped: list[str]) -> Column:
    """Whether code may serve as a safe example: 3 to 60 lines, crypto tokens, none of the weak ones, no skipped path."""
    count = F.size(lines(code))
    low = F.lower(F.coalesce(path, F.lit("")))
    any_of = lambda c, tokens: F.greatest(*(c.contains(t) for t in tokens)) if len(tokens) > 1 else c.contains(tokens[0])
    return F.coalesce(count.between(3, 60) & ~any_of(code, WEAK_TOKENS) & any_of(code, CRYPTO_TOKENS) & ~any_of(low, skipped), F.lit(False))


def id_lists(df: DataFrame, key: str, identifier: str, ordinal: str, stretch: int = 1000) -> DataFrame:
    """(key, stretch, ids): the identifiers of each key in order, a list for every ``stretch`` arrival numbers.

    Lists are bounded by the stretch, so a key that holds a third of all rows never is one value. Null keys have none.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, F.floor(F.col(ordinal) / stretch).alias("stretch"), F.struct(F.col(ordinal).alias("o"), F.col(identifier).alias("i")).alias("e"))
    lists = rows.groupBy(key, "stretch").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return lists.select(key, "stretch", F.transform("es", lambda e: e["i"]).alias("ids"))


def shared_keys(a: DataFrame, b: DataFrame, key: str, identifier: str) -> DataFrame:
    """(key, side, id): the rows of both sides whose key occurs in both, in long form, so that no key is a list."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").where(F.col(key).isNotNull())
    sides = a.select(key, F.lit("a").alias("side"), F.col(identifier).alias("id")).unionByName(b.select(key, F.lit("b").alias("side"), F.col(identifier).alias("id")))
    return sides.join(both, key, "left_semi")


def tiers(df: DataFrame, key: str, hits: Column, test: Column, predicted: Column, vulnerable: Column, patched: Column) -> DataFrame:
    """(key, tier): ``T1`` for code that breaks a rule, ``T2`` for other code that isn't a test and has a predicted CWE,
    ``negative`` for the patched side of such code if no T1 or T2 row has the same text."""
    found = F.size(F.coalesce(hits, F.array().cast("array<string>"))) > 0
    rows = df.select(
        F.col(key),
        F.when(found, "T1").when(~test & (predicted != ""), "T2").alias("tier"),
        (found | ~test & (predicted != "")).alias("positive"),
        (~test & (predicted != "") & _filled(patched)).alias("mirrored"),
        F.sha2(collapsed(vulnerable), 256).alias("own"),
        F.sha2(collapsed(patched), 256).alias("other"),
    )
    positives = rows.where("positive").select(F.col("own").alias("other")).distinct()
    negatives = rows.where("mirrored").join(positives, "other", "left_anti").select(key, F.lit("negative").alias("tier"))
    return rows.where(F.col("tier").isNotNull()).select(key, "tier").unionByName(negatives)


def audit_prompt(evidence: list[str], vulnerable: Column, fixed: Column, longest: int = 50_000) -> Column:
    """The text of an audit request: the evidence as JSON, nulls as empty texts, and both sides of the code, bounded."""
    fields = F.to_json(F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in evidence)))
    fence = lambda c: F.concat(F.lit("```python\n"), bounded(F.coalesce(c, F.lit("")), longest), F.lit("\n```"))
    return F.concat(F.lit("Audit this candidate.\n\nCandidate metadata:\n"), fields, F.lit("\n\nVulnerable-side code:\n"), fence(vulnerable), F.lit("\n\nFixed-side code:\n"), fence(fixed))


def evidence_status(claims: DataFrame, sources: DataFrame, path: str, snippet: str, text: str) -> DataFrame:
    """``claims`` with ``status`` and ``source_sha256``: what a pinned source says about a claimed snippet.

    ``no_path`` without a path, ``no_source`` if no source has it, ``no_snippet`` for a blank claim, ``absent`` if the
    source does not hold the snippet, else ``present``. ``sources`` has one row a path.
    """
    pinned = sources.select(F.col(path).alias("_path"), F.col(text).alias("_text"))
    joined = claims.join(pinned, F.col(path) == F.col("_path"), "left")
    status = (
        F.when(F.coalesce(F.col(path), F.lit("")) == "", "no_path")
        .when(F.col("_text").isNull(), "no_source")
        .when(~_filled(F.col(snippet)), "no_snippet")
        .when(F.contains("_text", F.col(snippet)), "present")
        .otherwise("absent")
    )
    return joined.select(*claims.columns, status.alias("status"), F.sha2("_text", 256).alias("source_sha256"))
