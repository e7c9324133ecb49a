"""Matching, scoring and ranking of vulnerability candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import cwe, lines, path_kind
from auditlake.operators.dataset import RULE_CWE, TARGET_CWES

# Package lists, rule hints, and the words of crypto code.
WATCHLIST = [
    "cryptography", "pycryptodome", "pycryptodomex", "pyjwt", "python-jose", "paramiko", "requests", "urllib3", "django", "passlib", "python-rsa",
    "rsa", "itsdangerous", "pyopenssl", "ecdsa", "pynacl", "argon2-cffi", "bcrypt", "scrypt", "authlib", "josepy", "certifi", "tornado", "aiohttp",
    "flask", "werkzeug", "oauthlib", "fido2",
]
CORE_PACKAGES = [
    "authlib", "bcrypt", "cryptography", "ecdsa", "itsdangerous", "josepy", "jwt", "keyring", "m2crypto", "nacl", "oauthlib", "oscrypto", "paramiko",
    "passlib", "pycryptodome", "pycryptodomex", "pyjwt", "pynacl", "pyopenssl", "python-jose", "python-rsa", "rsa", "scrypt", "simple-crypt",
    "tornado", "webauthn", "xmlsec",
]
SECONDARY_PACKAGES = [
    "aiohttp", "asyncssh", "certifi", "django", "fastapi", "flask", "httplib2", "httpx", "paramiko", "pycurl", "requests", "starlette", "twisted",
    "urllib3", "werkzeug",
]
RULE_HINT = {
    "CWE-329": "CRYPTO-006",
    "CWE-321": "CRYPTO-007",
    "CWE-338": "CRYPTO-008",
    "CWE-326": "CRYPTO-009",
    "CWE-295": "CRYPTO-010",
    "CWE-256": "CRYPTO-011",
    "CWE-916": "CRYPTO-012",
    "CWE-208": "CRYPTO-013",
}
TEXT_HINT = [(r"\bmd5\b", "CRYPTO-001"), (r"\bsha-?1\b", "CRYPTO-002"), (r"\b(?:3des|des)\b", "CRYPTO-003"), (r"\brc4\b", "CRYPTO-004"), (r"\becb\b", "CRYPTO-005")]
CRYPTO_API = r"\b(hashlib|hmac|secrets|ssl|pyjwt|jwt|cryptography|Crypto|Cryptodome|pycryptodome|passlib|rsa|ecdsa|nacl|bcrypt|argon2|Fernet|AES|DES|MD5|SHA1|sha1|md5|random|urandom|getrandbits|Token|JWT|verify|certificate|cert_verify|verify_mode|check_hostname|load_pem|salt|nonce|iv|key|token|signature|encrypt|decrypt)\b"
WEAK_PRIMITIVE = r"\b(md5|sha1|random\.|Random\(|ECB|DES|RC4|unverified|verify=False|check_hostname=False)\b"
CODE_HOST = r"^https?://(?:www\.)?[^/]+/([^/]+)/([^/#?]+)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def resolved_cwe() -> Column:
    """The row's own CWE, else the first target one of ``cwe_all``, else its first; empty if there is none."""
    every = F.filter(F.transform(F.coalesce("cwe_all", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    target = F.filter(every, lambda x: x.isin(TARGET_CWES))
    own = F.nullif(F.upper(F.trim("cwe")), F.lit(""))
    return F.coalesce(own, F.get(target, 0), F.get(every, 0), F.lit(""))


def record_cwes() -> Column:
    """The distinct normal CWE identifiers of ``cwe`` and ``cwe_all``, in order."""
    every = F.concat(F.array(_text("cwe")), F.coalesce("cwe_all", F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, cwe), lambda x: x != ""))


def match_outcome(packages: Column, cwes: Column, text: Column, keyword: str, withdrawn: Column, watch: list[str] = WATCHLIST, malicious: Column | None = None, cwe_only: bool = False) -> Column:
    """(outcome, reasons) of an advisory: ``malicious``, ``withdrawn``, ``no_package``, ``matched`` or ``out_of_scope``.

    With ``cwe_only`` neither a watched package nor a keyword is enough.
    """
    hit = F.array_sort(F.array_intersect(cwes, F.array(*map(F.lit, TARGET_CWES))))
    watched = F.array_sort(F.filter(packages, lambda p: F.lower(p).isin(watch)))
    word = F.regexp_extract(text, f"(?i){keyword}", 0)
    reasons = F.array_compact(
        F.array(
            F.when(F.size(hit) > 0, F.concat(F.lit("cwe:"), F.array_join(hit, ","))),
            F.when(F.size(watched) > 0, F.concat(F.lit("watchlist:"), F.array_join(watched, ","))),
            F.when(word != "", F.concat(F.lit("keyword:"), F.regexp_replace(F.lower(word), r"\s+", "_"))),
        )
    )
    enough = F.size(hit) > 0 if cwe_only else F.size(reasons) > 0
    outcome = F.when(malicious if malicious is not None else F.lit(False), "malicious").when(withdrawn, "withdrawn").when(F.size(packages) == 0, "no_package").when(enough, "matched").otherwise("out_of_scope")
    return F.struct(outcome.alias("outcome"), reasons.alias("reasons"))


def screening_score(both_parse: Column | None = None) -> Column:
    """The additive review score of a candidate. ``both_parse`` adds the terms for code that parses, if given."""
    vuln, fixed = _text("code_vuln"), _text("code_fixed")
    blank = lambda c: c.rlike(r"^\s*$")
    pair = ~blank(vuln) & ~blank(fixed)
    count = F.size(F.filter(lines(vuln), lambda x: ~x.rlike(r"^\s*$")))
    kind, found = path_kind(F.col("file_path")), resolved_cwe()
    reasons = F.coalesce("match_reasons", F.array().cast("array<string>"))
    terms = [
        F.when(_text("fix_commit") != "", 3),
        F.when(pair, 4),
        F.when(pair, F.when(both_parse, 2).otherwise(-3)) if both_parse is not None else F.lit(0),
        F.when(~blank(vuln), F.when(count.between(4, 120), 2).when(count < 4, -2).otherwise(-1)),
        F.when(kind == "production", 3).when(kind.isin("test", "conftest"), -4),
        F.when(F.concat(vuln, F.lit("\n"), fixed).rlike(CRYPTO_API), 2),
        F.when(vuln.rlike(WEAK_PRIMITIVE), 2),
        F.when(_text("cve_id") != "", 2),
        F.when(F.lower(_text("package")).isin(WATCHLIST), 1),
        F.when(found.isin(TARGET_CWES), 2).when(found != "", 1),
        F.when(F.exists(reasons, lambda r: r.startswith("keyword:")), 1),
    ]
    score = F.lit(0)
    for term in terms:
        score = score + F.coalesce(term, F.lit(0))
    return score


def fetch_rank() -> Column:
    """(score, tier) of a candidate in the queue of commits to fetch."""
    hits = F.array_intersect(record_cwes(), F.array(*map(F.lit, TARGET_CWES)))
    reasons = F.coalesce("match_reasons", F.array().cast("array<string>"))
    keyword = F.exists(reasons, lambda r: r.startswith("keyword:"))
    watch = F.exists(reasons, lambda r: r.startswith("watchlist:"))
    package = F.lower(F.trim(_text("package")))
    hit = F.size(hits) > 0
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        points(hit, 100) + points(F.size(hits) > 1, 10) + points(keyword, 30) + F.when(package.isin(CORE_PACKAGES), 40).when(package.isin(SECONDARY_PACKAGES), 15).otherwise(0)
        + points(watch, 5) + points(_text("repo_url").rlike(CODE_HOST), 15) + points(F.length(F.trim(_text("fix_commit"))) >= 7, 10) - points(~hit & ~keyword, 50)
    )
    tier = F.when(hit & keyword, "P0").when(hit, "P1").when(keyword & package.isin(CORE_PACKAGES), "P2").otherwise("P3")
    return F.struct(score.alias("score"), tier.alias("tier"))


def suggested_rule(cwes: Column, text: Column) -> Column:
    """A rule by the first CWE that hints at one; for CWE-327 by the words of the text; else empty."""
    hints = F.create_map(*(F.lit(x) for pair in RULE_HINT.items() for x in pair))
    by_cwe = F.get(F.filter(F.transform(cwes, lambda c: F.try_element_at(hints, c)), lambda x: x.isNotNull()), 0)
    by_text = F.lit("")
    for pattern, rule in reversed(TEXT_HINT):
        by_text = F.when(F.lower(text).rlike(pattern), rule).otherwise(by_text)
    return F.coalesce(by_cwe, F.when(F.array_contains(cwes, "CWE-327"), by_text), F.lit(""))


def first_failing(checks: dict[str, Column]) -> Column:
    """The name of the first check that does not hold; null if all do."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def csv_outcomes(df: DataFrame, cwes: Column, crypto: list[str] | None = None, label: Column | None = None) -> DataFrame:
    """(outcome, n): rows of a code-pair CSV by the first filter they fail, ``kept`` for none.

    With ``crypto``, a wider set of CWEs is asked for first and the target ones last; with ``label``, it must be 1.
    """
    text = lambda c: F.trim(_text(c))
    among = lambda names: F.size(F.array_intersect(cwes, F.array(*map(F.lit, names)))) > 0
    checks = {"no_crypto_cwe": among(crypto)} if crypto else {"no_target_cwe": among(TARGET_CWES)}
    if label is not None:
        checks["label"] = F.trim(label).isin("1", "1.0")
    checks |= {"blank_side": (text("code_vuln") != "") & (text("code_fixed") != ""), "identical": F.col("code_vuln") != F.col("code_fixed")}
    if crypto:
        checks["no_target_cwe"] = among(TARGET_CWES)
    return df.select(F.coalesce(first_failing(checks), F.lit("kept")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def collected_cwes(values: list[Column], rule: Column) -> Column:
    """The distinct CWEs of several fields in order, before them those that the rule stands for and no field has."""
    own = F.array_distinct(F.filter(F.transform(F.array(*values), lambda x: cwe(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    ruled = F.array().cast("array<string>")
    for name, cwes in RULE_CWE.items():
        ruled = F.when(F.upper(F.trim(rule)) == name, F.array(*map(F.lit, reversed(sorted(cwes))))).otherwise(ruled)
    return F.concat(F.array_except(ruled, own), own)


# Folders that hold no implementation, and words of crypto files.
NON_IMPLEMENTATION = [
    "test", "tests", "testing", "testdata", "fixtures", "fixture", "examples", "example", "docs", "doc", "benchmarks", "benchmark", "samples",
    "sample",
]
PATH_TERMS = [
    "crypt", "cipher", "hash", "key", "token", "sign", "secret", "ssl", "tls", "jwt", "rsa", "auth", "password", "random", "cert",
]


def file_score(path: Column, patch: Column, package: Column) -> Column:
    """How likely a changed file is the implementation of a fix; -10000 for tests, examples and documents."""
    low = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    leaf = F.regexp_extract(low, r"([^/]*)$", 1)
    folders = F.slice(F.split(low, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(low, "/")) - 1))
    outside = (low == "") | F.exists(folders, lambda x: x.isin(NON_IMPLEMENTATION)) | leaf.rlike(r"^test_|_test\.py$|^conftest\.py$|fixture|example|benchmark")
    squeezed = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    hits = sum((F.when(leaf.contains(t), 1).otherwise(0) for t in PATH_TERMS), F.lit(0))
    changed = F.size(F.filter(lines(F.coalesce(patch, F.lit(""))), lambda x: x.rlike(r"^(\+(?!\+\+)|-(?!--))")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        points((F.length(squeezed(package)) >= 3) & squeezed(path).contains(squeezed(package)), 8) + points(low.rlike(r"(^|/)(src|lib|libs)/"), 4) + points(low.rlike(r"^(src|lib|libs)/"), 2)
        + F.when(hits > 0, F.least(hits, F.lit(3)) + 4).otherwise(0) + F.least((changed / 10).cast("int"), F.lit(4)) + points(F.length(low) <= 80, 1)
    )
    return F.when(outside, -10_000).otherwise(score)
