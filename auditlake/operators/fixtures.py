"""Rule fixtures: snippets that show a rule or its mitigation, the gates they must pass, and why a finding is rejected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import lines

# What a rule fires on, what mitigates it, and why a hit may be harmless, in order.
FIRES = {
    "CRYPTO-001": r"""hashlib\.md5\s*\(|hashlib\.new\(\s*['"](?:md5|MD5)['"]""",
    "CRYPTO-002": r"""hashlib\.sha1\s*\(|hashlib\.new\(\s*['"](?:sha1|SHA1)['"]""",
    "CRYPTO-003": r"\bDES3?\.new\s*\(|Crypto\.Cipher\.DES3?\b",
    "CRYPTO-004": r"\bARC4\.new\s*\(|Crypto\.Cipher\.ARC4\b",
    "CRYPTO-005": r"AES\.MODE_ECB|modes\.ECB\s*\(",
    "CRYPTO-009": r"RSA\.generate\(\s*(?:512|768|1024)\b|SECP192R1|SECP160R1|SECP112R1|SECT163K1|SECT163R2",
    "CRYPTO-010": r"ssl\.(?:PROTOCOL_SSLv2|PROTOCOL_SSLv3|PROTOCOL_TLSv1_1|PROTOCOL_TLSv1(?:[^_0-9]|$))|_create_unverified_context|ssl\.CERT_NONE|verify\s*=\s*False",
}
RANDOM_CALL = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*random\.(\w+)\s*\("
RANDOM_FUNCTIONS = ["random", "randint", "randrange", "choice", "sample", "uniform", "gauss", "triangular", "getrandbits", "shuffle"]
SECURITY_NAME = r"(?i)^.*(key|iv|token|salt|nonce|secret|password)"
MITIGATED = {
    "CRYPTO-001": r"(?i)sha-?(?:256|384|512|3)|blake2|argon2|scrypt|pbkdf2|bcrypt",
    "CRYPTO-002": r"(?i)sha-?(?:256|384|512|3)|blake2|argon2|scrypt|pbkdf2|bcrypt",
    "CRYPTO-003": r"\bAES\b|ChaCha20",
    "CRYPTO-004": r"\bAES\b|ChaCha20",
    "CRYPTO-005": r"\b(?:GCM|CTR|CBC|CFB|OFB|EAX|CCM|SIV)\b",
    "CRYPTO-008": r"\bos\.urandom\b|secrets\.|SystemRandom",
    "CRYPTO-009": r"\b(?:2048|3072|4096)\b|SECP(?:256|384|521)|CURVE25519|X25519|ED25519",
    "CRYPTO-010": r"create_default_context|verify\s*=\s*True|CERT_REQUIRED|PROTOCOL_TLSv1_[23]|PROTOCOL_TLS_CLIENT",
}
HARMLESS = [
    ("not_for_security", r"usedforsecurity=False"),
    ("modern_hash", r"(?i)sha(256|384|512|3)"),
    ("modern_cipher", r"\b(AES|ChaCha20)\b"),
    ("modern_tls", r"gnutls|modern"),
    ("verified_tls", r"create_default_context|verify\s*=\s*True"),
    ("strong_key", r"(?i)SECP(256|384|521)|bits\s*=\s*(2048|3072|4096)|key_size\s*=\s*(2048|3072|4096)"),
    ("secure_random", r"os\.urandom|secrets\.|SystemRandom"),
]
MARK = r"^\s*#\s*(deepruleid|ruleid|ok)\s*:\s*([A-Za-z0-9_.\-]+)\s*$|^\s*#\s*ok\s*$"


def fires(rule: Column, code: Column) -> Column:
    """Whether a rule would flag a snippet; false for rules without a gate."""
    out = F.lit(False)
    for name, pattern in FIRES.items():
        out = F.when(rule == name, code.rlike(pattern)).otherwise(out)
    call = F.regexp_extract(code, RANDOM_CALL, 2).isin(RANDOM_FUNCTIONS) & F.regexp_extract(code, RANDOM_CALL, 1).rlike(SECURITY_NAME)
    return F.coalesce(F.when(rule == "CRYPTO-008", call).otherwise(out), F.lit(False))


def shows_mitigation(rule: Column, code: Column) -> Column:
    """Whether a snippet shows the substitute that a reviewer would recommend for a rule."""
    out = F.lit(False)
    for name, pattern in MITIGATED.items():
        out = F.when(rule == name, code.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def gate(rule: Column, code: Column) -> Column:
    """``positive`` for a snippet that its rule fires on, ``negative`` for one that shows the mitigation, else ``none``."""
    return F.when(fires(rule, code), "positive").when(shows_mitigation(rule, code), "negative").otherwise("none")


def harmless_reason(rule: Column, code: Column) -> Column:
    """Why a hit is a false positive: the first reason that the snippet shows, else ``other``; null for other rules."""
    out = F.lit("other")
    for name, pattern in reversed(HARMLESS):
        out = F.when(code.rlike(pattern), name).otherwise(out)
    return F.when(rule.isin(list(MITIGATED)), out)


def without_marks(code: Column) -> Column:
    """A text without its ``ruleid`` and ``ok`` lines."""
    return F.array_join(F.filter(lines(code), lambda x: ~x.rlike(MARK)), "\n")


def wrapped(code: Column) -> Column:
    """A snippet as the body of a function, each line that isn't blank indented."""
    body = F.transform(lines(code), lambda x: F.when(x.rlike(r"^\s*$"), x).otherwise(F.concat(F.lit("    "), x)))
    return F.concat(F.lit("def process_request():\n"), F.array_join(body, "\n"))
