"""Hits and near misses of the rules over syntax trees, and of the C scanner's states."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditlake.operators import source_ast, tree_rules

HITS = {
    "CRYPTO-001": ["import hashlib\nhashlib.md5(x)", "from hashlib import md5\nmd5(x)", 'import hashlib as h\nh.new("md5", x)'],
    "CRYPTO-002": ["hashlib.sha1()", 'hashlib.new("SHA1", b"")'],
    "CRYPTO-003": ["from Crypto.Cipher import DES\nx = 1\ny = DES.new(k)", "import Crypto.Cipher.DES3\n"],
    "CRYPTO-004": ["from Crypto.Cipher import AES, ARC4\ndef f():\n  return ARC4.new(k)"],
    "CRYPTO-005": ["AES.new(k, AES.MODE_ECB)", "modes.ECB()"],
    "CRYPTO-006": ['AES.new(k, AES.MODE_CBC, iv=b"")', "modes.CBC(bytes(16))"],
    "CRYPTO-007": ['AES.new(b"abcdefgh", m)', "Fernet('secret123')", "Cipher(algorithms.AES(b'abcdefgh'), m)"],
    "CRYPTO-008": ["my_token = random.randint(1, 2)", "self.salt = random.random()"],
    "CRYPTO-009": ["RSA.generate(1024)", "ec.SECT163K1()"],
    "CRYPTO-010": ["requests.get(u, verify=False)", "x = ssl.CERT_NONE", "ssl._create_unverified_context()", "requests.post(u, timeout=3, verify=False)"],
    "CRYPTO-011": ["u.password = p", "u.set_password(p)"],
    "CRYPTO-012": ["hashlib.pbkdf2_hmac('sha256', p, s, 1000)", "PBKDF2(p, s, count=5000)", "bcrypt.gensalt(rounds=4)", "hashlib.scrypt(p, salt=s, n=2**13, r=8, p=1)"],
    "CRYPTO-013": ["if password == expected: pass", "if req.token != stored_token: pass"],
}
MISSES = {
    "CRYPTO-001": ["hashlib.sha256(x)", "md5(x)", 'hashlib.new("sha256")'],
    "CRYPTO-002": ["sha1(x)", "hashlib.sha224()"],
    "CRYPTO-003": ["from Crypto.Cipher import DES\nx = 1", "DES.new(k)"],
    "CRYPTO-004": ["from Crypto.Cipher import AES\nARC4.new(k)"],
    "CRYPTO-005": ["AES.new(k, AES.MODE_GCM)", "modes.ECB(1)"],
    "CRYPTO-006": ["AES.new(k, AES.MODE_CBC, iv=os.urandom(16))", "modes.CBC(bytes(12))"],
    "CRYPTO-007": ["AES.new(key, m)", "Fernet('abc')"],
    "CRYPTO-008": ["index = random.randint(1, 2)", "token = secrets.token_hex()"],
    "CRYPTO-009": ["RSA.generate(2048)", "ec.SECP256R1()"],
    "CRYPTO-010": ["requests.get(u, verify=True)", "session.get(u, verify=False)"],
    "CRYPTO-011": ["password = p", "u.set_password(p, q)"],
    "CRYPTO-012": ["hashlib.pbkdf2_hmac('sha256', p, s, 600000)", "bcrypt.gensalt(rounds=12)", "hashlib.scrypt(p, n=2**14, r=8, p=1)", "pbkdf2_hmac('sha256', p, s, rounds)"],
    "CRYPTO-013": ["if password == other: pass", "if a == token: pass", "x = password = expected"],
}


@pytest.mark.parametrize("rule", sorted(HITS))
def test_rule_over_trees(rule):
    for text in HITS[rule]:
        assert rule in [x[0] for x in tree_rules.scan_tree(text)], text
    for text in MISSES[rule]:
        assert rule not in [x[0] for x in tree_rules.scan_tree(text)], text


def test_tree_findings_of_rows(spark):
    rows = [(1, "import hashlib\n\nhashlib.md5(\n  x)\nhashlib.md5(y)"), (2, None), (3, ""), (4, "def broken("), (5, "hashlib.md5(a); hashlib.md5(b)"), (5, "x = 1")]
    df = spark.createDataFrame(rows, "k int, code string")
    got = sorted(map(tuple, tree_rules.tree_findings(df, "k", F.col("code")).collect()))
    assert got == [(1, "CRYPTO-001", "MEDIUM", 3), (1, "CRYPTO-001", "MEDIUM", 5), (5, "CRYPTO-001", "MEDIUM", 1)]
    assert tree_rules.tree_findings(df.limit(0), "k", F.col("code")).count() == 0


def test_life_of_allocations():
    def rules(*body):
        return [(r, line) for r, _, line in source_ast.scan_c("\n".join(["int f(int a) {", *body, "}"])) if not r.startswith("c-unsafe")]

    assert rules("p = malloc(1);", "free(p);", "free(p);") == [("c-double-free", 4)]
    assert rules("p = malloc(1);", "free(p);", "p = q;", "free(p);") == []
    assert rules("p = malloc(1);") == [("c-memory-leak", 2)]
    assert rules("p = malloc(1);", "free(p);", "x = p + 1;") == [("c-memory-leak", 2), ("c-use-after-free", 4)]
    assert rules("free(p);", "p = malloc(2);", "free(p);") == []
    # a brace on the next line closes the function at once
    assert source_ast.scan_c("int f(int a)\n{\n p = malloc(1);\n}") == []
