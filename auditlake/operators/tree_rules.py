"""The thirteen rules as patterns over Python syntax trees, with metavariables and conditions on what they match.

A pattern is Python text in which ``$X`` stands for any expression (the same one everywhere in the pattern) and ``...``
for any arguments or statements. Names match as they are written or by the full name that the imports give them.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators import scan, source_ast

# The patterns of the rules and the conditions on their metavariables.
_RANDOM = "random|randint|randrange|choice|sample|uniform|gauss|triangular|getrandbits|shuffle"
_SECRET = "password|passwd|pwd|pw|hash|digest|token|secret|signature|cookie|mac"
_GIVEN = "guess|attempt|provided|input|expected|actual|received|stored"
_KEY_TEXT = r"""^(?:b|u|r|rb)?["\x27][^"\x27]{6,}["\x27]$"""
PATTERNS: dict[str, list[tuple[list[str], dict[str, str], dict[str, int]]]] = {
    "CRYPTO-001": [(["hashlib.md5(...)", 'hashlib.new("MD5", ...)', 'hashlib.new("md5", ...)'], {}, {})],
    "CRYPTO-002": [(["hashlib.sha1(...)", 'hashlib.new("SHA1", ...)', 'hashlib.new("sha1", ...)'], {}, {})],
    "CRYPTO-003": [
        (["from Crypto.Cipher import DES\n...\nDES.new(...)", "from Crypto.Cipher import DES3\n...\nDES3.new(...)", "import Crypto.Cipher.DES\n...", "import Crypto.Cipher.DES3\n..."], {}, {})
    ],
    "CRYPTO-004": [(["from Crypto.Cipher import ARC4\n...\nARC4.new(...)", "import Crypto.Cipher.ARC4\n..."], {}, {})],
    "CRYPTO-005": [(["AES.new(..., AES.MODE_ECB)", "modes.ECB()"], {}, {})],
    "CRYPTO-006": [
        (
            ['AES.new($KEY, AES.MODE_CBC, IV=b"")', 'AES.new($KEY, AES.MODE_CBC, iv=b"")', 'AES.new($KEY, AES.MODE_CFB, IV=b"")', 'AES.new($KEY, AES.MODE_OFB, IV=b"")']
            + ['modes.CBC(b"")', 'modes.CFB(b"")', 'modes.OFB(b"")', "modes.CBC(bytes(16))"],
            {},
            {},
        )
    ],
    "CRYPTO-007": [(["AES.new($KEY, ...)", "Cipher(algorithms.AES($KEY), ...)", "Fernet($KEY)"], {"KEY": _KEY_TEXT}, {})],
    "CRYPTO-008": [(["$VAR = random.$FUNC(...)"], {"VAR": "(?i).*(key|iv|token|salt|nonce|secret|password)", "FUNC": f"({_RANDOM})"}, {})],
    "CRYPTO-009": [
        (["RSA.generate(1024)", "RSA.generate(768)", "RSA.generate(512)", "ec.SECP192R1()", "ec.SECP160R1()", "ec.SECP112R1()", "ec.SECT163K1()", "ec.SECT163R2()"], {}, {})
    ],
    "CRYPTO-010": [
        (
            ["ssl.PROTOCOL_SSLv3", "ssl.PROTOCOL_SSLv2", "ssl.PROTOCOL_TLSv1", "ssl.PROTOCOL_TLSv1_1", "ssl._create_unverified_context()", "ssl.CERT_NONE", "requests.$M(..., verify=False, ...)"],
            {},
            {},
        )
    ],
    "CRYPTO-011": [(["$OBJ.password = $PW", "$OBJ.passwd = $PW", "$OBJ.pwd = $PW", "$OBJ.set_password($PW)", "$OBJ.set_passwd($PW)", "$OBJ.set_pwd($PW)"], {}, {})],
    "CRYPTO-012": [
        (["pbkdf2_hmac(..., $ITERS)", "hashlib.pbkdf2_hmac(..., $ITERS)", "PBKDF2(..., count=$ITERS)", "PBKDF2(..., $ITERS)"], {}, {"ITERS": 100_000}),
        (["bcrypt.gensalt(rounds=$COST)"], {}, {"COST": 12}),
        (["hashlib.scrypt(..., n=$N, ...)"], {}, {"N": 16_384}),
    ],
    "CRYPTO-013": [(["$LHS == $RHS", "$LHS != $RHS"], {"LHS": f"(?i).*({_SECRET}).*", "RHS": f"(?i).*({_SECRET}|{_GIVEN}).*"}, {})],
}
#: A text that breaks a rule holds one of these.
HINT = r"hashlib|Crypto\.Cipher|AES|modes\.|Fernet|random\.|RSA\.|SECP1|SECT163|ssl\.|PROTOCOL_|CERT_NONE|verify|passw|pwd|pbkdf2|PBKDF2|bcrypt|scrypt|==|!="
_META = "META_"


@dataclass
class _Pattern:
    rule: str
    nodes: list[ast.AST]
    regexes: dict[str, re.Pattern[str]]
    below: dict[str, int]
    last_name: str | None = field(default=None)


def _compile() -> tuple[dict[type, list[_Pattern]], list[_Pattern]]:
    single: dict[type, list[_Pattern]] = {}
    sequences: list[_Pattern] = []
    for rule, groups in PATTERNS.items():
        for texts, regexes, below in groups:
            for text in texts:
                # dots behind keywords say no more than dots before them, and aren't Python
                python = re.sub(r"(=[^,()]+), \.\.\.\)", r"\1)", re.sub(r"\$([A-Z]+)", rf"{_META}\1", text))
                body = ast.parse(python).body
                pattern = _Pattern(rule, body, {k: re.compile(v) for k, v in regexes.items()}, below)
                if len(body) > 1:
                    sequences.append(pattern)
                    continue
                node = body[0].value if isinstance(body[0], ast.Expr) else body[0]
                pattern.nodes = [node]
                if isinstance(node, ast.Call):
                    name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", None)
                    pattern.last_name = None if name and name.startswith(_META) else name
                single.setdefault(type(node), []).append(pattern)
    return single, sequences


_SINGLE, _SEQUENCES = _compile()


def _is_dots(node: object) -> bool:
    return isinstance(node, ast.Constant) and node.value is Ellipsis


def _text(value: object) -> str:
    return value if isinstance(value, str) else ast.unparse(value)


class _Matcher:
    """Matches patterns in one tree; ``full`` gives the full name of an imported one."""

    def __init__(self, source: str):
        self.source = source
        self.imported: dict[str, str] = {}

    def learn(self, node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            self.imported |= {a.asname: a.name for a in node.names if a.asname}
        elif isinstance(node, ast.ImportFrom) and node.module:
            self.imported |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}

    def dotted(self, node: ast.AST) -> str | None:
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None

    def full(self, name: str) -> str:
        head, dot, rest = name.partition(".")
        return self.imported.get(head, head) + dot + rest

    def bind(self, name: str, value: object, env: dict[str, object]) -> bool:
        known = env.setdefault(name, value)
        return known is value or _text(known) == _text(value)

    def node(self, pattern: ast.AST, node: ast.AST, env: dict[str, object]) -> bool:
        if isinstance(pattern, ast.Name) and pattern.id.startswith(_META):
            return self.bind(pattern.id[len(_META) :], node, env)
        if isinstance(pattern, ast.Name | ast.Attribute):
            wanted, own = self.dotted(pattern), self.dotted(node)
            if wanted and _META not in wanted:
                return own is not None and wanted in (own, self.full(own))
            if not isinstance(node, ast.Attribute) or not isinstance(pattern, ast.Attribute):
                return False
            if pattern.attr.startswith(_META):
                return self.node(pattern.value, node.value, env) and self.bind(pattern.attr[len(_META) :], node.attr, env)
            return pattern.attr == node.attr and self.node(pattern.value, node.value, env)
        if type(pattern) is not type(node):
            return False
        if isinstance(pattern, ast.Constant):
            return type(pattern.value) is type(node.value) and pattern.value == node.value
        if isinstance(pattern, ast.Call):
            return self.call(pattern, node, env)
        if isinstance(pattern, ast.Assign):
            return len(node.targets) == 1 and self.node(pattern.targets[0], node.targets[0], env) and self.node(pattern.value, node.value, env)
        if isinstance(pattern, ast.Compare):
            return len(node.ops) == 1 and type(pattern.ops[0]) is type(node.ops[0]) and self.node(pattern.left, node.left, env) and self.node(pattern.comparators[0], node.comparators[0], env)
        return ast.dump(pattern) == ast.dump(node)

    def call(self, pattern: ast.Call, node: ast.Call, env: dict[str, object]) -> bool:
        open_end = any(map(_is_dots, pattern.args))
        given = {k.arg: k.value for k in node.keywords}
        wanted = {k.arg: k.value for k in pattern.keywords}
        if not wanted.keys() <= given.keys() or not open_end and wanted.keys() != given.keys():
            return False
        if not self.node(pattern.func, node.func, env) or not self.arguments(pattern.args, node.args, env):
            return False
        return all(self.node(value, given[name], env) for name, value in wanted.items())

    def arguments(self, patterns: list[ast.expr], nodes: list[ast.expr], env: dict[str, object]) -> bool:
        if not patterns:
            return not nodes
        if not _is_dots(patterns[0]):
            return bool(nodes) and self.node(patterns[0], nodes[0], env) and self.arguments(patterns[1:], nodes[1:], env)
        for skip in range(len(nodes) + 1):
            own = dict(env)
            if self.arguments(patterns[1:], nodes[skip:], own):
                env |= own
                return True
        return False

    def holds(self, pattern: _Pattern, env: dict[str, object]) -> bool:
        for name, regex in pattern.regexes.items():
            value = env[name]
            text = ast.get_source_segment(self.source, value) if isinstance(value, ast.Constant) else _text(value)
            if not text or not regex.match(text):
                return False
        return all((n := _number(env[name])) is not None and n < most for name, most in pattern.below.items())


def _number(node: object) -> int | float | None:
    """The value of a number, or of sums, products and powers of small ones."""
    if isinstance(node, ast.Constant):
        return node.value if isinstance(node.value, int | float) and not isinstance(node.value, bool) else None
    if isinstance(node, ast.BinOp):
        a, b = _number(node.left), _number(node.right)
        if a is None or b is None:
            return None
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Pow) and 0 <= b <= 64 and abs(a) <= 1024:
            return a**b
        if isinstance(node.op, ast.LShift) and isinstance(a, int) and isinstance(b, int) and 0 <= b <= 64:
            return a << b
    return None


def _blocks(tree: ast.AST) -> Iterator[list[ast.stmt]]:
    for node in ast.walk(tree):
        for name in ("body", "orelse", "finalbody"):
            block = getattr(node, name, None)
            if isinstance(block, list) and block and isinstance(block[0], ast.stmt):
                yield block


def _imports(pattern: ast.stmt, node: ast.stmt) -> bool:
    """The statement imports at least what the pattern does."""
    return type(pattern) is type(node) and getattr(pattern, "module", None) == getattr(node, "module", None) and {a.name for a in pattern.names} <= {a.name for a in node.names}


def scan_tree(code: str | None) -> list[source_ast.Found]:
    """(rule, severity, line) of Python text by the thirteen rules, each rule once a line; none if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    matcher, found = _Matcher(code or ""), set()
    nodes = list(ast.walk(tree))
    for node in nodes:
        matcher.learn(node)
    for node in nodes:
        patterns = _SINGLE.get(type(node))
        if not patterns:
            continue
        last = None
        if isinstance(node, ast.Call):
            name = matcher.dotted(node.func)
            last = {name.rpartition(".")[2], matcher.full(name).rpartition(".")[2]} if name else {getattr(node.func, "attr", "")}
        for pattern in patterns:
            if last is not None and pattern.last_name and pattern.last_name not in last:
                continue
            env: dict[str, object] = {}
            if matcher.node(pattern.nodes[0], node, env) and matcher.holds(pattern, env):
                found.add((pattern.rule, node.lineno))
    if matcher.imported or any(isinstance(n, ast.Import) for n in nodes):
        for block in _blocks(tree):
            for at, statement in enumerate(block):
                if not isinstance(statement, ast.Import | ast.ImportFrom):
                    continue
                for pattern in _SEQUENCES:
                    if not _imports(pattern.nodes[0], statement):
                        continue
                    rest = pattern.nodes[2:]
                    if not rest or any(matcher.node(rest[0].value, inner, {}) for after in block[at + 1 :] for inner in ast.walk(after)):
                        found.add((pattern.rule, statement.lineno))
    return [(rule, scan.RULES[rule][2], line) for rule, line in sorted(found, key=lambda x: (x[1], x[0]))]


def tree_findings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, rule_id, severity, line) of Python text by the rules over syntax trees; null text has none.

    Only texts that hold a literal part of some rule reach a Python worker.
    """
    rows = df.select(F.col(key), text.alias("_text")).where(F.col("_text").rlike(HINT))
    return source_ast.findings(rows, key, F.col("_text"), scan_tree)
