"""Core operators against brute force and pinned cases."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlake.functions import hashing, jsons, text
from auditlake.operators import candidates, dataset, graph, metrics, relational, scan, source_ast
from auditlake.plans.skew import hot_keys, two_level_agg


def _values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_normal_forms_differ(spark):
    df = spark.createDataFrame([("A b",), ("a  B\t",), ("a b",), ("",), (None,), ("x\r\ny\u2028z\n",)], "t string")
    assert _values(df, text.no_space(F.col("t"))) == ["Ab", "aB", "ab", "", None, "xyz"]
    assert _values(df, text.collapsed(F.col("t"))) == ["a b", "a b", "a b", "", None, "x y z"]
    assert _values(df, text.lines(F.col("t"))) == [["A b"], ["a  B\t"], ["a b"], [], [], ["x", "y", "z"]]
    assert _values(df, text.digest(F.col("t")))[3:5] == ["", ""]


def test_text_functions(spark):
    df = spark.createDataFrame([("Acme/Kit v2!", "cwe-79", "CWE-1333; cwe 5, CWE-79,CWE-1333", "tests/test_a.py", "../x y.py"), (None, None, None, None, None), ("", "none", "", "src/conftest.py", "")], "a string, b string, c string, d string, e string")
    assert _values(df, text.slug(F.col("a"))) == ["acme-kit-v2", None, ""]
    assert _values(df, text.cwe(F.col("b"))) == ["CWE-079", "", ""]
    assert _values(df, text.cwe_list(F.col("c"))) == [["CWE-1333", "CWE-79"], None, []]
    assert _values(df, text.path_kind(F.col("d"))) == ["test", "unknown", "conftest"]
    assert _values(df, text.language(F.col("d"))) == ["python", "text", "python"]
    assert _values(df, text.safe_name(F.col("e"))) == ["x_y.py", "snippet.txt", "snippet.txt"]
    assert _values(df, text.estimated_tokens(F.lit("abcd中"))) == [2, 2, 2]
    assert _values(df, text.bounded(F.lit("abcdef"), 3, "!")) == ["abc!"] * 3
    patch = F.lit("@@ -1,2 +1,2 @@\n same\n-old\n+new\n\\ No newline at end of file")
    assert _values(df, text.patch_side(patch, "-"))[0] == "same\nold" and _values(df, text.patch_side(patch, "+"))[0] == "same\nnew"


def test_hash_buckets_have_known_values(spark):
    df = spark.createDataFrame([("repo-x",)], "k string")
    assert df.select(hashing.bucket_64(F.col("k")), hashing.bucket_256(F.col("k"))).first()[:] == (35, 84)
    assert abs(df.select(hashing.sample_value(F.lit("id1"), "seed")).first()[0] - 0.8940107528519547) < 1e-12


def test_best_effort_json(spark):
    rows = ['{"cwe": "CWE-1"}', 'Sure:\n```json\n{"cwe": "CWE-2"}\n```', '{"vulnerable": true, "cwe": "CWE-3", "expl', "none", None, '[{"cwe": "x"}]']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert _values(df, jsons.best_effort_field(F.col("t"), "cwe"))[:5] == ["CWE-1", "CWE-2", "CWE-3", None, None]
    keys = spark.createDataFrame([('{"a": null}',), ("bad",)], "t string")
    assert _values(keys, jsons.missing_keys(F.col("t"), ["a", "b"])) == [["b"], ["a", "b"]]


def test_hot_keys_and_two_levels(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4000).cast("string")).alias("k"))
    assert [(r["k"], r["hot_rows"]) for r in hot_keys(df, "k", floor=5000).collect()] == [("hot", 10_000)]
    got = two_level_agg(df, "k", "id", [F.count("*").alias("n"), F.min("id").alias("least")], [F.sum("n").alias("n"), F.min("least").alias("least")])
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert hot_keys(df.limit(0), "k").count() == 0


def test_first_last_owner_and_conflicts(spark):
    df = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "k", "a"), (4, "j", None), (5, "j", "x"), (6, None, "y")], "o int, k string, v string")
    assert sorted(_values(relational.first_wins(df, ["k"], "o"), "o")) == [1, 4, 6]
    assert sorted(_values(relational.last_wins(df, ["k"], "o"), "o")) == [3, 5, 6]
    assert sorted(map(tuple, relational.owners(df, "k", "o", "o").collect())) == [(2, 1), (3, 1), (5, 4)]
    conflicts = relational.conflicts_with_first(df, ["k"], F.col("v"), "o")
    assert sorted((r["o"], r["first_value"], r["own_value"]) for r in conflicts.collect()) == [(2, "a", "b"), (5, None, "x")]
    assert {r["k"]: r["values_seen"] for r in relational.conflicting_keys(df, ["k"], F.col("v")).collect()} == {"k": 2}


def test_set_operations(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (4, "z")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(a, b, "k").collect())) == [(1, "x"), (2, None), (3, None), (4, "z")]
    assert sorted(map(tuple, relational.symmetric_difference(a, b, "k").collect())) == [(1, "left", 1), (3, "left", 1), (4, "right", 1)]
    assert sorted(map(tuple, relational.multiset_parity(a.union(a), a, "k").collect())) == [(1, 2, 1), (2, 2, 1), (3, 2, 1)]
    assert sorted(_values(relational.anti_either(a, [b, b.select(F.lit("x").alias("v"))], ["k", "v"]), "k")) == [3]
    united = relational.union_sources({"a": a, "b": b.select("k")})
    assert united.count() == 5 and united.where("source_name = 'b' and v is not null").count() == 0


def test_greedy_two_keys_is_sequential(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, *(f"a{j}" for j in range(40))]), f"c{r.randint(0, 60)}") for i in range(300)]
    seen_a, seen_c, want = set(), set(), []
    for o, a, c in rows:
        if a in seen_a or c in seen_c:
            continue
        if a is not None:
            seen_a.add(a)
        seen_c.add(c)
        want.append(o)
    df = spark.createDataFrame(rows, "o int, a string, c string")
    assert sorted(_values(graph.greedy_two_keys(df, "o", "a", "c"), "o")) == want
    assert graph.greedy_two_keys(df.limit(0), "o", "a", "c").count() == 0


def test_connected_groups_and_strongest(spark):
    rows = [(1, "A", None, 5), (2, "A", "c", 9), (3, None, "c", 9), (4, "D", None, 1), (5, None, None, 1)]
    df = spark.createDataFrame(rows, "o int, a string, c string, s int")
    keys = [F.col("a"), F.col("c")]
    assert dict(map(tuple, graph.connected_groups(df, "o", keys).collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert sorted(_values(graph.keep_strongest(df, "o", keys, F.col("s")), "o")) == [2, 4, 5]


def test_fold_merge(spark):
    rows = [(1, "k", "x", None), (2, "k", None, "long enough to win"), (3, "k", None, "s"), (4, "j", "aa", "b"), (5, "j", "b", "aa"), (6, None, "q", "q")]
    df = spark.createDataFrame(rows, "o int, k string, a string, b string")
    got = {r["k"]: (r["o"], r["a"], r["b"]) for r in relational.fold_merge(df, "k", "o").collect()}
    assert got == {"k": (2, "x", "long enough to win"), "j": (4, "aa", "b")}


def test_windows(spark):
    df = spark.createDataFrame([("f", 1, "r1"), ("f", 2, None), ("f", 3, "r2"), ("g", 1, None)], "f string, n int, v string")
    assert _values(df.orderBy("f", "n"), relational.carry_forward("v", "f", "n")) == ["r1", "r1", "r2", None]
    assert _values(df.orderBy("f", "n"), relational.forward_as_of("f", "n", F.col("v").isNotNull())) == [3, 3, None, None]
    assert sorted(_values(relational.running_ids(df, "f", "n", "x"), "new_id")) == ["x-f-01", "x-f-02", "x-f-03", "x-g-01"]
    held = relational.stratified_holdout(df, "f", "n", "1", 0.3)
    assert {r["f"]: r["c"] for r in held.where("held_out").groupBy("f").agg(F.count("*").alias("c")).collect()} == {"f": 1, "g": 1}
    top = relational.top_counts(spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, "a"), (5, "c")], "o int, v string"), "v", "o", 2)
    assert [tuple(r)[:2] for r in top.collect()] == [("a", 2), ("b", 2)]


def test_enclosing_picks(spark):
    points = spark.createDataFrame([("f", 5), ("f", 99)], "f string, at int")
    ranges = spark.createDataFrame([("f", "outer", 1, 20, 2), ("f", "inner", 4, 8, 1), ("f", "other", 30, 40, 0)], "f string, name string, start int, end int, position int")
    for pick, name in (("outermost", "outer"), ("innermost", "inner"), ("first", "inner")):
        assert [(r["at"], r["name"]) for r in relational.enclosing(points, ranges, "f", "at", "start", "end", pick).collect()] == [(5, name)]


LINES = {
    "h = hashlib.md5(x)": ["CRYPTO-001"], "hashlib.new('SHA-1')": ["CRYPTO-002"], "c = DES3.new(k)": ["CRYPTO-003"], "ARC4.new(k)": ["CRYPTO-004"], "AES.MODE_ECB": ["CRYPTO-005"], 'iv = b"0000"': ["CRYPTO-006"],
    'secret = "abcdefgh"': ["CRYPTO-007"], 'secret = "abc"': [], "token_x = random.choice(y)": ["CRYPTO-008"], "RSA.generate(2047)": ["CRYPTO-009"], "RSA.generate(2048)": [], "get(u, verify=False)": ["CRYPTO-010"],
    "u.password = p": ["CRYPTO-011"], "u.password == 1": [], "if token == given:": ["CRYPTO-013"], "pbkdf2_hmac('x', p, s, 99999)": ["CRYPTO-012"], "pbkdf2_hmac('x', p, s, 100000)": [], "bcrypt.gensalt(rounds=11)": ["CRYPTO-012"],
    "bcrypt.gensalt(rounds=12)": [], "scrypt(p, n=16383)": ["CRYPTO-012"], "scrypt(p, n=16384)": [], "# hashlib.md5(x)": [], "  * RC4": [], "": [], "   ": [],
}


def test_line_rules(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, t string")
    found: dict[int, list[str]] = {}
    for r in scan.line_findings(df, "t", "i").collect():
        found.setdefault(r["i"], []).append(r["rule_id"])
    assert {line: sorted(found.get(i, [])) for i, line in enumerate(LINES)} == LINES
    assert scan.line_findings(df.limit(0), "t", "i").count() == 0


def test_context_and_fixes(spark):
    code = "\n".join(f"l{i}" for i in range(1, 7))
    df = spark.createDataFrame([(1, 1, code), (2, 6, code), (3, 1, "only")], "k int, line int, code string")
    assert _values(df.orderBy("k"), scan.context(F.col("code"), F.col("line"), 3, 4)) == ["l1\nl2\nl3\nl4\nl5", "l3\nl4\nl5\nl6", "only"]
    fixes = spark.createDataFrame([(1, "a = hashlib.md5(x)  \nb = get(u, verify=False)\nscrypt(p, n=99999)\nfine")], "k int, code string")
    assert [r["after"] for r in scan.fix_changes(fixes, "code", "k").orderBy("line").collect()] == ["a = hashlib.sha256(x)", "b = get(u, verify=True)", "scrypt(p, n=16384)"]


def test_findings_dedupe_risk_and_gate(spark):
    rows = [("f", 1, "R", "MEDIUM", 0), ("f", 1, "R", "HIGH", 1), ("f", 1, "R", "HIGH", 2), ("g", 1, "R", "LOW", 0)]
    df = spark.createDataFrame(rows, "file string, line int, rule_id string, severity string, engine int")
    kept = scan.keep_most_severe(df, ["file", "line", "rule_id"], "engine")
    assert sorted((r["file"], r["engine"]) for r in kept.collect()) == [("f", 1), ("g", 0)]
    risk = scan.risk_score(df, "file", F.lit("CONFIRMED"), F.lit(0.9))
    assert {r["file"]: (r["score"], r["level"]) for r in risk.collect()} == {"f": (56, "HIGH"), "g": (4, "LOW")}
    assert {r["severity"]: r["n"] for r in scan.severity_summary(df).collect()} == {"INFO": 0, "LOW": 1, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 0}
    assert scan.exceeds(df, "CRITICAL").first()["exceeded"] is False and scan.exceeds(df, "CRITICAL", {"HIGH": 1}).first()["exceeded"] is True


def test_annotations_and_ranges(spark):
    code = "# ok\n# ruleid: R-1\nx = 1\n# ok\n# deepruleid: R-2\n# ok: R-3"
    df = spark.createDataFrame([(1, code)], "k int, code string")
    got = [(r["line"], r["kind"], r["rule"]) for r in scan.annotations(df, "code", "k").orderBy("line").collect()]
    assert got == [(2, "ruleid", "R-1"), (4, "ok", "R-1"), (5, "ruleid", "R-2"), (6, "ok", "R-3")]
    body = spark.createDataFrame([(1, "def a():\n    x\n\n    def b():\n        y\n    z\nw")], "k int, code string")
    assert [tuple(r) for r in scan.function_ranges(body, "code", "k").orderBy("start_line").collect()] == [(1, "a", 1, 6), (1, "b", 4, 5)]
    assert source_ast.functions("@d\ndef a():\n    class B:\n        async def c(self): pass\n") == [("a", 1, 4), ("a.B.c", 4, 4)]


def test_python_scanner():
    code = "import os as o\nfrom pickle import loads as ld\no.system('x')\nld(b)\nimport subprocess\nsubprocess.run(c, shell=True)\napi_token = 'x'\nget(u, verify=False)\no.chmod(p, 0o777)\ncur.execute(f'{x}')\ntry:\n    pass\nexcept:\n    pass\ntry:\n    pass\nexcept Exception:\n    pass\ndef f():\n    h = open(p)\n"
    assert {r for r, _, _ in source_ast.scan_python(code)} == {
        "python-dangerous-os-system", "python-deserialization-pickle-loads", "python-subprocess-shell", "python-hardcoded-secret", "python-no-tls-verify", "python-world-writable", "python-sql-injection", "python-bare-except", "python-swallowed-exception", "python-resource-leak",
    }
    assert source_ast.scan_python("def f(:") == [("python-syntax-error", "INFO", 0)]
    assert source_ast.scan_python(None) == []


def test_c_scanner():
    code = 'void f(char *s) {\n  char *p = malloc(3);\n  gets(s); // gets(s)\n  printf(s);\n  printf("%s", s);\n  free(p);\n  free(p);\n}\nvoid g(int n) {\n  int *q = malloc(n);\n}\nvoid h(int n) {\n  char *r = malloc(n);\n  free(r);\n  use(r);\n}\n'
    found = source_ast.scan_c(code)
    assert ("c-unsafe-api-gets", "CRITICAL", 3) in found and ("c-format-string", "HIGH", 4) in found and ("c-double-free", "CRITICAL", 7) in found and ("c-memory-leak", "MEDIUM", 10) in found and ("c-use-after-free", "CRITICAL", 15) in found
    assert sum(r == "c-format-string" for r, _, _ in found) == 1
    assert [a.strip() for a in source_ast.call_arguments('a, f(b, c), "x,)" ) rest')] == ["a", "f(b, c)", '"x,)"']


def test_metrics(spark):
    rows = [(True, True, "CWE-1", "CWE-10"), (True, True, None, "CWE-2"), (True, False, "CWE-1", None), (False, True, None, None), (None, None, None, None), (False, False, None, None)]
    df = spark.createDataFrame(rows, "t boolean, p boolean, tc string, pc string")
    got = metrics.detect_metrics(df, F.col("t"), F.col("p"), F.col("tc"), F.col("pc")).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["cwe_total"], got["cwe_hits"]) == (2, 1, 1, 2, 1, 1)
    nothing = metrics.detect_metrics(df.limit(0), F.col("t"), F.col("p"), F.col("tc"), F.col("pc")).first()
    assert nothing["recall"] == 0.0 and nothing["cwe_accuracy"] is None
    verdicts = spark.createDataFrame([("Confirm", "confirm"), ("Confirm", None), ("Reject", "CONFIRM"), (None, "Reject")], "t string, p string")
    triage = metrics.triage_metrics(verdicts, F.col("t"), F.col("p")).first()
    assert (triage["gt_confirm"], triage["gt_reject"], triage["confirm_recall"], triage["fpr"]) == (2, 2, 0.5, 0.5)
    assert metrics.probe_summary(verdicts.limit(0), F.col("t"), F.col("p")).first()["accuracy"] is None
    one = metrics.timing_stats(spark.createDataFrame([(1.0,)], "v double"), "v").first()
    assert one["deviation"] is None and one["mean"] == 1.0


def test_chat_round_trip(spark):
    schema = "id int, lang string, code string, finding string, label struct<cwe:string,severity:string,verdict:string,explanation:string,patch:string>"
    df = spark.createDataFrame([(1, "go", "x\ny", "[R] m", ("CWE-1", None, "Confirm", "e", None)), (2, None, None, "", ("", "", "Reject", "", ""))], schema)
    chat = df.select("id", dataset.to_chat(df, "triage").alias("ms"))
    back = {r["id"]: r for r in dataset.from_chat(chat.where("ms is not null"), "id", "ms").collect()}
    assert back.keys() == {1} and (back[1]["task"], back[1]["language"], back[1]["finding"], back[1]["code"]) == ("triage", "go", "[R] m", "x\ny")
    assert json.loads(back[1]["answer"]) == {"cwe": "CWE-1", "verdict": "Confirm", "explanation": "e"}
    plain = spark.createDataFrame([(1, [("user", "hello")])], "id int, ms array<struct<role:string,content:string>>")
    assert tuple(dataset.from_chat(plain, "id", "ms").first())[1:5] == ("?", "", "", "")


def test_candidate_terms(spark):
    schema = "cwe string, cwe_all array<string>, match_reasons array<string>, package string, repo_url string, fix_commit string, file_path string, code_vuln string, code_fixed string, cve_id string"
    df = spark.createDataFrame([("", ["CWE-9", "cwe-327"], ["keyword:md5"], "PyJWT", "https://h.example/o/n", "abcdef1", "src/a.py", "a\nb\nc\nd md5", "x", "CVE-1"), (None,) * 10], schema)
    assert _values(df, candidates.resolved_cwe()) == ["CWE-327", ""]
    assert _values(df, candidates.fetch_rank()["score"]) == [100 + 30 + 40 + 15 + 10, -50]
    assert _values(df, candidates.fetch_rank()["tier"]) == ["P0", "P3"]
    assert _values(df, candidates.screening_score()) == [3 + 4 + 2 + 3 + 2 + 2 + 2 + 1 + 2 + 1, 0]
    assert _values(df, candidates.suggested_rule(candidates.record_cwes(), F.array_join("match_reasons", " ")))[0] == "CRYPTO-001"


def test_zip_entries(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.py", "x = 1")
        z.writestr("../b.py", "y")
        z.writestr("c.bin", b"\0")
    df = spark.createDataFrame([("p.zip", data.getvalue()), ("q.zip", b"no")], "path string, content binary")
    assert {(r["path"], r["entry"]): r["skipped"] for r in graph.zip_entries(df).collect()} == {("p.zip", "a.py"): None, ("p.zip", "../b.py"): "outside", ("p.zip", "c.bin"): "binary", ("q.zip", ""): "not_a_zip"}


def test_leaks(spark):
    rows = spark.createDataFrame([("k1", "train"), ("k1", "val"), ("k2", "val"), ("k2", "test"), (None, "val"), (None, "train")], "k string, s string")
    assert sorted(map(tuple, dataset.split_leaks(rows, F.col("k"), F.col("s")).collect())) == [("k1", "val_in_train"), ("k2", "test_in_train_or_val")]
    trees = spark.createDataFrame([("x = 1  # a",), ("x=1",), ("x = ",), (None,)], "c string")
    keys = _values(trees, source_ast.tree_key(F.col("c")))
    assert keys[0] == keys[1] is not None and keys[2:] == [None, None]


@pytest.mark.parametrize("value", ["a", None])
def test_first_present(spark, value):
    df = spark.createDataFrame([("", value)], "a string, b string")
    assert _values(df, text.first_present(F.col("a"), F.col("b"))) == [value or ""]


def test_changed_lines_and_line_numbers(spark):
    patch = "--- a\n+++ b\n@@ -3,4 +3,5 @@ def f\n same\n-old\n+new\n+more\n same\n\\ No newline at end of file\n@@ -20 +21 @@\n-x\n+y"
    df = spark.createDataFrame([(1, patch)], "k int, p string")
    assert [(r["side"], r["line"]) for r in scan.changed_lines(df, "p", "k").orderBy("side", "line").collect()] == [("+", 4), ("+", 5), ("+", 21), ("-", 4), ("-", 20)]
    texts = spark.createDataFrame([("1: a\n2: b\n\nc",), ("a\nb\n3: c",), (None,), ("",)], "t string")
    assert _values(texts, text.without_line_numbers(F.col("t"))) == ["a\nb\n\nc", "a\nb\n3: c", None, ""]
    checks = spark.createDataFrame([("rules.crypto-003-des.x",), ("a.b.weak",)], "c string")
    assert _values(checks, text.rule_id(F.col("c"))) == ["CRYPTO-003", "weak"]


def test_status_split_and_expansion(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "o int, k string")
    other = spark.createDataFrame([("a", True), ("b", False)], "k string, ok boolean")
    assert {r["o"]: r["status"] for r in relational.lookup_status(df, other, "k", F.col("ok")).collect()} == {1: "attached", 2: "invalid", 3: "missing", 4: "missing"}
    split = relational.positional_split(df.withColumn("g", F.lit(1)), "g", "o", {"train": 2, "val": 1})
    assert _values(split.orderBy("o"), "split") == ["train", "train", "val", None]
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    assert relational.expanded(df.select("o", "k"), names, "k", "o", 2).count() == 8
    scores = spark.createDataFrame([("src/kit/crypt.py", "+a\n-b", "kit"), ("tests/a.py", "", None)], "p string, d string, n string")
    assert _values(scores, candidates.file_score(F.col("p"), F.col("d"), F.col("n"))) == [8 + 4 + 2 + 5 + 0 + 1, -10_000]
