"""Screening operators against hand-written rows; ranks and sweeps against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from auditlake.functions import hashing
from auditlake.operators import candidates, relational, scan, screening, source_ast
from auditlake.plans import skew


def one(spark, column, **values):
    kinds = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first()["x"]


def test_licences_addresses_and_lists(spark):
    hint = screening.licence_hint(F.col("u"))
    assert one(spark, hint, u=("https://code.example/pyca/cryptography.git", "string")) == "Apache-2.0 OR BSD-3-Clause"
    assert one(spark, hint, u=("https://code.example/other/kit", "string")) == "" and one(spark, hint, u=(None, "string")) == ""
    assert [one(spark, screening.concrete_licence(F.col("u")), u=(x, "string")) for x in (" MIT ", "noassertion", None)] == ["MIT", "", ""]
    url = screening.repository_url(F.col("u"), "https://code.example/")
    assert [one(spark, url, u=(x, "string")) for x in ("a/b", " http://x/y ", "kit", None)] == ["https://code.example/a/b", "http://x/y", "", ""]
    assert one(spark, screening.commit_url(F.col("u"), F.col("c")), u=("https://x/a/b//", "string"), c=("ab", "string")) == "https://x/a/b/commit/ab"
    path = screening.relative_path(F.col("p"), F.col("k"), "root/")
    assert one(spark, path, p=("root\\kit\\a.py", "string"), k=("kit", "string")) == "a.py" and one(spark, path, p=("root/kit2/a.py", "string"), k=("kit", "string")) == "root/kit2/a.py"
    assert [one(spark, screening.as_list(F.col("u")), u=(x, "string")) for x in ('["a","b"]', "c", "[broken", " ", None)] == [["a", "b"], ["c"], ["[broken"], [], []]


def test_commits_of_a_candidate(spark):
    long, short = "a" * 40, "b" * 12
    rows = [
        ("https://h/O/Kit.git", short, [("FIX", f"https://h/o/kit/commit/{long}"), ("FIX", f"https://h/o/other/commit/{'c' * 40}"), (None, None)]),
        (None, None, None),
        ("https://h/o/kit", long, [("FIX", f"https://h/o/kit/commit/{long}")]),
    ]
    df = spark.createDataFrame(rows, "u string, c string, r array<struct<type:string,url:string>>")
    got = [x["x"] for x in df.select(screening.commit_hashes(F.col("u"), F.col("c"), F.col("r")).alias("x")).collect()]
    assert got == [[long, short], [], [long]]


def test_primary_file_prefers_patches_then_score(spark):
    rows = [
        ("g", "src/kit/crypt.py", None, "kit"),
        ("g", "src/kit/other.py", "+a\n-b", "kit"),
        ("g", "tests/test_crypt.py", "+a\n" * 90, "kit"),
        ("h", "tests/test_a.py", "+a", "kit"),
        ("i", None, "+a", None),
    ]
    df = spark.createDataFrame(rows, "g string, p string, d string, k string")
    got = {r["g"]: r["path"] for r in screening.primary_file(df, "g", "p", "d", "k").collect()}
    assert got == {"g": "src/kit/other.py", "h": None, "i": None}
    assert screening.primary_file(df.limit(0), "g", "p", "d", "k").count() == 0


def test_tiers_of_scores(spark):
    schema = "advisory_id string, cve_id string, fix_commit string, code_vuln string, file_path string, match_reasons array<string>, score int"
    rows = [
        ("A", None, "c", "x", "a.py", None, 12),
        ("A", None, "c", "x", "a.py", None, 11),
        ("A", None, "c", "x", "a.py", None, 7),
        (None, "", "c", "x", "a.py", None, 20),
        ("A", None, None, "x", "a.py", None, 20),
        ("A", None, "c", " ", "a.py", None, 20),
        ("A", None, "c", "x", "tests/a.py", None, 20),
        (None, "CVE-1", "c", "x", "a.py", ["predicted:CWE-1"], 20),
        ("A", None, "c", "x", "a.py", ["pycode-vul:1"], 20),
    ]
    got = [r["t"] for r in spark.createDataFrame(rows, schema).select(screening.screening_tier(F.col("score")).alias("t")).collect()]
    assert got == ["P1", "P2", "P3", "P3", "P3", "P3", "P3", "P2", "P1"]


def test_merged_verdicts_and_buckets(spark):
    merged = lambda s, v, c: tuple(one(spark, screening.merged_verdict(F.col("s"), F.col("v"), F.col("c"), F.lit("LOW")), s=(s, "string"), v=(v, "string"), c=(c, "string")))
    assert merged("high", "confirmed", "0.876") == ("CONFIRMED", 0.88, "HIGH") and merged("odd", "", None) == ("UNCERTAIN", 0.5, "LOW") and merged(None, None, "0") == ("UNCERTAIN", 0.5, "LOW")
    bucket = lambda t, v, s, r, h: one(spark, screening.backtest_bucket(F.col("t"), F.col("v"), F.col("s"), F.col("r"), F.col("h")), t=(t, "string"), v=(v, "boolean"), s=(s, "string"), r=(r, "string"), h=(h, "array<string>"))
    assert bucket("detect", True, "x", None, None) == "pos_missing" and bucket("detect", False, "lib-aneg", None, ["R"]) == "aneg_hit" and bucket("detect", None, "lib-bneg", None, []) == "bneg_no_fire"
    assert bucket("triage", None, "x", "R", ["S"]) == "finding_miss" and bucket("triage", None, "real-lib", "R", ["S"]) is None and bucket("detect", True, "x", None, ["R"]) is None


def test_function_lists_and_diffs(spark):
    text = "class A:\n  def f(self):\n    def g():\n      pass\n\n    return g\n\ndef h(): pass\nx = 1\n"
    assert sorted(scan.indented_functions(text)) == [("f", 2, 7), ("g", 3, 5), ("h", 8, 8)]
    assert [f[0] for f in source_ast.functions(text)] == ["A.f", "A.f.g", "h"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "def broken(")], "ordinal int, code string")
    assert {(r["ordinal"], r["name"], r["position"]) for r in source_ast.function_table(df, "ordinal", F.col("code")).collect()} == {(1, "A.f", 0), (1, "A.f.g", 1), (1, "h", 2)}
    assert "+b" in one(spark, source_ast.unified_diff(F.col("a"), F.col("b")), a=("a\n", "string"), b=("b\n", "string")).splitlines()
    assert one(spark, source_ast.unified_diff(F.col("a"), F.col("b")), a=(None, "string"), b=(None, "string")) == ""


def test_outermost_against_brute_force(spark):
    r = random.Random(2)
    intervals = [(r.choice("ab"), a, a + r.randint(0, 15), f"n{i}") for i, a in enumerate(r.randint(0, 60) for _ in range(60))]
    points = [(r.choice("abc"), r.randint(0, 80), i) for i in range(150)]
    p = spark.createDataFrame(points, "g string, at int, tag int")
    i = spark.createDataFrame(intervals, "g string, s int, e int, name string")
    got = {x["tag"]: (x["s"], x["e"]) for x in relational.enclosing(p, i, "g", "at", "s", "e").collect()}
    want = {}
    for g, at, tag in points:
        own = [(s, -e) for h, s, e, _ in intervals if h == g and s <= at <= e]
        if own:
            want[tag] = (min(own)[0], -min(own)[1])
    assert got == want
    assert relational.enclosing(p.limit(0), i, "g", "at", "s", "e").count() == 0


def test_ranks_in_chunks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "x", None]), i, r.randint(0, 5)) for i in r.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "g string, o long, v int")
    got = {x["o"]: x["n"] for x in skew.rank_within(df, ["g"], ["o"], F.floor(F.col("o") / 100), "n").collect()}
    want = {}
    for g in ("hot", "x", None):
        want |= {o: n for n, o in enumerate(sorted(o for h, o, _ in rows if h == g), 1)}
    assert got == want
    held = {x["o"]: x["held_out"] for x in relational.stratified_holdout(df, "g", "o", "s", 0.2).collect()}
    for g in ("hot", "x", None):
        own = [o for h, o, _ in rows if h == g]
        assert sum(held[o] for o in own) == max(1, int(len(own) * 0.2 + 0.5))
    monkeypatch.setattr(relational, "STRETCH", 50)
    splits = {x["o"]: x["split"] for x in relational.positional_split(df, "g", "o", {"a": 2, "b": 1}).collect()}
    own = sorted(o for h, o, _ in rows if h == "hot")
    assert [splits[o] for o in own[:4]] == ["a", "a", "b", None]


def test_expanded_templates(spark):
    t = spark.createDataFrame([("g", i, f"t{i}") for i in range(5)] + [("h", 9, "u")], "g string, o int, t string")
    n = spark.createDataFrame([(x,) for x in "edcba"], "name string")
    got = sorted((x["g"], x["t"], x["name"]) for x in relational.expanded(t, n, "g", "o", 7).collect())
    assert got == [("g", "t0", x) for x in "abcde"] + [("g", "t1", x) for x in "ab"] + [("h", "u", x) for x in "abcde"]


def test_constants_by_hand(spark):
    import hashlib

    for text in ("a", "B  c", ""):
        number = int(hashlib.sha256(" ".join(text.lower().split()).encode()).hexdigest(), 16) % 100
        assert one(spark, hashing.split_90_5_5(F.col("t")), t=(text, "string")) == ("train" if number < 90 else "val" if number < 95 else "test")
    score = lambda **kw: one(spark, candidates.screening_score(), **{k: (kw.get(k), t) for k, t in {"fix_commit": "string", "code_vuln": "string", "code_fixed": "string", "file_path": "string", "cve_id": "string", "package": "string", "cwe": "string", "cwe_all": "array<string>", "match_reasons": "array<string>"}.items()})
    assert score() == 0 and score(fix_commit="x") == 3 and score(code_vuln="a\nb\nc\nd", code_fixed="e") == 6 and score(code_vuln="a") == -2 and score(file_path="a.py") == 3
    assert score(file_path="tests/a.py") == -4 and score(cve_id="C") == 2 and score(package="PyJWT") == 1 and score(cwe="CWE-327") == 2 and score(cwe="CWE-79") == 1 and score(match_reasons=["keyword:x"]) == 1
    assert score(code_vuln="hashlib.md5(x)") == 2 and score(code_vuln="\n".join("x" * 130)) == -1


def test_fixture_gates(spark):
    from auditlake.operators import fixtures

    hits = {"CRYPTO-001": "hashlib.md5(x)", "CRYPTO-002": "hashlib.new('SHA1')", "CRYPTO-003": "DES3.new(k)", "CRYPTO-004": "import Crypto.Cipher.ARC4", "CRYPTO-005": "modes.ECB()", "CRYPTO-008": "my_key = random.choice(x)", "CRYPTO-009": "RSA.generate(1024)", "CRYPTO-010": "ssl.PROTOCOL_TLSv1"}
    safe = {"CRYPTO-001": "hashlib.sha256(x)", "CRYPTO-003": "AES.new(k)", "CRYPTO-005": "modes.GCM(iv)", "CRYPTO-008": "key = os.urandom(8)", "CRYPTO-009": "RSA.generate(2048)", "CRYPTO-010": "ssl.PROTOCOL_TLSv1_2"}
    none = {"CRYPTO-001": "MD5.new(x)", "CRYPTO-008": "index = random.choice(x)", "CRYPTO-013": "a == b", None: "hashlib.md5(x)"}
    rows = [(r, c, g) for group, g in ((hits, "positive"), (safe, "negative"), (none, "none")) for r, c in group.items()]
    df = spark.createDataFrame(rows, "r string, c string, want string")
    assert [x for x in df.select("r", "c", "want", fixtures.gate(F.col("r"), F.col("c")).alias("g")).collect() if x["g"] != x["want"]] == []
    reason = lambda c: one(spark, fixtures.harmless_reason(F.lit("CRYPTO-001"), F.col("c")), c=(c, "string"))
    assert [reason(c) for c in ("md5(usedforsecurity=False, sha256)", "SHA512", "AES", "x")] == ["not_for_security", "modern_hash", "modern_cipher", "other"]
    assert one(spark, fixtures.without_marks(F.col("c")), c=("# ruleid: a-b\nx\n  # ok\n# ok: c\ny # ok\n", "string")) == "x\ny # ok"
    assert one(spark, fixtures.wrapped(F.col("c")), c=("a\n\n  b", "string")) == "def process_request():\n    a\n\n      b"


def test_times_dictionaries_and_archives(spark, tmp_path):
    import io
    import json
    import zipfile

    from auditlake.functions.text import utc_seconds
    from auditlake.operators.graph import zip_entries
    from auditlake.sources import records

    at = spark.sql("SELECT timestamp'2031-02-03 04:05:06.789' AS t").select(utc_seconds(F.col("t")).alias("x")).first()["x"]
    assert at == "2031-02-03T04:05:06+00:00"
    (tmp_path / "cwe.json").write_text(json.dumps({"CWE-1": {"name": "one"}, "2": {"id": "cwe-2", "name": "two"}, "x": None}))
    assert sorted(map(tuple, records.cwe_dictionary(spark, str(tmp_path / "cwe.json")).collect())) == [("CWE-1", "one"), ("CWE-2", "two")]
    assert records.cwe_dictionary(spark, str(tmp_path / "none.json")).count() == 0
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(5):
            z.writestr(f"{i}.py", "x" * 10)
    df = spark.createDataFrame([("a.zip", bytearray(buffer.getvalue()))], "path string, content binary")
    assert [r["skipped"] for r in zip_entries(df, most_files=2).collect()] == [None, None] + ["too_many_files"] * 3
    assert [r["skipped"] for r in zip_entries(df, most_total=35).collect()] == [None] * 3 + ["too_much"] * 2


def test_csv_filters_indexes_and_outcomes(spark, tmp_path):
    import pytest

    from auditlake.sources import sinks

    rows = [(["CWE-1"], "1", "a", "b"), (["CWE-327"], "0", "a", "b"), (["CWE-327"], "1", " ", "b"), (["CWE-327"], "1.0", "a", "a"), (["CWE-2"], "1", "a", "b"), (["CWE-327"], "1", "a", "b")]
    df = spark.createDataFrame(rows, "c array<string>, l string, code_vuln string, code_fixed string")
    got = {r["outcome"]: r["n"] for r in candidates.csv_outcomes(df, F.col("c"), ["CWE-327", "CWE-2"], F.col("l")).collect()}
    assert got == {"no_crypto_cwe": 1, "label": 1, "blank_side": 1, "identical": 1, "no_target_cwe": 1, "kept": 1}
    assert one(spark, candidates.collected_cwes([F.col("a"), F.col("b")], F.lit("crypto-010")), a=("cwe 295", "string"), b=(None, "string")) == ["CWE-326", "CWE-295"]
    match = lambda **k: one(spark, candidates.match_outcome(F.array(F.lit("pyjwt")), F.array().cast("array<string>"), F.lit(""), "key", F.lit(False), **k)["outcome"], a=(1, "int"))
    assert (match(), match(cwe_only=True), match(malicious=F.lit(True))) == ("matched", "out_of_scope", "malicious")
    keyed = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert relational.unique_index(keyed, "k", "file").count() == 2 and sorted(map(tuple, relational.unique_index(keyed, "k", "file").collect())) == [("a", 1), ("b", 2)]
    for more in (("a", 3), (None, 3), ("", 3)):
        with pytest.raises(Exception, match="file: empty or repeated key"):
            relational.unique_index(keyed.union(spark.createDataFrame([more], keyed.schema)), "k", "file").collect()
    sinks.write_jsonl(spark.range(50).select((F.lit(50) - F.col("id")).alias("n")), str(tmp_path / "o"), order=["n"])
    lines = [x for f in sorted((tmp_path / "o").iterdir()) if f.name.startswith("part") for x in f.read_text().splitlines()]
    assert lines == [f'{{"n":{i}}}' for i in range(1, 51)]
