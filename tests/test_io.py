"""Readers, writers, streams and the driver's contract."""

from __future__ import annotations

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from auditlake.sources import records, sinks
from auditlake.streaming import feedback

DATA = "/root/testdata/sf0.001"


def test_jsonl_lenient_and_strict(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "1", "x": null}\n\nbad\n[1]\n{"id": "2"}\n')
    rows = records.jsonl(spark, str(path), "id string, x string").collect()
    assert [r["id"] for r in rows] == ["1", "2"] and '"x"' in rows[0]["_raw"]
    assert records.jsonl(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    with pytest.raises(Exception, match="not an object"):
        records.jsonl(spark, str(path), "id string", strict=True).collect()
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        records.jsonl(spark, str(tmp_path / "empty.jsonl"), "id string", strict=True)
    with pytest.raises(FileNotFoundError):
        records.jsonl(spark, str(tmp_path / "none.jsonl"), "id string", strict=True)


def test_flattened_documents(spark):
    doc = json.dumps({"items": [{"a": 1}, {"records": [{"b": 2}]}], "other": 1})
    df = spark.createDataFrame([("f", doc), ("g", '[{"c": 3}]'), ("h", '{"d": 4}'), ("i", "nope")], "f string, raw string")
    got = sorted((r["f"], r["locator"], r["record"]) for r in records.flattened(df, "raw", ["f"]).collect())
    assert got == [("f", "root.items[0]", '{"a":1}'), ("f", "root.items[1].records[0]", '{"b":2}'), ("g", "root[0]", '{"c":3}'), ("h", "root", '{"d": 4}')]


def test_advisories(spark, tmp_path):
    a = {"id": "GHSA-1", "aliases": ["X", "CVE-2"], "summary": "s", "affected": [{"package": {"ecosystem": "PyPI", "name": "kit"}, "ranges": [{"events": [{"fixed": "1.2"}, {}]}]}], "references": [{"type": "WEB", "url": "u"}], "database_specific": {"cwe_ids": ["CWE-327"]}}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text(json.dumps({"vulns": [a | {"id": "PYSEC-2", "withdrawn": "2031"}]}))
    (tmp_path / "c.jsonl").write_text(json.dumps(a | {"id": "OSV-3", "affected": None}) + "\nbroken\n")
    got = {r["id"]: r for r in records.advisory_fields(records.advisories(spark, str(tmp_path))).collect()}
    assert got.keys() == {"GHSA-1", "PYSEC-2", "OSV-3"}
    assert (got["GHSA-1"]["packages"], got["GHSA-1"]["fixed_versions"], got["GHSA-1"]["cve"], got["GHSA-1"]["cwes"]) == (["kit"], ["1.2"], "CVE-2", ["CWE-327"])
    assert got["PYSEC-2"]["withdrawn"] and got["OSV-3"]["packages"] == []


def test_csv_tree_labels_rules_and_probes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('function_code ,patched_function_source, class\n"a\nb","c ""d""",1\n')
    row = records.code_pairs_csv(spark, str(tmp_path / "x.csv")).first()
    assert (row["code_vuln"], row["code_fixed"], row["label"], row["repo"]) == ("a\nb", 'c "d"', "1", None)
    tree = tmp_path / "tree"
    (tree / "node_modules").mkdir(parents=True)
    (tree / "a.py").write_text("x = 1")
    (tree / "b.py").write_bytes(b"\0")
    (tree / "c.txt").write_text("t")
    (tree / "node_modules/d.py").write_text("y")
    got = {os.path.basename(r["path"]): (r["text"], r["skipped"]) for r in records.source_tree(spark, str(tree), ["py"], ["node_modules"]).collect()}
    assert got == {"a.py": ("x = 1", None), "b.py": (None, "binary"), "c.txt": (None, "suffix"), "d.py": (None, "excluded")}
    for verdict, own in (("confirm", "confirm"), ("reject", "confirm")):
        (tmp_path / "labels" / verdict).mkdir(parents=True)
        (tmp_path / "labels" / verdict / "1.json").write_text(json.dumps({"verdict": own}))
    assert sorted((r["partition"], r["consistent"]) for r in records.label_files(spark, str(tmp_path / "labels"), "verdict string").collect()) == [("confirm", True), ("reject", False)]
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/r.yaml").write_text("rules:\n  - id: R-1\n    message: Weak hash\n    severity: WARNING\n    metadata:\n      cwe: CWE-327\n      severity: medium\n")
    assert tuple(records.rule_files(spark, str(tmp_path / "rules")).first())[1:] == ("R-1", "MEDIUM", "CWE-327", "Weak hash")
    shapes = spark.createDataFrame([('[["Confirm", "f", "c"]]',), ('[{"gt": "Reject", "finding": "g", "code": "d"}]',)], "raw string")
    assert sorted(map(tuple, records.probes(shapes, "raw").collect())) == [("Confirm", "f", "c"), ("Reject", "g", "d")]


def test_commit_files_provider(spark):
    def fetch(owner, repo, sha):
        if sha == "bad":
            raise OSError("limit  reached")
        return [(f"{repo}.py", "patch")]

    df = spark.createDataFrame([("o", "r", "1"), ("o", "r", "1"), ("o", "r", "bad")], "owner string, repo string, sha string")
    assert sorted((r["sha"], r["path"], r["error"]) for r in records.commit_files_provider(fetch)(df).collect()) == [("1", "r.py", None), ("bad", None, "limit reached")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é🔐", None), (1, "b", "x")], "b int, a string, c string")
    read = lambda p: sorted(line for f in os.listdir(p) if f.startswith("part") for line in open(f"{p}/{f}", encoding="utf-8").read().splitlines())  # noqa: E731, SIM115
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert read(tmp_path / "j") == ['{"b":1,"a":"b","c":"x"}', '{"b":2,"a":"é🔐","c":null}']
    sinks.write_jsonl(df, str(tmp_path / "k"), ascii_sorted=True)
    assert sorted(map(json.loads, read(tmp_path / "k")), key=lambda x: x["b"]) == [{"a": "b", "b": 1, "c": "x"}, {"a": "é🔐", "b": 2, "c": None}] and all(x.isascii() for x in read(tmp_path / "k"))
    sinks.write_ranked_tsv(df, str(tmp_path / "t"), [F.col("b")])
    assert read(tmp_path / "t") == ["1\t1\tb\tx", '2\t2\té🔐\t""' if '2\t2\té🔐\t""' in read(tmp_path / "t") else "2\t2\té🔐\t", "rank\tb\ta\tc"]
    sinks.write_partitioned(df, str(tmp_path / "p"), "a")
    assert sorted(x for x in os.listdir(tmp_path / "p") if "=" in x)[0] == "a=b"
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert len(read(tmp_path / "l")) == 4
    sinks.fan_out(df, str(tmp_path / "q"), {"one": F.col("b") == 1, "all": F.lit(True)})
    assert spark.read.parquet(str(tmp_path / "q")).groupBy("queue").count().collect().__len__() == 2
    assert "| b | a | c |" in sinks.markdown_table(df)


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([(1, "2031-01-01 00:00:10"), (1, "2031-01-01 00:00:20"), (2, "2031-01-01 00:01:10")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in/events.parquet"))
    stream = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in/events.parquet"))
    assert feedback.run_to_table(feedback.once(stream, "k", "t"), "append", "t").count() == 2
    counts = feedback.run_to_table(feedback.windowed_counts(stream, "t", "1 minute", "1 minute", "k"), "complete", "t")
    assert sorted((r["k"], r["n"]) for r in counts.collect()) == [(1, 2), (2, 1)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(source)
    run = uuid.uuid4().hex

    def all_rows(mode):
        stream = spark.readStream.schema("k int, v string").parquet(source)
        rows = stream if mode == "append" else stream.groupBy("v").agg(F.count("*").alias("n"))
        return sorted(map(tuple, feedback.run_to_table(rows, mode, f"resume-{mode}", run).collect()))

    assert all_rows("append") == [(1, "a"), (2, "b")] and all_rows("complete") == [("a", 1), ("b", 1)]
    assert all_rows("append") == [(1, "a"), (2, "b")] and all_rows("complete") == [("a", 1), ("b", 1)]
    spark.createDataFrame([(3, "b")], "k int, v string").write.mode("append").parquet(source)
    assert all_rows("append") == [(1, "a"), (2, "b"), (3, "b")] and all_rows("complete") == [("a", 1), ("b", 2)]


def test_numbers_of_rows_across_blocks_of_a_file(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.txt").write_text("".join(f"{i:05d}\n" for i in range(3000)))
    (tmp_path / "n/b.txt").write_text("x\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = records.numbered(spark.read.text(str(tmp_path / "n"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = sorted((r["ordinal"], r["value"]) for r in rows if r["source_file"].endswith("a.txt"))
    assert a == [(i + 1, f"{i:05d}") for i in range(3000)]
    assert sorted((r["ordinal"], r["value"]) for r in rows if r["source_file"].endswith("b.txt")) == [(1, "x"), (2, "y")]


def test_tree_limits_and_counts(spark, tmp_path):
    for name, size in (("src/a.py", 3), ("src/B.PY", 3), ("src/big.py", 50), ("lib/c.py", 3)):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("x" * size)
    tree = records.source_tree(spark, str(tmp_path / "t"), ["py"], included="src/*", largest=10)
    got = {os.path.basename(r["path"]): (r["text"], r["skipped"]) for r in tree.collect()}
    assert got == {"a.py": ("xxx", None), "B.PY": ("xxx", None), "big.py": (None, "too_large"), "c.py": (None, "excluded")}
    assert {r["skipped"]: r["files"] for r in records.skip_counts(tree).collect()} == {None: 2, "too_large": 1, "excluded": 1}


def test_deep_containers(spark):
    doc = '{"x": 1}'
    for _ in range(7):
        doc = f'{{"items": [{doc}]}}'
    df = spark.createDataFrame([(doc,)], "raw string")
    assert [r["locator"] for r in records.flattened(df, "raw", []).collect()] == ["root" + ".items[0]" * 7]
    assert records.flattened(df.limit(0), "raw", []).count() == 0


def test_replacing_keeps_the_old_files_if_it_fails(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.write_csv(spark.range(3), path)
    with pytest.raises(Exception, match="no more"):
        sinks.write_csv(spark.range(3).select(F.raise_error(F.lit("no more")).cast("int").alias("id")), path)
    assert spark.read.option("header", "true").csv(path).count() == 3
    assert sorted(os.listdir(tmp_path)) == ["r"]


def test_partitioned_rows_move_and_go(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "id int, verdict string, note string"
    sinks.write_partitioned(spark.createDataFrame([(1, "confirm", "a"), (2, "confirm", "b"), (3, "reject", "c")], schema), path, "verdict")
    sinks.update_partitioned(spark, path, schema, spark.createDataFrame([(1, "reject", "a2"), (2, None, None), (4, "confirm", "d")], schema), "id", "verdict")
    assert sorted(map(tuple, spark.read.schema(schema).json(path).select("id", "verdict", "note").collect())) == [(1, "reject", "a2"), (3, "reject", "c"), (4, "confirm", "d")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_without_sql_run_to_the_end(spark):
    from auditlake import catalog

    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        df = catalog.queries()[name](spark, DATA)
        assert len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).columns == ["ordinal", "findings", "rules", "first_line"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_agree_with_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from auditlake import catalog

    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    plain = lambda v: round(float(v), 9) if v is not None and type(v).__name__ in ("float", "Decimal") else v
    wrong = []
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        own = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        theirs = db.sql(sql)
        places = [theirs.columns.index(c) for c in columns] if sorted(theirs.columns) == columns else []
        if own != sorted(repr([plain(r[i]) for i in places]) for r in theirs.fetchall()):
            wrong.append(name)
    assert wrong == []
