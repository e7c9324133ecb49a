"""Problems 6 to 10: grammars, broken pairs, encoding, leaks and sentences."""

from __future__ import annotations

import os
import random
import re
from functools import reduce

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.llm import bpe, broken_pairs, grammars, leakage, sentences, syntax
from auditlake.plans.store import Store

TOKENIZERS = os.environ.get("AUDITLAKE_TOKENIZERS", "/opt/tokenizers")

JS_GOOD = [
    "const a = 1;\nlet b = a === 2 ? f(a) : 3\nb = [1, ...a, , 2]\n",
    "async function f({ a, b: [c] = [] }, ...rest) {\n  for (const x of await g(rest)) { log.debug(`x ${x}`, x); }\n  return a && !b?.c[0] || (() => ({ k: 1 }))();\n}",
    "class A extends B { static x = 1; get y() { return super.y; } async *z(a = 1) { yield a; } }\nexport default class {}\n",
    "import x, { y as z } from 'm';\nif (a) b(); else if (c) { d() } else e();\ndo { i++ } while (i < 3);\nswitch (q) { case 1: f(); break; default: g() }\n",
    "const r = /[/'\"(]+/g.test(s), q = a / b / c;\ntry { f() } catch { g() } finally { h() }\nlabel: for (;;) { continue label }\nmodule.exports = { a, b() {}, ['c']: 1 };",
    "",
]
JS_BAD = ["const a = ;", "function f( {", "let x = 1 2;", "package demo;\nimport java.util.*;", "<html></html>", "if a { b }", "<<<<<<< HEAD\nf()\n=======\ng()\n>>>>>>> x", "const s = 'abc;\n", "1: const a = 1;\n2: f();", "@@ -1,2 +1,2 @@\nf();", "f(a, ;", "try { f() }", "a => { return 1 }}"]
JAVA_GOOD = [
    "package a.b;\nimport java.util.*;\nimport static a.B.c;\n@Deprecated(since = \"1\")\npublic final class A<T extends B> extends C implements D, E {\n  private static final byte[] K = {1, 2};\n  int[] f(String... xs) throws IOException {\n    for (int i = 0, j = 1; i < 3; i++) { if (xs == null) continue; else g(i); }\n    for (final Map.Entry<String, List<Integer>> e : m.entrySet()) h(e::getKey, (a, b) -> a + b, x -> { return x; });\n    try (Reader r = new Reader(p)) { return new int[]{(int) 1L, (String) o == s ? 1 : 2}; } catch (A | B e) { throw new X(e) { int y; }; } finally { }\n  }\n  A() { super(); this.x = y[0]++; }\n  static { K[0] = 1; }\n  enum Q { X(1) { }, Y; int z; }\n  interface I { void m(); default int n() { return switch (a) { case 1 -> 2; default -> { yield 3; } }; } }\n}\n",
    "record P(int x, String y) { }\nclass Z { Runnable r = () -> { }; }",
]
JAVA_BAD = ["class A { int f( }", "class A { void f() { a + b; } }", "class A { void f() { return 1 } }", "const x = require('y');", "int x = 1;", "package a\nclass B {}", "class A { void f() { if a { } } }", "class A {", "class A { } }", 'class A { String s = "x; }']
GO_GOOD = [
    'package main\nimport (\n\t"fmt"\n\tx "a/b"\n)\nvar a, b = []byte("x"), map[string]int{"k": 1, "l": 2}\ntype T struct {\n\tA int `json:"a"`\n\t*B\n}\ntype I interface { M(a int, b ...string) (c error) }\nfunc (t *T) F(x, y int, f func(int) error) ([]byte, error) {\n\tfor i, v := range []int{1, 2} { t.A += v[i:] }\n\tfor i := 0; i < 3; i++ { continue }\n\tif v, err := g(x); err != nil { return nil, fmt.Errorf("x %w", err) } else if v { go h() } else { defer k() }\n\tswitch y := x.(type) { case int, *T: z() ; default: }\n\tselect { case c <- 1: case v := <-d: _ = v }\n\treturn make([]byte, 3), nil\n}\nfunc init() { f := func() { x++ }; f() }\n',
    "package a\n",
]
GO_BAD = ["package a\nfunc f( {\n}", "func f() {}", "package a\nfunc f() { x := }", "package a\nvar x = 1 2\n", "package a;\nimport java.util.*;", "package a\nfunc f() { if x == 1 }", "package a\nreturn 1", "package a\nfunc f() {", "package a\n<<<<<<< ours\nvar a = 1\n=======\n"]


@pytest.mark.parametrize(("language", "good", "bad"), [("javascript", JS_GOOD, JS_BAD), ("java", JAVA_GOOD, JAVA_BAD), ("go", GO_GOOD, GO_BAD)])
def test_grammars(language, good, bad):
    assert [t for t in good if not grammars.is_well_formed(t, language)] == []
    assert [t for t in bad if grammars.is_well_formed(t, language)] == []


def test_python_and_json():
    assert syntax.parses("﻿x = 1\n", "python") and syntax.parses("    a = 1\n    if a:\n        b()\n", "python") and syntax.parses("return 1", "python")
    assert not syntax.parses("print 'x'", "python") and not syntax.parses("def f(:\n  pass", "python") and not syntax.parses('x = """abc', "python")
    assert syntax.parses('{"a": [1, 2.5e3, null, "\\u00e9"]}', "json") and syntax.parses("﻿[]", "json")
    assert not any(syntax.parses(t, "json") for t in ("{'a': 1}", '{"a": 1,}', '{"a": NaN}', "// x\n{}", '{"a": 1} x', '{"a": "b\n"}'))


def test_regular_expressions_that_look_like_strings_or_comments():
    good = ["const a = x.replace(/`/g, '');\n", "const r = /\\/*/.test(s);\nf();\n", "const r = /[/*]/.test(s);\n"]
    for text in good:
        summary = syntax.summarise(text, "javascript")
        assert summary[""][0] in ("`", "/*") and syntax.parses(text, "javascript")
    for language, text in [("javascript", "/* open\n f()"), ("javascript", "f(`abc"), ("java", "class A { } /* open"), ("go", "package a\nvar x = `abc\n"), ("python", 'x = """abc')]:
        assert not syntax.parses(text, language) and not syntax.balanced(syntax.summarise(text, language))


def test_summaries_combine_like_the_whole():
    texts = {"python": 'a = """x\n(\n"""\nb = [\n(1, # )\n2),\n]\n', "javascript": "/* (\n{ */ f(`a\n(`,\n[1,\n2]);\n", "java": 'class A { /*\n} */ String s = """\n{ "\n"""; }\n', "go": "package a\nvar x = `(\n[`\nfunc f() {\n}\n", "json": '{"a":\n[1,\n{"b": "]"}]}\n'}
    for language, text in texts.items():
        parts = [syntax.summarise(c, language) for c in syntax.chunks(text, language, 1)]
        assert len(parts) > 2
        whole = syntax.summarise(text, language)
        assert reduce(syntax.combine, parts)[""] == whole[""] and syntax.balanced(whole)
        left, right = reduce(syntax.combine, parts[:2]), reduce(syntax.combine, parts[2:])
        assert syntax.combine(left, right) == reduce(syntax.combine, parts)
        assert not syntax.balanced(syntax.summarise(text[:-2].rstrip("]});"), language))


def test_verdicts(spark, monkeypatch):
    rows = [(1, "x = 1", "Python3", "a"), (1, "x = 1", "Python3", "a"), (2, "x = ", "py", "a"), (3, None, "py", "a"), (4, " \n", "go", "a"), (5, "zzz", "cobol", "a"), (6, "zzz", None, "a"), (7, "[1", "JSON", "a"), (8, "x = (\n" + "1 +\n" * 400_000 + "1)\n", "python", "a"), (9, "x = (\n" + "1 +\n" * 400_000, "python", "a")]
    df = spark.createDataFrame(rows, "id long, code string, lang string, text string")
    got = sorted((r["id"], r["broken"]) for r in syntax.verdicts(df, "id", {"code": (F.col("code"), syntax.language_of(F.col("lang")))}).collect())
    assert got == [(1, False), (1, False), (2, True), (7, True), (8, False), (9, True)]
    assert syntax.verdicts(df.limit(0), "id", {"code": (F.col("code"), syntax.language_of(F.col("lang")))}).count() == 0
    paths = spark.createDataFrame([("a/b.py",), (None,), ("",), ("x.JS",), ("y.txt",), ("z",)], "p string")
    assert [r[0] for r in paths.select(syntax.language_of_path(F.col("p"))).collect()] == ["python", "python", "python", "javascript", None, None]


def _chat(*turns):
    return [(r, c) for r, c in turns]


def _by_parts(code, language, size):
    """(whether the chunks could be placed, whether all parts parse) as long files are read."""
    pieces = pd.DataFrame([{"row": 1, "lang": language, "at": i, "chunk": c} for i, c in enumerate(syntax.chunks(code, language, size))])
    placed = syntax._placed(next(syntax._summaries(iter([pieces]))))
    if not len(placed):
        return False, False
    parts = pd.concat(syntax._parts(iter([pieces.merge(placed, on=["row", "at"])]))).sort_values(["at", "k"])
    parts["part"] = (parts["k"] > 0).cumsum()
    parts["parts"] = parts["part"].max() + 1
    return True, all(syntax._statements(g)["ok"].iloc[0] for _, g in parts.groupby("part"))


def test_parts_of_long_files_parse_like_the_whole(monkeypatch):
    monkeypatch.setattr(syntax, "PART", 1)
    good = {
        "python": 'import os\n\n@wrap\n@other(1)\ndef f(a,\n      b):\n    """text\ndef not_here(): pass\n"""\n    return a\n\nif os:\n    x = 1\n# note\nelse:\n    x = 2\ny = 1 + \\\n  2\nz = [\n1,\n2]\n',
        "javascript": "import a from 'b';\nconst t = `x\nfunction no() {`;\nfunction f(a) {\n  return {b: [a]};\n}\nclass C {\n  m() { return 1; }\n}\nlet y = 2;\n",
        "java": "package p;\nimport q.R;\n/* class no\npublic class X { */\npublic class A {\n  int f() { return 1; }\n}\nfinal class B {\n}\n",
        "go": 'package p\n\nimport "fmt"\n\nvar x = 1\n\nfunc f() int {\n\treturn x\n}\n\ntype T struct {\n\tA int\n}\n',
        "json": '{"a": [1, {"b": "c,]\\\\\\" d"}], "e": {}, "f": [[], null]}',
    }
    for language, text in good.items():
        assert syntax.parses(text, language), language
        for size in (1, 7, 30, 1000):
            assert _by_parts(text, language, size) == (True, True), (language, size)
        for at in range(0, len(text) - 1, 7):
            broken = text[:at] + "]" + text[at:]
            if not syntax.parses(broken, language):
                assert not _by_parts(broken, language, 20)[1], (language, at)
    assert _by_parts("[]", "json", 1) == (True, True) and not _by_parts("[1,]", "json", 1)[1] and not _by_parts("[,]", "json", 1)[1]


def test_long_and_deep_files(spark):
    one = "".join(f"def f{i}(a):\n    return [a, '{i}', {{}}]\n\n" for i in range(40_000))
    assert len(one) > syntax.CHUNK
    deep = "[" * 100_000
    rows = [(1, one, "python"), (1, one + "def broken(:\n    pass\n", "python"), (None, one + "x = 1\n", "python"), (None, "x = '''" + one, "python")]
    rows += [(2, "[" + ",".join(f'{{"a": {i}}}' for i in range(120_000)) + "]", "json"), (3, "[" + "1," * 600_000 + "1", "json")]
    rows += [(4, deep + "]" * 100_000, "json"), (5, deep, "json"), (6, deep + "1,]" + "]" * 99_999, "json")]
    df = spark.createDataFrame(rows, "id int, code string, lang string")
    got = sorted((str(r["id"]), r["broken"]) for r in syntax.verdicts(df, "id", {"code": (F.col("code"), F.col("lang"))}).collect())
    assert got == sorted([("1", False), ("1", True), ("None", False), ("None", True), ("2", False), ("3", True), ("4", False), ("5", True), ("6", True)])


def test_defects(spark):
    q = "How should I store the salt in acme-kit 4.1?"
    good = "The salt of acme-kit 4.1 is stored beside the hash, i.e. in plain text."
    code = "import os\n\ndef f(a):\n    return os.urandom(16) + a\n"
    task = f"Task: detect\nLanguage: python\nCode:\n{code}"
    cases = {
        1: (q, good, None), 2: (q, "", "empty_answer"), 3: (q, None, "empty_answer"), 4: (q, "​ ...", "empty_answer"), 5: (q, "```\n```", "empty_answer"), 6: (q, "{}", "empty_answer"), 7: (q, '{"answer": ""}', "empty_answer"),
        8: (q, q, "copied_question"), 9: (q, f"> {q}\n> {q}", "copied_question"), 10: (task, code, "copied_question"), 11: (q, f"{q}\n\n{good}", None),
        12: (q, "Sorry, but I am not able to answer that.", "refusal"), 13: (q, "对不起，我无法回答这个问题。", "refusal"), 14: (q, '{"error": "This is something I have to decline."}', "refusal"), 15: (q, "I can't recommend the outer salt here; switch acme-kit to the inner one.", None),
        16: (q, "The server refuses to answer when the token has expired, so renew it.", None), 17: (q, good[:40], "truncated_answer"), 18: (task, '{"vulnerable": true, "expl', "truncated_answer"), 19: (q, good + "\n\n```python\nf(", "truncated_answer"), 20: (q, "CWE-327", None),
        21: (q, "2048", None), 22: (q, "Der Schlüssel wird ohne Prüfung in der Datei abgelegt, weil die Prüfer das nicht ablehnten.", "other_language"), 23: (q + " Please answer in German.", "Der Schlüssel wird ohne Prüfung in der Datei abgelegt.", None),
        24: ("为什么acme-kit的盐会被报告为弱加密？", "因为盐没有加密就写入了文件。", None), 25: (q, "版本没有经过校验就写入了审计日志。", "other_language"), 26: (q, "„Bitte zuerst den Schlüssel tauschen!“, steht in der Datei von Acme, „danach den Umschlag.“", "other_language"), 27: ("", "", "empty_answer"),
    }
    rows = [(i, _chat(("system", "s"), (" USER ", a), *([("gpt", b)] if b is not None else []), ("human", q), ("Assistant", good))) for i, (a, b, _) in cases.items()]
    rows += [(100, None), (101, []), (102, [(None, "x"), ("assistant", "y")])]
    df = spark.createDataFrame(rows, "conv_id long, messages array<struct<role:string,content:string>>")
    got = {(r[0], r[1]): r[2] for r in broken_pairs.defects(df, "conv_id", "messages").collect()}
    assert got == {(i, 0): d for i, (_, _, d) in cases.items() if d}
    assert broken_pairs.defects(df.limit(0), "conv_id", "messages").count() == 0


def test_language_requests_anywhere_in_the_prose():
    german = "Der Schlüssel wird ohne Prüfung in der Datei abgelegt."
    preface = "The salt of the kit is stored beside the hash and that is the state of it. " * 4
    code = "def f(a):\n    return a + 1\n" * 20
    assert not broken_pairs.in_other_language(f"{preface}Please answer in German. {preface}\nCode:\n{code}", german)
    assert not broken_pairs.in_other_language(f"{preface}\nCode:\n{code}Answer in German.\n{code}", german)
    assert broken_pairs.in_other_language(f"{preface}\nCode:\n{code}# answer in German\n{code}", german)


def test_clauses_after_versions_and_polite_sentences():
    for text in ("Thank you for asking about torbrilo 2.15.3. I can't help with that.", "Hello there. Thank you for asking. It is a good day. I can't help with that."):
        assert "i can't help with that" in broken_pairs.opening(text)
    assert "我无法回答" in broken_pairs.opening("请看2.15.3版。我无法回答。")


def test_refusals_by_recurrence(spark):
    """A template without any known phrase is a refusal if it recurs among the formulas of refusals; others that recur aren't."""
    names = ["torbrilo", "melkend", "vaquist", "hilkenor", "dorzanfel", "rohilmar"]
    rows = []
    for i, name in enumerate(names):
        q = f"How should I store the salt of {name}?"
        rows += [(i, q, "Thank you for asking, however I am not able to answer that."), (20 + i, q + " And the nonce?", f"The {name} salt belongs beside the hash, so renew it before the next release.")]
        rows += [(30 + i, f"Is {name} safe?", "confirm"), (40 + i, f"May {name} be used?", f"I must pass on this one about {name}-kit.")]
    rows += [(10 + i, f"Where is the key of {name}?", "Thank you for asking, I must pass on this one.") for i, name in enumerate(names[:4])]
    rows.append((50, "How is the salt of torbrilo kept?", "Thank you for asking, the salt of torbrilo is kept beside the hash."))
    df = spark.createDataFrame([(i, [("user", q), ("assistant", a)]) for i, q, a in rows], "conv_id long, messages array<struct<role:string,content:string>>")
    got = {r[0]: r[2] for r in broken_pairs.defects(df, "conv_id", "messages").collect()}
    assert got == {i: "refusal" for i, _, a in rows if "not able" in a or "must pass" in a}


def test_every_similar_clause_is_a_refusal(spark):
    """A clause that says no phrase of refusals, in 0.82 of its shingles like two that do, is one by their cluster."""
    draw = random.Random(3)
    rows = []
    for i in range(300):
        rest = " ".join("".join(draw.choices("bcdfgklmnprstvz", k=7)) for _ in range(20))
        rows += [(3 * i, f"I cannot help with {rest}."), (3 * i + 1, f"I cannot help with {rest} anew."), (3 * i + 2, f"I never help with {rest}.")]
    df = spark.createDataFrame([(i, [("user", f"Question {i}?"), ("assistant", a)]) for i, a in rows], "conv_id long, messages array<struct<role:string,content:string>>")
    got = {r[0]: r[2] for r in broken_pairs.defects(df, "conv_id", "messages").collect()}
    assert got == {i: "refusal" for i, _ in rows}


def test_clusters_by_brute_force(spark):
    """Chains of similar sets of 1 to 150 shingles, hot shingles, equal sets and large sets; all pairs are compared."""
    draw = random.Random(5)
    hot = draw.sample(range(1 << 32), 8)
    large = draw.sample(range(1 << 32), 2500)
    sets = [set(large), set(large[:2100]), set(large[400:])]
    for size in [*range(1, 40), 60, 90, 150]:
        own = set(draw.sample(range(1 << 32), size))
        for _ in range(8):
            sets.append(set(own))
            # as many others as may leave a similar set, or one too many
            for x in draw.sample(sorted(own), min(len(own) - 1, draw.randint(0, size // 9 + 1))):
                own.remove(x)
            own |= set(draw.sample(range(1 << 32), draw.randint(0, size // 9 + 1)))
    sets += [{*hot, x} for x in draw.sample(range(1 << 32), 40)] + [{*hot[:4], x} for x in draw.sample(range(1 << 32), 40)] + [set(hot[:4])]
    ids = draw.sample(range(-1000, 1000), len(sets))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min(c for c, x in zip(ids, root, strict=True) if x == r) for r in root}
    signed = spark.createDataFrame([(c, 1, sorted(s), 1, False, False) for c, s in zip(ids, sets, strict=True)], "c long, questions long, shingles array<long>, words int, slot boolean, declined boolean")
    got = {r["c"]: r["template"] for r in broken_pairs._clusters(signed, Store(spark, "clusters")).collect()}
    assert got == {c: least[r] for c, r in zip(ids, root, strict=True)}


@pytest.fixture(scope="module")
def encoder():
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def test_encoding_equals_the_library_and_round_trips(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    r = random.Random(9)
    parts = ["a", "e", "in", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "1", "23", ".", "...", "'s", "é", "中文", "ไทย", "🔐", "_", "{}", "ing", "<|endoftext|>", "zq"]
    texts = ["", " ", "\n\n \n", "<|endoftext|>", "a" * 3000, "ab" * 1500, "0" * 999] + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert encoder.decode(ids) == text


def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "Hello world", [0]), (2, "", [0]), (3, None, [0]), (None, "x" * 100_000, [0]), (1, "Hello world", [0])], "doc_id long, text string, ids array<int>")
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in bpe.encode(df, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json").collect()), key=str)
    assert [x for x in got if x[0]] == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])] and len(got) == 5
    assert bpe.encode(df.limit(0), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0


def test_wu_manber_against_plain_search():
    r = random.Random(2)
    patterns = {"".join(r.choice("ab ") for _ in range(r.randint(6, 9))): [i] for i in range(40)}
    search = leakage.WuManber(patterns, 3)
    for _ in range(300):
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 60)))
        assert search.owners(text) == {o for p, own in patterns.items() if p in text for o in own}


def test_leaks(spark):
    words = [f"word{i}" for i in range(40)]
    han = "由于缺少加密信封所以把密钥环与支付记录合并因此得到校验标签最后写入审计日志"
    items = [(1, " ".join(words)), (2, han), (3, "too short"), (4, None), (1, " ".join(words))]
    docs = [
        (10, "x " + ", ".join(words[5:17]).upper() + " y"), (11, " ".join(words[5:16]) + " stop " + " ".join(words[16:20])), (12, "前" + "，".join(han[3:24]) + "后"), (13, han[3:22]), (14, None), (15, ""),
        (16, "z" * 300_000 + " " + "\n".join(words)), (17, "pre" + " ".join(words[:12])), (10, " ".join(words)), (18, han + " " + "_".join(words) + " " + "-".join(words)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, leakage.leaks(d, "doc_id", "text", i, "item_id", "text").collect()))
    assert got == [(10, 1), (10, 1), (12, 2), (16, 1), (18, 1), (18, 2)]
    assert leakage.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_leaks_of_chinese_items_by_their_language(spark):
    """Latin identifiers don't make a Chinese item one of words, and a passage of them needs no Han character."""
    mixed = "由于Lenkonti缺少加密信封，yanlencru-auth.Verifier_Rotation_Handler把密钥环与Louxlo合并，Yanlencru因此得到校验标签。"
    german = "Das Zeichen 密 steht hier nur als Zitat in der Datei"
    items = [(1, mixed, "zh"), (2, german, "de"), (3, mixed[::-1], None), (4, mixed, "zh-CN")]
    docs = [(10, "前文。缺少加密信封 yanlencru auth verifier，别的"), (11, "see yanlencru-auth.verifier rotation"), (12, german[:24] + "x"), (13, "yanlencru-auth verif"), (14, mixed[::-1][5:30]), (15, "vorab: " + german + " k a b")]

    def holds(text: str, item: str, chinese: bool) -> bool:
        if chinese:
            own, plain = (re.sub(r"[\W_]", "", x.lower()) for x in (item, text))
            return any(own[i : i + 20] in plain for i in range(len(own) - 19))
        own, plain = (re.findall(r"\w+", x.lower()) for x in (item, text))
        return any(own[i : i + 12] == plain[j : j + 12] for i in range(len(own) - 11) for j in range(len(plain) - 11))

    want = sorted((d, i) for d, text in docs for i, item, lang in items if holds(text, item, lang != "de"))
    assert {d for d, _ in want} == {10, 11, 14}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, lang string")
    assert sorted(map(tuple, leakage.leaks(d, "doc_id", "text", i, "item_id", "text", "lang").collect())) == want


def test_blocks_of_held_out_texts_give_the_same(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(40)) for _ in range(20)]
    docs = [(k, "start " + " ".join(texts[k % 20].split()[3 : 3 + 10 + k % 5]) + " end") for k in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    whole = sorted(map(tuple, leakage.leaks(d, "doc_id", "text", i, "item_id", "text").collect()))
    monkeypatch.setattr(leakage, "BLOCK", 1000)
    assert sorted(map(tuple, leakage.leaks(d, "doc_id", "text", i, "item_id", "text").collect())) == whole
    assert whole == [(k, k % 20) for k in range(60) if 10 + k % 5 >= leakage.WORDS]


def test_tables_of_patterns_take_the_stated_memory():
    import tracemalloc

    r = random.Random(5)
    # random letters share the fewest blocks, and windows of letters are more than windows of words
    items = [(k, " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 9))) for _ in range(600)), True) for k in range(40)]
    tracemalloc.start()
    kept = [leakage.WuManber(x, 5) for x in leakage.patterns(items)]
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept and size <= leakage.BYTES * sum(len(t) for _, t, _ in items)


def _cut(text: str) -> list[str]:
    return [text[a:b] for a, b in sentences.Splitter(sentences.train([])).split(text)]


def test_sentences():
    assert _cut("The value 3.14 is stored, e.g. in kit.py. It is hashed!  Why?\nBecause of Fig. 3 it\nis not.") == ["The value 3.14 is stored, e.g. in kit.py.", "It is hashed!", "Why?", "Because of Fig. 3 it\nis not."]
    assert _cut("# A heading. Still it\nText here...\n\n- item one. Two\n* item two\n12. third") == ["A heading. Still it", "Text here...", "item one.", "Two", "item two", "third"]
    assert _cut("Before.\n```py\na. b.\n\nc\n```\nAfter. End") == ["Before.", "```py\na. b.\n\nc\n```", "After.", "End"]
    assert _cut('He said "Stop. Now." and left. "Go first," it says, "then run." The end. (See it. Now.) Next. Wait... the key.') == ['He said "Stop. Now." and left.', '"Go first," it says, "then run."', "The end.", "(See it. Now.)", "Next.", "Wait... the key."]
    assert _cut("他说“先停。再走。”，然后离开。为什么？因为如此！") == ["他说“先停。再走。”，然后离开。", "为什么？", "因为如此！"]
    assert _cut("担当者は「安全ですか？」と尋ねた。次です。") == ["担当者は「安全ですか？」と尋ねた。", "次です。"]
    assert _cut("ระบบเก็บกุญแจไว้ ผู้ตรวจปฏิเสธแพตช์") == ["ระบบเก็บกุญแจไว้", "ผู้ตรวจปฏิเสธแพตช์"]
    assert _cut("यह लंबा है। kit के संस्करण में है।") == ["यह लंबा है।", "kit के संस्करण में है।"]
    assert _cut("„Bitte tauschen!“, steht da. „Danach.“ Nach Abschn. 7 ca. 5 Tage am 3. Mai.")[:2] == ["„Bitte tauschen!“, steht da.", "„Danach.“"]
    assert _cut("an \"open quote. Then more.") == ['an "open quote.', "Then more."]
    assert _cut("") == [] and _cut(" \n\t\n") == [] and sentences.Splitter(sentences.train([])).split(None) == []


def test_sentences_of_a_table(spark):
    rows = [(1, "One thing. Another thing.", 5), (2, None, 5), (3, "", 5), (4, "word " * 60_000 + ".", 5), (1, "One thing. Another thing.", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_char int")
    got = sorted(map(tuple, sentences.sentences(df, "doc_id", "text").collect()))
    assert got == [(1, 0, 10), (1, 0, 10), (1, 11, 25), (1, 11, 25), (4, 0, 300_001)]
    assert sentences.sentences(df.limit(0), "doc_id", "text").count() == 0


def test_classifier_on_held_out_boundaries(spark):
    """Trained on some documents, it agrees with the reliable boundaries of others."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    texts = [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").where("kind <> 'source' and text is not null").orderBy("doc_id").select("text").collect()]
    weights = sentences.train(sorted(c for t in texts[::2] for c in sentences.reliable(t)))
    splitter = sentences.Splitter(weights)
    held = [c for t in texts[1::2] for c in sentences.reliable(t)]
    right = sum(splitter.ends(b, a) == e for b, a, e in held)
    assert len(held) > 500 and right / len(held) > 0.98


def test_spans_are_ordered_and_cover_the_words():
    r = random.Random(1)
    parts = ["Word", "word", ".", "...", "!", "?", '"', "(", ")", "“", "”", "\n", "\n\n", "# ", "- ", "```", " ", " ", "中。", "No.", "3", ","]
    splitter = sentences.Splitter(sentences.train([]))
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        spans = splitter.split(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        kept = "".join(text[a:b] for a, b in spans)
        assert len(re.findall("[Ww]ord", kept)) == len(re.findall("[Ww]ord", text))
