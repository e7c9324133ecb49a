"""Problem 6: source files that are not in the grammar of their language.

Method: a chunk of a file is a map from each lexer state at its start to the state at its end and a summary of its
unmatched brackets. Such maps combine associatively, so the chunks of long files are summarised in different
partitions and reduced by file. From the state and depth at the start of each chunk its top-level statements (of JSON,
the members of the outer value) are known, and are parsed on their own with local grammars wherever they lie. A file
whose summary or statements look broken is confirmed by its whole text, since only a parser knows strings in strings.
"""

from __future__ import annotations

import ast
import json
import re
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm import grammars
from auditlake.plans.store import Store

#: Characters of a chunk; longer files are summarised chunk by chunk. Least characters of a run of statements parsed at once.
CHUNK, PART = 1 << 20, 1 << 16

# Spellings of languages and the endings of their files.
_SPELLINGS = {
    "python": ("python", "python2", "python3", "py", "py3", "cpython"),
    "javascript": ("javascript", "js", "node", "nodejs", "ecmascript", "jsx", "mjs", "cjs"),
    "java": ("java",),
    "go": ("go", "golang"),
    "json": ("json",),
}
_ENDINGS = {"python": ("py", "pyw", "pyi"), "javascript": ("js", "mjs", "cjs", "jsx"), "java": ("java",), "go": ("go",), "json": ("json",)}

#: The states in which a line of a language can begin besides code, with what leaves them.
_STATES = {
    "python": {"'''": r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''", '"""': r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'},
    "javascript": {"/*": r"[\s\S]*?\*/", "`": r"(?:[^`\\]|\\[\s\S])*`"},
    "java": {"/*": r"[\s\S]*?\*/", '"""': r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'},
    "go": {"/*": r"[\s\S]*?\*/", "`": r"[^`]*`"},
    "json": {'"': r'(?:[^"\\]|\\[\s\S])*"'},
}
_LEAVE = {lang: {s: re.compile(p) for s, p in states.items()} for lang, states in _STATES.items()}
_LINE_STRING = r"""\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"""
_LEX = {
    lang: re.compile("|".join([*(re.escape(s) for s in states), *([] if lang == "json" else [_LINE_STRING, r"\#[^\n]*" if lang == "python" else r"//[^\n]*"]), r"[()\[\]{}]", "[\"']"]))
    for lang, states in _STATES.items()
}
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: How a line begins that starts a top-level statement, and what may not (or, for ``only``, must) come before it.
_STARTS = {
    "python": re.compile(r"^(?!(?:else|elif|except|finally)\b)[A-Za-z_@]", re.M),
    "javascript": re.compile(r"^(?:function|class|const|let|var|import|export|async)\b", re.M),
    "java": re.compile(r"^(?:public|private|protected|abstract|final|class|interface|enum)\b", re.M),
    "go": re.compile(r"^(?:func|type|var|const)\b", re.M),
}
_COMMA = re.compile(",")

#: state at the start of a chunk -> (state at its end, unmatched closing brackets, unmatched opening ones)
Summary = dict[str, tuple[str, str, str]]
_ERROR = "error"


def _scan(chunk: str, language: str, state: str) -> Iterator[tuple[str, int, int]]:
    """(what, start, end) of a chunk that begins in ``state``: brackets, stretches of code, ``error``, and at last the state."""
    at = 0
    search, leave = _LEX[language].search, _LEAVE[language]
    while True:
        if state:
            out = leave[state].match(chunk, at)
            if not out:
                yield f"end{state}", len(chunk), len(chunk)
                return
            at, state = out.end(), ""
        found = search(chunk, at)
        yield "code", at, found.start() if found else len(chunk)
        if not found:
            yield "end", len(chunk), len(chunk)
            return
        piece, at = found[0], found.end()
        if piece in leave:
            state = piece
        elif piece in "([{)]}":
            yield piece, found.start(), at
        elif piece in ('"', "'"):
            yield _ERROR, found.start(), at
            return


def _run(chunk: str, language: str, state: str) -> tuple[str, str, str]:
    """The end state and brackets of a chunk that begins in ``state``."""
    closed, opened = [], []
    for what, _, _ in _scan(chunk, language, state):
        if what == _ERROR:
            return _ERROR, "", ""
        if what.startswith("end"):
            return what[3:], "".join(closed), "".join(opened)
        if what == "code":
            continue
        if what not in _PAIRS:
            opened.append(what)
        elif not opened:
            closed.append(what)
        elif opened.pop() != _PAIRS[what]:
            return _ERROR, "", ""
    return _ERROR, "", ""


def _may_start(language: str, chunk: str, at: int) -> bool:
    """Whether what comes before a line lets a statement end there."""
    if language == "python":
        line = chunk.rfind("\n", 0, max(0, at - 1)) + 1
        while line < at and not chunk[line:at].strip() and line:
            at, line = line, chunk.rfind("\n", 0, line - 1) + 1
        own = chunk[line:at]
        return bool(own.strip()) and not own.lstrip().startswith(("@", "#")) and not own.rstrip("\r\n").endswith("\\")
    last = at - 1
    while last >= 0 and chunk[last].isspace():
        last -= 1
    if last < 0:
        return False
    return chunk[last] not in "=,+-*/&|<>:.([" if language == "go" else chunk[last] in ";}"


def cuts(chunk: str, language: str, state: str, depth: int) -> list[tuple[int, int]]:
    """(end of a part, start of the next) at the top level of a chunk that begins in ``state`` with ``depth`` open brackets.

    Parts are runs of whole statements, of JSON the members of the outer value, without the commas between them.
    """
    found: list[tuple[int, int]] = []
    level, pattern = (1, _COMMA) if language == "json" else (0, _STARTS[language])
    for what, start, end in _scan(chunk, language, state):
        if what == "code":
            if depth == level:
                for m in pattern.finditer(chunk, start, min(len(chunk), end + 1)):
                    if language == "json":
                        if m.start() < end:
                            found.append((m.start(), m.end()))
                    elif m.start() > 0 and chunk[m.start() - 1] == "\n" and m.start() <= end and _may_start(language, chunk, m.start()):
                        found.append((m.start(), m.start()))
        elif what in _PAIRS:
            depth -= 1
        elif what in "([{":
            depth += 1
    return list(dict.fromkeys(found))


def summarise(chunk: str, language: str) -> Summary:
    """The lexer-state map of a chunk that begins and ends with a line."""
    return {s: _run(chunk, language, s) for s in ("", *_STATES[language])}


def combine(a: Summary, b: Summary) -> Summary:
    """The map of two neighbouring chunks; associative."""
    out: Summary = {}
    for state, (middle, closed, opened) in a.items():
        if middle == _ERROR:
            out[state] = (_ERROR, "", "")
            continue
        end, closing, opening = b[middle]
        n = min(len(opened), len(closing))
        if end == _ERROR or any(_PAIRS[c] != o for c, o in zip(closing[:n], reversed(opened), strict=False)):
            out[state] = (_ERROR, "", "")
        else:
            out[state] = (end, closed + closing[n:], opened[: len(opened) - n] + opening)
    return out


def balanced(summary: Summary) -> bool:
    """Whether a whole file ends in code with all its brackets matched."""
    return summary[""] == ("", "", "")


def chunks(text: str, language: str = "python", size: int | None = None) -> list[str]:
    """A text in parts of about ``size`` characters that end with whole lines; JSON, which needs none, anywhere."""
    parts, at, size = [], 0, size or CHUNK
    while at < len(text):
        if language == "json":
            end = min(len(text), at + size)
            # an escape stays whole
            while end < len(text) and text[end - 1] == "\\":
                end += 1
            parts.append(text[at:end])
            at = end
            continue
        end = text.find("\n", at + size)
        while end > 0 and text[end - 1] == "\\":
            end = text.find("\n", end + 1)
        end = len(text) if end < 0 else end + 1
        parts.append(text[at:end])
        at = end
    return parts or [""]


def _python(text: str) -> bool:
    try:
        ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        if text.lstrip("\r\n\f")[:1] not in (" ", "\t"):
            return False
    except (RecursionError, MemoryError):
        return balanced(summarise(text, "python"))
    try:
        ast.parse(textwrap.dedent(text))
        return True
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return balanced(summarise(text, "python"))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _json(text: str) -> bool:
    try:
        json.loads(text, parse_int=str, parse_float=str, parse_constant=_no_constant)
        return True
    except ValueError:
        return False
    except RecursionError:
        return _deep_json(text)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _deep_json(text: str) -> bool:
    """Whether a text is JSON, by a stack instead of recursion, for documents that are nested too deep for the parser."""
    stack: list[str] = []
    wanted = "value"
    at, size = 0, len(text.rstrip(" \t\n\r"))
    while at < size:
        m = _JSON_TOKEN.match(text, at)
        if not m:
            return False
        at, mark, string = m.end(), m[1], m[2]
        if mark in ("{", "[") and wanted in ("value", "first"):
            stack.append(mark)
            wanted = "first" if mark == "[" else "name or end"
        elif mark == "]" and wanted in ("first", "next") and stack[-1:] == ["["] or mark == "}" and wanted in ("name or end", "next") and stack[-1:] == ["{"]:
            stack.pop()
            wanted = "next" if stack else "nothing"
        elif mark == "," and wanted == "next":
            wanted = "name" if stack[-1] == "{" else "value"
        elif mark == ":" and wanted == "colon":
            wanted = "value"
        elif string and wanted in ("name", "name or end"):
            wanted = "colon"
        elif not mark and wanted in ("value", "first"):
            wanted = "next" if stack else "nothing"
        else:
            return False
    return wanted == "nothing"


def parses(text: str, language: str) -> bool:
    """Whether a whole text is in its language's grammar; a leading byte order mark is ignored."""
    text = text.removeprefix("\ufeff")
    if language == "json":
        return _json(text)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _python(text) if language == "python" else grammars.is_well_formed(text, language)


def part_parses(text: str, language: str, first: bool, outer: str) -> bool:
    """Whether a run of top-level statements, or of members of an outer JSON value, is in the grammar."""
    if language == "json":
        return _json(f"[{text}]" if outer == "[" else f"{{{text}}}")
    if language == "python":
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return grammars.is_well_formed(text if first or language != "go" else f"package p\n{text}", language)


def language_of(spelling: Column) -> Column:
    """The language from any spelling; null for none or another."""
    low = F.lower(F.trim(spelling))
    found = F.lit(None).cast("string")
    for name, ways in _SPELLINGS.items():
        found = F.when(low.isin(*ways), name).otherwise(found)
    return found


def language_of_path(path: Column) -> Column:
    """The language from the ending of a path; Python if there is no path, null for another ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\s*$", 1))
    found = F.lit(None).cast("string")
    for name, ways in _ENDINGS.items():
        found = F.when(ending.isin(*ways), name).otherwise(found)
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", "python").otherwise(found)


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        broken = [not parses(t, lang) for t, lang in zip(batch["text"], batch["lang"], strict=True)]
        yield batch[["id", "field"]].assign(broken=broken)


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["id", "field", "at"]].assign(summary=[json.dumps(summarise(c, lang)) for c, lang in zip(batch["chunk"], batch["lang"], strict=True)])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            parts = chunks(row.text.removeprefix("\ufeff"), row.lang)
            yield pd.DataFrame({"row": row.row, "lang": row.lang, "at": range(len(parts)), "chunk": parts})


def _placed(part: pd.DataFrame) -> pd.DataFrame:
    """The state, depth and outer bracket with which each chunk of a file begins; none if the summaries don't add up."""
    columns = ["row", "at", "state", "depth", "last", "outer"]
    part = part.sort_values("at")
    maps = [json.loads(x) for x in part["summary"]]
    whole: Summary = {"": ("", "", "")}
    rows = []
    outer = part["outer"].iloc[0]
    for at, own in zip(part["at"], maps, strict=True):
        state, closed, opened = whole[""]
        rows.append((part["row"].iloc[0], at, state, len(opened), at == len(maps) - 1, outer))
        whole = combine(whole, own)
        if whole[""][0] == _ERROR or whole[""][1]:
            return pd.DataFrame([], columns=columns)
    return pd.DataFrame(rows if balanced(whole) else [], columns=columns)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts of each chunk; the first, number 0, goes on from the chunk before."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            text, ends = row.chunk, []
            begin, stop = 0, len(text)
            if row.lang == "json":
                begin = text.index(row.outer) + 1 if row.at == 0 else 0
                stop = len(text.rstrip()) - 1 if row.last else len(text)
            for end, start in cuts(text, row.lang, row.state, row.depth):
                if end - begin < PART:
                    continue
                ends.append(text[begin:end])
                begin = start
            ends.append(text[begin : max(begin, stop)])
            yield pd.DataFrame({"row": row.row, "lang": row.lang, "outer": row.outer, "at": row.at, "k": range(len(ends)), "text": ends})


def _statements(part: pd.DataFrame) -> pd.DataFrame:
    first = part.sort_values(["at", "k"])
    text, lang = "".join(first["text"]), first["lang"].iloc[0]
    # an empty outer value has one empty part
    empty = lang == "json" and not text.strip() and first["parts"].iloc[0] == 1
    ok = empty or lang == "json" and text.strip() != "" and part_parses(text, lang, False, first["outer"].iloc[0]) or lang != "json" and part_parses(text, lang, first["part"].iloc[0] == 0, "")
    return pd.DataFrame({"row": [first["row"].iloc[0]], "ok": [bool(ok)]})


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        summaries = [json.dumps(summarise(c, lang)) for c, lang in zip(batch["chunk"], batch["lang"], strict=True)]
        yield batch[["row", "at"]].assign(summary=summaries, outer=[c.lstrip()[:1] for c in batch["chunk"]])


def _long_verdicts(long: DataFrame, store: Store, out: str) -> DataFrame:
    """(id, field, broken) of files over a chunk: parts are parsed where they lie, and only what looks broken as a whole.

    A row is known by the number that its table gives it, so repeated and null identifiers stay apart.
    """
    long = store.write(long.withColumn("row", F.monotonically_increasing_id()), "long")
    pieces = store.write(long.mapInPandas(_pieces, "row long, lang string, at int, chunk string").repartition("row", "at"), "pieces")
    summaries = pieces.mapInPandas(_summaries, "row long, at int, summary string, outer string")
    placed = store.write(summaries.groupBy("row").applyInPandas(_placed, "row long, at int, state string, depth int, last boolean, outer string"), "placed")
    parts = pieces.join(placed, ["row", "at"]).where((F.col("lang") != "json") | F.col("outer").isin("[", "{"))
    parts = store.write(parts.mapInPandas(_parts, "row long, lang string, outer string, at int, k int, text string"), "parts")
    # numbers alone are ordered by file; a part is what lies between two starts
    upto = Window.partitionBy("row").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    numbers = parts.select("row", "at", "k", F.sum((F.col("k") > 0).cast("int")).over(upto).alias("part"))
    counts = numbers.groupBy("row").agg((F.max("part") + 1).alias("parts"))
    whole = parts.join(numbers, ["row", "at", "k"]).join(counts, "row")
    checked = whole.groupBy("row", "part").applyInPandas(_statements, "row long, ok boolean")
    good = store.write(checked.groupBy("row").agg(F.min("ok").alias("ok")).where("ok").select("row"), "good")
    fine = long.join(good, "row", "left_semi").select("id", "field", F.lit(False).alias("broken"))
    return fine.unionByName(long.join(good, "row", "left_anti").mapInPandas(_short, out))


def verdicts(df: DataFrame, id_col: str, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(``id_col``, field_name, broken): each value of ``values`` with its verdict.

    ``values`` gives each field by its text and its language. Values that are null, blank or in no known language
    have no row; rows with repeated or null identifiers each come out; an empty table gives no rows. Texts nested too
    deep for a parser are judged by their brackets, JSON by a stack. Texts up to CHUNK characters are checked where
    they are read; longer ones are spread over all tasks and parsed part by part.
    """
    store = Store(df.sparkSession, "syntax")
    kind = df.schema[id_col].dataType.simpleString()
    entries = F.array(*(F.struct(F.lit(name).alias("field"), text.alias("text"), lang.alias("lang")) for name, (text, lang) in values.items()))
    rows = df.select(F.col(id_col).alias("id"), F.explode(entries).alias("e")).select("id", "e.*")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"[^\s\ufeff]"))
    out = f"id {kind}, field string, broken boolean"
    found = rows.where(F.length("text") <= CHUNK).mapInPandas(_short, out)
    long = rows.where(F.length("text") > CHUNK)
    if not long.isEmpty():
        found = found.unionByName(_long_verdicts(long, store, out))
    return found.select(F.col("id").alias(id_col), F.col("field").alias("field_name"), "broken")


def rates(found: DataFrame) -> DataFrame:
    """(repo_key, lang, field_name, files, broken, rate) from rows of (repo_key, lang, field_name, broken)."""
    return found.groupBy("repo_key", "lang", "field_name").agg(F.count("*").alias("files"), F.count_if("broken").alias("broken"), F.avg(F.col("broken").cast("int")).alias("rate"))
