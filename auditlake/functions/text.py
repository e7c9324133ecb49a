"""Text functions: normal forms, digests, identifiers, lines, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, with the separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Everything that ends a line; a carriage return and line feed end one together.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The language of a file by its suffix.
LANGUAGES = {"py": "python", "pyw": "python", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "json": "json"}


def no_space(text: Column) -> Column:
    """The text without any white space; letter case is kept."""
    return F.regexp_replace(text, SPACE, "")


def collapsed(text: Column) -> Column:
    """The text in lower case, white space runs as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def digest(text: Column) -> Column:
    """SHA-256 of the collapsed text; empty for null and empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.sha2(collapsed(text), 256)).otherwise("")


def slug(text: Column, longest: int = 48) -> Column:
    """Lower case, runs of other than letters and digits as one dash, at most ``longest`` characters."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, longest)


def content_id(repo: Column, text: Column, tag: Column) -> Column:
    """An identifier from the slug of a repository, eight digits of the text's SHA-1 and a tag."""
    return F.concat_ws("-", slug(repo), F.substring(F.sha1(no_space(text)), 1, 8), tag)


def local_id(*parts: Column) -> Column:
    """Twelve digits of the SHA-1 of the parts joined by bars; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 12)


def cwe(value: Column) -> Column:
    """``CWE-`` and at least three digits from the first number in a value; empty if there is none."""
    number = F.regexp_extract(F.upper(F.trim(value)), r"(?:CWE[-_ ]?)?(\d{1,4})", 1)
    return F.when(number != "", F.format_string("CWE-%03d", number.try_cast("int"))).otherwise("")


def cwe_list(value: Column) -> Column:
    """The distinct CWE identifiers of a list separated by commas, semicolons or bars, in order."""
    parts = F.transform(F.split(value, r"[;,|]"), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x.startswith("CWE-")))


def lines(text: Column) -> Column:
    """The lines of a text; an end at the very end adds none, null and empty text have none."""
    last = F.substring(text, -1, 1).isin("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
    cut = F.when(text.endswith("\r\n"), 2).when(last, 1).otherwise(0)
    body = F.when(cut > 0, text.substr(F.lit(1), F.length(text) - cut)).otherwise(text)
    return F.when(F.length(text) > 0, F.split(body, LINE_END)).otherwise(F.array().cast("array<string>"))


def estimated_tokens(text: Column) -> Column:
    """A quarter token for each ASCII character and two thirds for each other one, rounded up, at least 1."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.ceil((F.length(text) - other) / 4.0 + other / 1.5)).cast("int")


def bounded(text: Column, longest: int, notice: str = "\n[truncated]") -> Column:
    """The text, cut after ``longest`` characters with a notice."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(notice))).otherwise(text)


def language(path: Column) -> Column:
    """The language by the suffix of a path; ``text`` for any other."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("text")
    for name in dict.fromkeys(LANGUAGES.values()):
        out = F.when(suffix.isin(*(s for s, n in LANGUAGES.items() if n == name)), name).otherwise(out)
    return out


def language_name(spelling: Column) -> Column:
    """The language from any spelling of its name, in lower case; py, python3 and the like are python."""
    low = F.lower(F.trim(spelling))
    return F.when(low.rlike(r"^(c?python|py)[ .0-9]*$"), "python").otherwise(low)


def path_kind(path: Column) -> Column:
    """``unknown``, ``conftest``, ``test`` or ``production``, in this order."""
    plain = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    # fixed value: the folders and names of test code
    test = r"(?i)(^|/)(tests?|testing|testdata|test_data|fixtures?|examples?|docs?|benchmarks?|samples?)(/|$)|(^|/)test_[^/]*\.py$|(^|/)[^/]*_test\.py$"
    return F.when(plain == "", "unknown").when(plain.rlike(r"(?i)(^|/)conftest\.py$"), "conftest").when(plain.rlike(test), "test").otherwise("production")


def safe_name(name: Column, fallback: str = "snippet.txt") -> Column:
    """The last part of a path with only letters, digits, dots, dashes and underscores."""
    last = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]+", "_")
    last = F.regexp_replace(last, r"^[._]+", "")
    return F.when(F.coalesce(last, F.lit("")) == "", fallback).otherwise(last)


def patch_side(patch: Column, side: str) -> Column:
    """The text before (``-``) or after (``+``) a unified diff: its context lines and those of the side."""
    body = F.filter(lines(patch), lambda x: ~x.rlike(r"^(@@|diff |index |--- |\+\+\+ |\\)"))
    kept = F.filter(body, lambda x: x.startswith(" ") | x.startswith(side) | (x == ""))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def without_line_numbers(text: Column) -> Column:
    """The text without ``NN:`` before its lines, if at least half of the lines that aren't blank have one."""
    own = lines(text)
    full = F.filter(own, lambda x: F.trim(x) != "")
    numbered = F.filter(full, lambda x: x.rlike(r"^\s*\d+:"))
    cut = F.array_join(F.transform(own, lambda x: F.regexp_replace(x, r"^\s*\d+: ?", "")), "\n")
    return F.when((F.size(numbered) > 0) & (F.size(numbered) * 2 >= F.size(full)), cut).otherwise(text)


def severity(value: Column, default: str = "MEDIUM") -> Column:
    """A severity in upper case; WARNING is MEDIUM, ERROR is HIGH, and any other is the default."""
    up = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(up == "WARNING", "MEDIUM").when(up == "ERROR", "HIGH").when(up.isin("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"), up).otherwise(default)


def verdict(value: Column) -> Column:
    """``Confirm`` or ``Reject`` if the text contains it in any case, else ``?``."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low.contains("confirm"), "Confirm").when(low.contains("reject"), "Reject").otherwise("?")


def rule_id(check_id: Column) -> Column:
    """The rule in a scanner's check id: an embedded ``CRYPTO-000``, else what follows the last dot."""
    inner = F.upper(F.regexp_extract(check_id, r"(?i)(crypto-\d{3})", 1))
    return F.when(inner != "", inner).otherwise(F.element_at(F.split(check_id, r"\."), -1))


def confidence(value: Column) -> Column:
    """low, medium and high as 0.3, 0.6 and 0.9; a number within 0 and 1; else 0.5."""
    low = F.lower(F.trim(value))
    number = low.try_cast("double")
    return F.when(low == "low", 0.3).when(low == "medium", 0.6).when(low == "high", 0.9).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), F.lit(0.5)))


def utc_seconds(time: Column | None = None) -> Column:
    """A time, now by default, as ISO 8601 in UTC with whole seconds."""
    at = F.current_timestamp() if time is None else time
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
