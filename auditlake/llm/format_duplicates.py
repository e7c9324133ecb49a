"""Problem 3: records that differ only in layout, letter case, punctuation or the order of JSON members.

Method: every record gets a canonical key (a 128-bit digest of its letters and digits, JSON members sorted); hot keys
are detected exactly from partial counts and aggregated in two salted levels, all other keys in one; the
representative of a group is its smallest identifier.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditlake.plans.skew import two_level_agg
from auditlake.plans.store import Store

_NOT_ALNUM = re.compile(r"[\W_]+")
_LENIENT = re.compile(r"""[{}\[\],]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^{}\[\],"']+|.""", re.S)


def _plain(text: str) -> str:
    return _NOT_ALNUM.sub("", text.lower())


def _flat(value: object) -> str:
    """The canonical text of a value whose objects are canonical texts already."""
    if isinstance(value, str):
        return _plain(value)
    if isinstance(value, list):
        return "".join(map(_flat, value))
    return {True: "true", False: "false", None: "null"}[value]


def _members(pairs: list[tuple[str, object]]) -> str:
    return "".join(sorted(_plain(k) + _flat(v) for k, v in pairs))


def _lenient(text: str) -> str | None:
    """The canonical text of JSON with other quotes or trailing commas; None if its brackets don't balance."""
    stack: list[tuple[str, list[str], list[str]]] = []
    kind, done, member = "", [], []
    for token in _LENIENT.findall(text):
        if token in "{[":
            stack.append((kind, done, member))
            kind, done, member = token, [], []
        elif token in "}]":
            if kind + token not in ("{}", "[]"):
                return None
            done.append("".join(member))
            inner = "".join(sorted(done) if kind == "{" else done)
            kind, done, member = stack.pop()
            member.append(inner)
        elif token == ",":
            done.append("".join(member))
            member = []
        else:
            member.append(_plain(token))
    return None if stack else "".join(done + member)


def canonical_json(text: str) -> str:
    """Letters and digits of ``text`` in lower case, members of JSON objects in sorted order at any depth."""
    body = text.strip().lstrip("﻿")
    try:
        return _flat(json.loads(body, object_pairs_hook=_members, parse_int=str, parse_float=str, parse_constant=str))
    except (ValueError, RecursionError):
        found = _lenient(body)
        return _plain(text) if found is None else found


@F.pandas_udf(StringType())
def _canonical_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: None if x is None else canonical_json(x))


def canonical_key(code: Column) -> Column:
    """A 16-byte digest of the canonical form; null if there is no letter or digit.

    Only text that begins like a JSON document reaches a Python worker; all else is reduced in the JVM.
    """
    is_json = code.rlike(r"^[\s﻿]*[{\[]")
    plain = F.regexp_replace(F.lower(code), r"[^\p{L}\p{N}]+", "")
    text = F.when(is_json, _canonical_json(F.when(is_json, code))).otherwise(plain)
    return F.when(F.length(text) > 0, F.unhex(F.md5(text)))


def collapse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct canonical text of ``df``: (``id_col``, copies).

    ``id_col`` is the smallest identifier of the group and ``copies`` its number of rows; rows with equal identifiers
    count one each. Rows whose text is null, empty or without letters and digits form no group; an empty table gives
    no rows. Other columns of ``df`` are ignored, whatever their names.
    """
    store = Store(df.sparkSession, "collapse")
    rows = df.select(F.col(id_col).alias("_id"), canonical_key(F.col(text_col)).alias("_key"))
    keyed = store.write(rows.where(F.col("_key").isNotNull()), "keyed")
    groups = two_level_agg(
        keyed,
        "_key",
        "_id",
        [F.min("_id").alias("first"), F.count("*").alias("copies")],
        [F.min("first").alias("first"), F.sum("copies").alias("copies")],
    )
    return groups.select(F.col("first").alias(id_col), "copies")
