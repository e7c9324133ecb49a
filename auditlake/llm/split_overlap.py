"""Problem 2: records of evaluation splits that occur, exactly or almost, in the training split.

Method: prefix filter. The words of each record are put in one order for all records, rarest first; two records that
agree in enough words must share some of the rarest ones, and how many follows from their lengths. Pairs that share
enough of these are then compared word by word. No pair that is similar enough is lost.

Beside the pairs, content-defined chunks say how much of each evaluation record occurs in training: a rolling hash cuts
the words of a record, chunk digests are joined across the splits, and the lengths of shared chunks are summed into an
overlap fraction for each record. Chunks alone can't find the pairs, since edits may touch every chunk of a record.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.store import Store

#: Words of at least FREQUENT of about SAMPLE records are ordered by that number, and at most MOST_FREQUENT of them; all
#: others come before them. Any order gives the same result, only the number of comparisons differs.
FREQUENT, SAMPLE, MOST_FREQUENT = 4, 20_000, 200_000
#: Buckets by which the records of candidate pairs are told from all others, so that only their words are shuffled.
BUCKETS = 1 << 20
#: Words over which the rolling hash runs, and the average length of a chunk in words.
WINDOW, CHUNK = 3, 8
#: Least fraction of common words for two records to be the same.
SIMILARITY = 0.8

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _in_order(value: object) -> str:
    """The text of a JSON value with the members of its objects in order of their names."""
    if isinstance(value, dict):
        return " ".join(f"{k} {_in_order(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].lower().replace("_", "")))
    if isinstance(value, list):
        return " ".join(map(_in_order, value))
    return value if isinstance(value, str) else {True: "true", False: "false", None: "null"}[value]


def words(text: str) -> list[str]:
    """The words of a record in lower case, without underscores; JSON in order of its member names."""
    if text.lstrip("﻿ \t\r\n")[:1] in ("{", "["):
        try:
            text = _in_order(json.loads(text.strip().lstrip("﻿"), parse_int=str, parse_float=str, parse_constant=str))
        except (ValueError, RecursionError):
            pass
    return _WORD.findall(text.lower().replace("_", ""))


def _word_hashes(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word hashes of all texts in a row, the number of words of each, and each text's digest."""
    if len(known) > 500_000:
        known.clear()
    flat: list[int] = []
    sizes, digests = [], []
    for text in texts:
        found = words(text)
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w.encode())
            flat.append(h)
        sizes.append(len(found))
        digests.append(blake2b(" ".join(found).encode(), digest_size=16).digest())
    return np.array(flat, np.uint64), np.array(sizes, np.int64), digests


def _bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The multiset of a record's words as distinct 32-bit hashes: the n-th occurrence of a word has one of its own."""
    known: dict[str, int] = {}
    for part in parts:
        hashes, sizes, digests = _word_hashes(part["text"].tolist(), known)
        bags = []
        for own in np.split(hashes, np.cumsum(sizes)[:-1]):
            own = np.sort(own)
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            nth = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(own)]))))
            with np.errstate(over="ignore"):
                bags.append((((own + nth.astype(np.uint64) * _ODD) * _ODD) >> np.uint64(32)).astype(np.uint32).view(np.int32))
        part = part.drop(columns="text").assign(record=digests, n=sizes, bag=bags)
        yield part[part["n"] > 0]


def prefix_length(n: int) -> int:
    """The words of a record of ``n`` among which is one of every record that is similar enough, in any common order."""
    # the shortest such record has n * s / (2 - s) words, all of them in common
    return n - math.ceil(n * SIMILARITY / (2 - SIMILARITY) - 1e-6) + 1


def _pairs_of_records(records: DataFrame, bags: DataFrame, store: Store) -> DataFrame:
    """(x, y, nx, ny): different distinct records, x in training and y in evaluation, that may be similar enough.

    Of two records of which ``least`` words must be in common, the first k common ones in the order are among the first
    n - least + k of each, and none has too many words before it in one record and too few behind it in the other.
    """
    spark = records.sparkSession
    parts = bags.select(F.lit(1)).count() // SAMPLE + 1
    sample = bags.where(F.pmod(F.xxhash64("rep"), F.lit(parts)) == 0)
    counts = sample.select(F.explode("bag").alias("word")).groupBy("word").agg(F.count("*").alias("records")).where(F.col("records") >= FREQUENT)
    most = counts.orderBy(F.desc("records"), "word").limit(MOST_FREQUENT).toPandas().sort_values("word")
    order = spark.sparkContext.broadcast((most["word"].to_numpy(np.int32), most["records"].to_numpy(np.int64)))

    def prefixes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, often = order.value
        for part in parts:
            firsts = []
            for own in part["bag"]:
                own = np.asarray(own, np.int32)
                rank = np.zeros(len(own), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    rank = np.where(frequent[at] == own, often[at], 0)
                firsts.append(own[np.lexsort((own, rank))[: prefix_length(len(own))]])
            yield part[["rep"]].assign(n=part["bag"].map(len), first=firsts)

    first = store.write(bags.mapInPandas(prefixes, "rep long, n int, first array<int>"), "prefixes").join(records.select("rep", "in_train", "in_eval"), "rep")
    train = first.where("in_train").select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.posexplode("first").alias("px", "word"))
    held = first.where("in_eval").select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.posexplode("first").alias("py", "word"))
    nx, ny, px, py = (F.col(c) for c in ("nx", "ny", "px", "py"))
    least = F.ceil((nx + ny) * (SIMILARITY / 2) - 1e-6)
    # k grows with what the prefixes have to spare, so that more common words are asked for where more can be seen
    spare = least - F.ceil(F.greatest(nx, ny) * (SIMILARITY / (2 - SIMILARITY)) - 1e-6)
    shared = train.join(held, "word").where((F.col("x") != F.col("y")) & (F.least(nx, ny) >= least)).withColumn("k", 1 + F.floor(spare / 4)).where(
        (px < nx - least + F.col("k")) & (py < ny - least + F.col("k")) & (F.least(px, py) + F.least(nx - px, ny - py) >= least)
    )
    shared = shared.groupBy("x", "y", "nx", "ny", "k").agg(F.count("*").alias("shared"))
    return store.write(shared.where(F.col("shared") >= F.col("k")).select("x", "y", "nx", "ny"), "candidates")


def overlap_classes(df: DataFrame, id_col: str, text_col: str, in_train: Column, in_eval: Column) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts that overlap, (x, y, similarity), x in training and y in evaluation, and the members of all
    classes, (id, in_train, in_eval, rep); a class is known by its smallest identifier.

    Similarity is twice the common words, as multisets of 32-bit hashes, over all words of both. A class with rows on both
    sides overlaps itself.
    """
    store = Store(df.sparkSession, "overlap")
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(in_train, F.lit(False)).alias("in_train"), F.coalesce(in_eval, F.lit(False)).alias("in_eval"), F.col(text_col).alias("text")).where(
        (F.col("in_train") | F.col("in_eval")) & F.col("text").rlike(r"\w|[^\x00-\x7f]")
    )
    rows = store.write(texts.mapInPandas(_bags, "id long, in_train boolean, in_eval boolean, record binary, n int, bag array<int>"), "rows")
    records = store.write(rows.groupBy("record").agg(F.min("id").alias("rep"), F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval")), "records")
    chosen = records.select("record", F.col("rep").alias("id"))
    # rows that are delivered twice under one identifier have their bag twice here, which adds candidates but no results
    bags = store.write(rows.select("id", "record", "bag").join(chosen, ["record", "id"], "left_semi").select(F.col("id").alias("rep"), "bag"), "bags")
    candidates = _pairs_of_records(records, bags, store)
    # at most BUCKETS rows, so they may be broadcast, whatever the number of candidates
    bucket = F.pmod(F.xxhash64("rep"), F.lit(BUCKETS)).cast("int").alias("bucket")
    wanted = candidates.select(F.explode(F.array("x", "y")).alias("rep")).select(bucket).distinct()
    bags = bags.select("rep", "bag", bucket).join(F.broadcast(wanted), "bucket", "left_semi")
    x, y = (bags.select(F.col("rep").alias(c), F.col("bag").alias(f"bag_{c}")) for c in "xy")
    similarity = F.size(F.array_intersect("bag_x", "bag_y")) * 2 / (F.col("nx") + F.col("ny"))
    same = candidates.join(x, "x").join(y, "y").select("x", "y", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY).distinct()
    alike = records.where(F.col("in_train") & F.col("in_eval")).select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("similarity"))
    members = rows.select("id", "in_train", "in_eval", "record").join(records.select("record", "rep"), "record").select("id", "in_train", "in_eval", "rep")
    found = store.write(same.unionByName(alike), "classes"), store.write(members, "members")
    store.keep("classes", "members")
    return found


def overlaps(df: DataFrame, id_col: str, text_col: str, in_train: Column, in_eval: Column) -> DataFrame:
    """(train_id, eval_id): each training row with each evaluation row of the same text.

    The same are records that agree in at least SIMILARITY of their words (twice the common words, as a multiset,
    over all words of both), whatever their layout, case, punctuation and order of JSON members. Rows that are
    neither training nor evaluation (null counts as neither), and rows with null, blank or wordless text, have no
    pairs. Rows may be in both sides, but never pair with themselves. Copies are compared once, as classes, and only this
    result expands them; an empty table gives no rows.
    """
    classes, members = overlap_classes(df, id_col, text_col, in_train, in_eval)
    train = members.where("in_train").select(F.col("rep").alias("x"), F.col("id").alias("train_id"))
    held = members.where("in_eval").select(F.col("rep").alias("y"), F.col("id").alias("eval_id"))
    pairs = classes.select("x", "y").join(train, "x").join(held, "y")
    return pairs.where(F.col("train_id") != F.col("eval_id")).select("train_id", "eval_id")


def chunks(text: str) -> list[tuple[int, int]]:
    """(digest, words) of the content-defined chunks of a record: a chunk ends where the hash of its last words says so."""
    found = words(text)
    hashes = [zlib.crc32(w.encode()) for w in found]
    out, start = [], 0
    for end in range(1, len(found) + 1):
        rolling = zlib.crc32(b"".join(h.to_bytes(4, "little") for h in hashes[max(start, end - WINDOW) : end]))
        if rolling % CHUNK == 0 or end == len(found):
            digest = blake2b(" ".join(found[start:end]).encode(), digest_size=8).digest()
            out.append((int.from_bytes(digest, "little", signed=True), end - start))
            start = end
    return out


def _chunked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [chunks(t) for t in part["text"]]
        yield part.drop(columns="text").assign(digests=[[d for d, _ in x] for x in found], sizes=[[n for _, n in x] for x in found])


def overlap_fractions(df: DataFrame, id_col: str, text_col: str, in_train: Column, in_eval: Column) -> DataFrame:
    """(eval_id, words, shared, overlap): how many words of each evaluation row lie in chunks that training rows have too.

    Rows without words have no row here; rows in both sides, repeated identifiers and empty tables are as in
    ``overlaps``, but a row in both sides shares all chunks with itself. Distinct training chunks are what is joined, so
    a chunk that a third of all rows share is one row.
    """
    store = Store(df.sparkSession, "chunks")
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(in_train, F.lit(False)).alias("in_train"), F.coalesce(in_eval, F.lit(False)).alias("in_eval"), F.col(text_col).alias("text"))
    texts = texts.where((F.col("in_train") | F.col("in_eval")) & F.col("text").rlike(r"\w|[^\x00-\x7f]"))
    rows = texts.mapInPandas(_chunked, "id long, in_train boolean, in_eval boolean, digests array<long>, sizes array<int>")
    rows = store.write(rows.where(F.size("digests") > 0).withColumn("row", F.monotonically_increasing_id()), "rows")
    known = rows.where("in_train").select(F.explode("digests").alias("digest")).distinct().withColumn("known", F.lit(True))
    held = rows.where("in_eval").select("row", "id", F.explode(F.arrays_zip("digests", "sizes")).alias("c")).select("row", "id", F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"))
    sums = held.join(known, "digest", "left").groupBy("row", "id").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("shared"))
    return sums.select(F.col("id").alias("eval_id"), "words", "shared", (F.col("shared") / F.col("words")).alias("overlap"))
