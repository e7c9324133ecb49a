"""Problem 9: passages of held-out texts inside a training corpus.

Method: Wu-Manber multi-pattern search. Every window of consecutive words (for Chinese texts, of letters and digits)
of a held-out text is a pattern; block shift tables skip positions where no pattern can end, the hash of the last
block selects the patterns to try, and a direct comparison confirms the occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.plans.store import Store

#: Least number of consecutive words in common.
WORDS = 12
#: Least number of consecutive letters and digits in common with a Chinese text.
LETTERS = 20
#: The held-out texts are sent to every executor in blocks of about so many characters, one after the other. Tables of
#: patterns take up to BYTES a character (random letters, measured by a test), so a block takes up to 175 MB in a worker.
BLOCK, BYTES = 250_000, 700

_WORD = re.compile(r"\w+")
_LETTER = re.compile(r"[\W_]+")
_HAN = re.compile(r"[㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_KANA = re.compile(r"[぀-ヿ]")


class WuManber:
    """Search for any of many strings. A table of blocks says how far the next possible end of a pattern is."""

    def __init__(self, patterns: dict[str, list[int]], block: int):
        self.block = block
        self.least = min(map(len, patterns), default=0)
        self.shift: dict[str, int] = {}
        self.ending: dict[str, list[tuple[str, list[int]]]] = {}
        for pattern, owners in patterns.items():
            head = pattern[: self.least]
            for end in range(block, self.least + 1):
                part, far = head[end - block : end], self.least - end
                if far < self.shift.get(part, self.least):
                    self.shift[part] = far
            self.ending.setdefault(head[-block:], []).append((pattern, owners))
        # patterns of one bucket that begin alike are found by one lookup of their first letters
        self.buckets = {k: self._by_head(v) for k, v in self.ending.items()}
        self.skip = self.least - block + 1

    def _by_head(self, entries: list[tuple[str, list[int]]]) -> dict[str, list[tuple[str, list[int]]]]:
        heads: dict[str, list[tuple[str, list[int]]]] = {}
        for pattern, owners in entries:
            heads.setdefault(pattern[: self.least], []).append((pattern, owners))
        return heads

    def owners(self, text: str) -> set[int]:
        """The owners of all patterns that occur in ``text``."""
        found: set[int] = set()
        if not self.least:
            return found
        end, size, block, least, skip, shift = self.least, len(text), self.block, self.least, self.skip, self.shift.get
        while end <= size:
            far = shift(text[end - block : end], skip)
            if far:
                end += far
                continue
            start = end - least
            for pattern, owners in self.buckets[text[end - block : end]].get(text[start:end], ()):
                if text.startswith(pattern, start):
                    found.update(owners)
            end += 1
        return found


def spaced(text: str) -> str:
    """The words of a text in lower case, each between single spaces."""
    return f" {' '.join(_WORD.findall(text.lower()))} "


def joined(text: str) -> str:
    """The letters and digits of a text in lower case."""
    return _LETTER.sub("", text.lower())


def is_chinese(text: str, lang: str | None) -> bool:
    """Whether a held-out text counts as Chinese: by its language, or if that is unknown, by Han characters without kana."""
    if lang and lang.strip():
        return re.split(r"[-_]", lang.strip().lower())[0] in ("zh", "zho", "chi", "cmn", "chinese", "中文")
    return _HAN.search(text) is not None and not _KANA.search(text)


def patterns(items: list[tuple[int, str, bool]], words: int = WORDS, letters: int = LETTERS) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """The windows of held-out texts with their owners: those of words, and those of letters for Chinese texts."""
    by_word: dict[str, list[int]] = {}
    by_letter: dict[str, list[int]] = {}
    for owner, text, chinese in items:
        if chinese:
            plain = joined(text)
            windows, to = (plain[i : i + letters] for i in range(len(plain) - letters + 1)), by_letter
        else:
            own = _WORD.findall(text.lower())
            windows, to = (f" {' '.join(own[i : i + words])} " for i in range(len(own) - words + 1)), by_word
        for window in set(windows):
            to.setdefault(window, []).append(owner)
    return by_word, by_letter


_SEARCHES: dict[int, tuple[WuManber, WuManber]] = {}


def _search(items: list[tuple[int, str, bool]]) -> tuple[WuManber, WuManber]:
    key = hash(tuple(items))
    if key not in _SEARCHES:
        by_word, by_letter = patterns(items)
        _SEARCHES.clear()
        _SEARCHES[key] = WuManber(by_word, 5), WuManber(by_letter, 5)
    return _SEARCHES[key]


def leaks(docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, item_lang_col: str | None = None) -> DataFrame:
    """(``doc_col``, ``item_col``): each document with each held-out text that shares a passage with it, once.

    A passage is WORDS consecutive words (runs of letters, digits and underscores), or LETTERS consecutive letters
    and digits of a Chinese text; letter case and all other characters are ignored. A held-out text is Chinese if
    ``item_lang_col`` says so or, where that is null or not given, if it has Han characters and no kana. Null and empty
    documents, and held-out texts that are null or shorter than a passage, share none. Repeated rows give repeated
    pairs of the same kind, which are returned once per document row. Empty tables give no rows.

    The documents are read once a block of BLOCK characters of held-out texts, and never shuffled. The pairs of a block
    are written before the next is collected, so driver and executors hold one block, whatever the size of the query set.
    """
    spark = docs.sparkSession
    store = Store(spark, "leaks")
    lang = F.col(item_lang_col) if item_lang_col else F.lit(None).cast("string")
    held = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"), lang.alias("l")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = total // BLOCK + 1
    doc_type, item_type = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    result = None
    for block in range(blocks):
        part = held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        rows = spark.sparkContext.broadcast(sorted({(r["i"], r["t"], is_chinese(r["t"], r["l"])) for r in part.toLocalIterator()}))

        def find(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            by_word, by_letter = _search(rows.value)
            for batch in batches:
                ids, owners = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = by_word.owners(spaced(text)) if by_word.least else set()
                    if by_letter.least:
                        found |= by_letter.owners(joined(text))
                    ids += [i] * len(found)
                    owners += sorted(found)
                columns = [pa.array(ids, batch.column(0).type), pa.array(owners)]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.int64()) if item_type == "bigint" else columns[1]], names=[doc_col, item_col])

        texts = docs.select(doc_col, text_col).where(F.col(doc_col).isNotNull() & (F.length(text_col) > 0))
        found = store.write(texts.mapInArrow(find, f"`{doc_col}` {doc_type}, `{item_col}` {item_type}"), f"block-{block}")
        rows.destroy()
        result = found if result is None else result.unionByName(found)
    return result
