"""Problem 10: the sentences of every document, whatever its language and script.

Method: candidate boundaries are generated from the structure, the terminators and the quotations of a text; a
maximum-entropy classifier over neighbouring tokens, case, length, digits and script, trained on reliable
boundaries of the corpus itself, decides the ambiguous ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents whose reliable boundaries train the classifier: at most so many, drawn by the hash of their identifier.
TRAINING_DOCUMENTS = 6000
#: Kinds of cases (words around a full stop and its nature) that reach the driver, the most frequent ones.
TRAINING_KINDS = 200_000
#: Weights of the classifier, and passes over its training cases.
WEIGHTS, PASSES = 1 << 15, 60

# Abbreviations that another word follows, and months that an ordinal precedes.
_ABBREVIATIONS = frozenset(
    "approx appr fig figs no nos sec secs ch eq vol pp p cf vs e.g i.e dr mr mrs ms prof st jr sr sra ca bzw nr abschn abb vgl z b u a d h s bd usw.a hr fr"
    " m mm mme mlle cap pág págs núm aprox art ej dña им т прим см стр рис ред г тыс млн сек гл п е т.е".split()
)
_MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split()
)

_LINE = re.compile(r"[^\n]*(?:\n|\Z)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|(?=\r?\n|\Z))")
_ITEM = re.compile(r"[ \t]*(?:[-*+•][ \t]+|(\d{1,9})[.)][ \t]+)")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
# stops inside numbers, names and addresses, and empty parentheses, are no marks
_MARKS = re.compile(r"[\"“”„«»‹›「」『』（）\[\]【】]|\((?!\))|(?<!\()\)|[.!?…]++(?![A-Za-z0-9_])|[。！？｡．।॥؟۔]+[!?]*")
_CLOSER_OF = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", '"': '"'}
_CLOSERS = frozenset(_CLOSER_OF.values())
_TRAIL = "\"”’»)]）」』】"
_FULL = frozenset("。！？｡．।॥")
_THAI = re.compile(r"[฀-๿]")
_LETTER = re.compile(r"[^\W\d_]")
_OUTSIDE_WORD = frozenset("\"“”„«»()[]")
_WORD = re.compile(r"\S+")
_WORD_AFTER = re.compile(r"[^\s]+")


def _cjk(c: str) -> bool:
    return "　" <= c <= "鿿" or "＀" <= c <= "￯" or "\U00020000" <= c <= "\U0003ffff"


def _script(word: str) -> str:
    """The script of a word's last letter."""
    for c in reversed(word):
        if c.isalpha():
            o = ord(c)
            return "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "cyrillic" if 0x400 <= o < 0x530 else "other"
    return "none"


def _shape(word: str) -> str:
    """The kind of a following word, by its first letter or digit."""
    for c in word:
        if c.isdigit():
            return "digit"
        if c.islower():
            return "lower"
        if c.isupper():
            return "upper"
        if c.isalpha():
            return "uncased"
        if c in "\"“„«([（「":
            return "open"
        if c in ",;:-–—":
            return "joins"
    return "end" if not word else "mark"


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """The parts of a text that no sentence crosses, as (start, end, whole); ``whole`` ones are one sentence."""
    start = fence_start = -1
    fence = ""
    at, size = 0, len(text)
    while at < size:
        end = _LINE.match(text, at).end()
        line = text[at:end]
        mark = _FENCE.match(line) if "`" in line or "~" in line else None
        if fence:
            if mark and mark[1].startswith(fence) and not line[mark.end() :].strip():
                yield fence_start, end, True
                fence = ""
        elif mark:
            if start >= 0:
                yield start, at, False
                start = -1
            fence, fence_start = mark[1], at
        elif not line.strip():
            if start >= 0:
                yield start, at, False
                start = -1
        elif heading := _HEADING.match(line):
            if start >= 0:
                yield start, at, False
                start = -1
            yield at + heading.end(), end, True
        elif (item := _ITEM.match(line)) and not (start >= 0 and item[1] and _WORD_AFTER.match(line, item.end()) and _WORD_AFTER.match(line, item.end())[0].lower().strip(".,") in _MONTHS):
            if start >= 0:
                yield start, at, False
                start = -1
            yield at + item.end(), end, False
        elif start < 0:
            start = at
        at = end
    if fence:
        yield fence_start, size, True
    elif start >= 0:
        yield start, size, False


def _regions(marks: list[re.Match[str]]) -> list[tuple[int, int]]:
    """The outermost closed quotations and parentheses of a part by its marks, ends exclusive."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in marks:
        c = m[0]
        if c not in _CLOSER_OF and c not in _CLOSERS:
            continue
        level = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), -1) if c in _CLOSERS else -1
        if level >= 0:
            opened = stack[level][1]
            del stack[level:]
            # what lies inside is part of this one, even where an outer quotation never closes
            while found and found[-1][0] > opened:
                found.pop()
            found.append((opened, m.end()))
        elif c in _CLOSER_OF:
            stack.append((_CLOSER_OF[c], m.start()))
    return found


def _next_word(part: str, at: int) -> str:
    """The run without white space that follows a place, whatever lies between."""
    found = _WORD.search(part, at)
    return found[0] if found else ""


def _word_before(part: str, end: int) -> str:
    """The word that ends at a place, without quotes and brackets."""
    start = end
    while start and not part[start - 1].isspace() and part[start - 1] not in _OUTSIDE_WORD:
        start -= 1
    return part[start:end]


def candidates(part: str) -> Iterator[tuple[int, str, str, str]]:
    """Possible sentence ends inside a part: (end, kind, word before, word after).

    ``kind`` is "yes" for certain ones and "dot" for a full stop that the classifier decides; what certainly is no
    boundary is left out.
    """
    marks = list(_MARKS.finditer(part))
    regions = _regions(marks)
    at = 0
    inside = iter(regions)
    region = next(inside, None)
    size = len(part)
    letter, looked = "", 0
    for m in marks:
        if m.start() < at:
            continue
        c = m[0]
        while region and region[1] <= m.start():
            region = next(inside, None)
        if region and region[0] == m.start():
            at = region[1]
            inner = part[region[0] + 1 : region[1] - 1].rstrip()
            if not inner or inner[-1] not in ".!?…。！？؟।" or any(_cjk(x) for x in inner[-2:]) or _cjk(part[region[0]]):
                continue
            end = at
            while end < size and part[end] in _TRAIL:
                end += 1
            if end < size and not part[end].isspace():
                continue
            after = _next_word(part, end)
            if not after or _shape(after[:1]) not in ("lower", "joins") and not _cjk(after[0]):
                yield end, "yes", "", after
            continue
        if c[0] not in ".!?…。！？｡．।॥؟۔":
            continue
        end = m.end()
        while end < size and part[end] in _TRAIL:
            end += 1
        at = end
        after = _next_word(part, end)
        if c[0] in _FULL:
            yield end, "yes", "", after
            continue
        asian = m.start() > 0 and _cjk(part[m.start() - 1])
        if end < size and not part[end].isspace() and not (c[0] != "." and _cjk(part[end])) and not asian:
            continue
        # the last letter before the mark; each stretch between marks is looked at once
        letter = next((x for x in reversed(part[looked : m.start()]) if x.isalpha()), letter)
        looked = m.start()
        lower = after[:1].islower() and _script(letter) != "other"
        if c == ".":
            if after[:1] in (",", ";", ":"):
                continue
            yield end, "dot", _word_before(part, m.start()), after
        elif not lower and not (after[:1] in ",;:" and after):
            yield end, "yes", "", after


def _features(before: str, after: str) -> list[int]:
    """The hashed features of a full stop between two words."""
    word = before.lower().lstrip("'‘¿¡")
    follow = _WORD_AFTER.match(after)
    nxt = follow[0] if follow else ""
    shape, script = _shape(nxt), _script(word)
    letters = sum(map(str.isalpha, word))
    kind = "digits" if word.isdigit() else "inner" if "." in word else "letter" if len(word) == 1 else "mixed" if letters < len(word) else "word"
    length = min(len(word), 8)
    known = "abbreviation" if word in _ABBREVIATIONS else "plain"
    initial = bool(re.match(r"[^\W\d_]\.", nxt))
    month = kind == "digits" and len(word) <= 2 and nxt.lower().strip(".,") in _MONTHS
    same = "same" if _script(nxt) == script else "switch"
    names = (
        "bias", f"w={word}", f"w={word},n={shape}", f"n={shape},s={script}", f"k={kind},n={shape}", f"l={length},n={shape}", f"a={known},n={shape}",
        f"i={initial}", f"m={month}", f"c={before[:1].isupper()},n={shape},l={length}", f"s={script},{same},n={shape}", f"a={known},k={kind}",
    )
    return [zlib.crc32(x.encode()) % WEIGHTS for x in names]


def reliable(text: str) -> Iterator[tuple[str, str, bool]]:
    """Full stops whose nature is plain from the text: (word before, text after, ends a sentence)."""
    last = None
    for start, end, whole in blocks(text):
        part = text[start:end].strip()
        if last is not None and not whole and part:
            yield last, _next_word(part, 0), True
        last = None
        if whole or not part:
            continue
        for at, kind, before, after in candidates(part):
            if kind != "dot":
                continue
            word = before.lower()
            if at == len(part):
                last = before
                continue
            shape, follow = _shape(after[:1]), _WORD_AFTER.match(after)[0]
            if shape == "lower" and _script(before) in ("latin", "cyrillic"):
                yield before, after, False
            elif word in _ABBREVIATIONS and shape in ("digit", "upper", "lower", "open"):
                yield before, after, False
            elif re.match(r"[^\W\d_]\.", follow) and len(before) == 1:
                yield before, after, False
            elif word.isdigit() and len(word) <= 2 and follow.lower().strip(".,") in _MONTHS:
                yield before, after, False
            elif len(word) >= 6 and word.isalpha() and shape in ("upper", "open", "uncased"):
                yield before, after, True


def train(cases: list[tuple[str, str, bool]]) -> np.ndarray:
    """The weights of a maximum-entropy classifier of full stops; without cases, only lower case is no boundary."""
    kinds: dict[tuple[str, str, bool], int] = {}
    for before, after, ends in cases:
        follow = _WORD_AFTER.match(after)
        key = (before, follow[0] if follow else "", ends)
        kinds[key] = kinds.get(key, 0) + 1
    return train_kinds(kinds)


def train_kinds(kinds: dict[tuple[str, str, bool], int]) -> np.ndarray:
    """The weights from the kinds of cases and their numbers."""
    weights = np.zeros(WEIGHTS)
    if not kinds:
        return weights
    x = np.array([_features(b, a) for b, a, _ in kinds], np.int64)
    y = np.array([float(k[2]) for k in kinds])
    n = np.array(list(kinds.values()), float)
    n /= n.sum()
    square = np.full(WEIGHTS, 1e-8)
    for _ in range(PASSES):
        p = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1), -30, 30)))
        slope = np.bincount(x.ravel(), np.repeat((p - y) * n, x.shape[1]), WEIGHTS) + 1e-7 * weights
        square += slope**2
        weights -= 0.5 * slope / np.sqrt(square)
    return weights


class Splitter:
    """Cuts texts into sentences with the weights of a trained classifier."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.trained = bool(np.any(weights))
        self.known: dict[tuple[str, str], bool] = {}

    def ends(self, before: str, after: str) -> bool:
        """Whether a full stop ends a sentence."""
        if not after:
            return True
        follow = _WORD_AFTER.match(after)[0]
        if after[0].islower() and _script(before) != "other":
            return False
        key = (before, follow)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            if self.trained:
                found = float(self.weights[_features(before, after)].sum()) > 0
            else:
                found = before.lower() not in _ABBREVIATIONS
            self.known[key] = found
        return found

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """The sentences of a text as code point offsets, without white space at either end."""
        spans: list[tuple[int, int]] = []

        def add(start: int, end: int) -> None:
            part = text[start:end]
            inner = part.strip()
            if inner:
                left = start + len(part) - len(part.lstrip())
                spans.append((left, left + len(inner)))

        for start, end, whole in blocks(text or ""):
            if whole:
                add(start, end)
                continue
            part = text[start:end]
            cuts = [at for at, kind, before, after in candidates(part) if kind == "yes" or self.ends(before, after)]
            if _THAI.search(part) and 2 * len(_THAI.findall(part)) >= len(_LETTER.findall(part)):
                closed = _regions(list(_MARKS.finditer(part)))
                cuts += [m.start() for m in re.finditer(r"[ \t]+", part) if not any(a < m.start() < b for a, b in closed)]
                cuts = sorted(set(cuts))
            last = 0
            for at in cuts:
                add(start + last, start + at)
                last = at
            add(start + last, end)
        return spans


def fit(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Weights from the reliable boundaries of at most TRAINING_DOCUMENTS documents, spread over the corpus.

    Equal cases are counted before they are collected, and at most TRAINING_KINDS kinds are.
    """
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    total = rows.count()
    steps = 1_000_000
    part = rows.where(F.pmod(F.xxhash64("i"), F.lit(steps)) < max(1, int(steps * min(1.0, 0.9 * TRAINING_DOCUMENTS / max(1, total)))))

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for text in batch.column(0).to_pylist() for c in reliable(text)]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)], names=["b", "a", "e"])

    sample = part.limit(TRAINING_DOCUMENTS).select("t").mapInArrow(cases, "b string, a string, e boolean")
    counted = sample.groupBy("b", "a", "e").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "b", "a", "e").limit(TRAINING_KINDS)
    return train_kinds(dict(sorted(((r["b"], r["a"], r["e"]), r["n"]) for r in counted.toLocalIterator())))


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, start_char, end_char): the sentences of every document, end exclusive.

    A heading, and a fenced code block with its fences, are one sentence; a list item starts a new one and ends with
    its line; a blank line ends one and a single line break doesn't. A quotation or parenthesis is never divided. Null,
    empty and blank texts have no sentences; repeated documents each have theirs; an empty table gives no rows.

    The texts are read once for the sample of the classifier and once to be cut; they are not shuffled.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(weights.value)
        for batch in batches:
            rows, starts, ends = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for start, end in splitter.split(text):
                    rows.append(row)
                    starts.append(start)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[id_col, "start_char", "end_char"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.where(F.length(text_col) > 0).select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, start_char long, end_char long")
