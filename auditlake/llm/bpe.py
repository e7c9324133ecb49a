"""Problem 8: encoding of every text with a public byte-level BPE vocabulary.

Method: a backtracking encoder. Aho-Corasick finds the longest token at each position; a token is kept only if the
pair-compatibility table says that the merges of both would have left it beside its neighbour, and a dead end goes
back to a shorter token. The result is exactly that of the merges, in linear time. Decoding uses an offset table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Segments and pieces that a worker remembers; beyond that it forgets them all.
REMEMBERED = 300_000


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary file stands for: itself if printable, else letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """The tables of one vocabulary file and the encoder over them."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if all(c in letters for c in word)}
        self.ids = ids
        self.size = max(ids.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = token
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            left, right = (ids[bytes(letters[c] for c in half)] for half in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[self.tokens[left] + self.tokens[right]]
            self.merged[left, right] = whole
            self.halves.setdefault(whole, (left, right))
        #: merge order: single bytes come first, in any order
        self.rank = {i: n for n, i in enumerate(sorted(ids.values(), key=lambda i: (i in self.halves, i)))}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PIECES).findall
        # No piece goes past the start of the last white space before other text, so text is first cut there, by the
        # faster engine and the other engine's white space, and the ids of each segment are remembered.
        space = re.escape("".join(regex.findall(r"\s", "".join(map(chr, range(0x3001))))))
        self.segments = re.compile(f"[{space}]?[^{space}]+(?:[{space}]+(?![^{space}]))?|[{space}]+(?![^{space}])|[{space}]+").findall
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        #: decoding: token i is bytes offset[i] to offset[i + 1] of the joined vocabulary
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.joined = b"".join(self.tokens)

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 for a single byte."""
        if token not in self.shorter:
            text = self.tokens[token]
            self.shorter[token] = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
        return self.shorter[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side.

        The merges are undone from the latest one back: at each step the halves that then touched must not have
        merged earlier than the half that was made of them.
        """
        known = self.compatible.get((left, right))
        if known is None:
            a, b, until, rank = left, right, 1 << 60, self.rank
            while True:
                whole = self.merged.get((a, b))
                if whole is not None and rank[whole] < until:
                    known = False
                    break
                undo_left = a in self.halves and (b not in self.halves or rank[a] > rank[b])
                if undo_left:
                    until, a = rank[a], self.halves[a][1]
                elif b in self.halves:
                    # at equal rank the left one merges first, so a merge of the right one's rank still comes in time
                    until, b = rank[b] + 1, self.halves[b][0]
                else:
                    known = True
                    break
            if len(self.compatible) > 4 * REMEMBERED:
                self.compatible.clear()
            self.compatible[left, right] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece of text."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        if whole is not None and (whole not in self.halves or self._is_own(whole)):
            return [whole]
        size, known = len(data), self.compatible
        # matches come by their end, the longest first, so the last one stored for a start is the longest from there
        longest = [(0, -1)] * size
        for end, found in self.automaton.iter(data.decode("latin-1")):
            longest[end - found[0] + 1] = found
        ids: list[int] = []
        starts: list[int] = []
        closed: set[int] = set()
        at, last = 0, -1
        length, token = longest[0]
        while True:
            end = at + length
            if end not in closed:
                fits = last < 0 or known.get((last, token))
                if fits is None:
                    fits = self._compatible(last, token)
                if fits:
                    ids.append(token)
                    if end == size:
                        return ids
                    starts.append(at)
                    at, last = end, token
                    length, token = longest[at]
                    continue
            token = self._shorter(token)
            while token < 0:
                closed.add(at)
                token, at = self._shorter(ids.pop()), starts.pop()
                last = ids[-1] if ids else -1
            length = len(self.tokens[token])

    def _is_own(self, token: int) -> bool:
        """Whether the merges of a token's text give the token itself."""
        return self._compatible(*self.halves[token])

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for null and empty text."""
        ids: list[int] = []
        if text:
            known = self.known
            for segment in self.segments(text):
                found = known.get(segment)
                if found is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    found = []
                    for piece in self.split(segment):
                        own = known.get(piece)
                        if own is None:
                            own = self.encode_piece(piece)
                            if len(piece) <= 64:
                                known[piece] = own
                        found += own
                    if len(segment) <= 64:
                        known[segment] = found
                ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids that were made by ``encode``."""
        return b"".join(self.joined[self.offsets[i] : self.offsets[i + 1]] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary_file: str) -> DataFrame:
    """(``id_col``, ids): every row of ``df`` with the ids of its text by a byte-level BPE vocabulary.

    Null and empty text give an empty list; strings of special tokens are ordinary text; rows with a null or repeated
    identifier come out as often as they go in. There is no shuffle. The vocabulary file (a few MB, whatever the
    corpus) is read by the driver and sent to each executor once.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        vocabulary = df.sparkSession.sparkContext.broadcast(file.read())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        for part in parts:
            flat: list[int] = []
            offsets = [0]
            for text in part.column(1).to_pylist():
                flat += own.encode(text)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    rows = df.select(F.col(id_col), F.col(text_col))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(batches, f"`{id_col}` {kind}, ids array<int>")
