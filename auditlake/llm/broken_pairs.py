"""Problem 7: question-answer pairs that are empty, cut off, refused, copied or in another language.

Method: the opening clauses of all answers are clustered by the similarity of their shingles; a prefix filter gives the
candidates, so that no similar pair is lost. Templates with a phrase that declines are seeds; templates that recur across unrelated questions, share nothing with them and stand among the polite formulas
that accompany refusals are refusals too, whatever their words. Copy, language and termination checks label the
remaining defects.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.consolidate import components
from auditlake.plans.store import Store

#: Words of a shingle, least Jaccard similarity of two openings of one template.
SHINGLE, SIMILAR = 5, 0.8
#: At most so many shingles are ordered by the number of their clauses, all others come before them. Any order gives the
#: same result, only the number of comparisons differs.
MOST_FREQUENT = 100_000
#: Least sizes of the classes of clauses by their number of shingles: one size each, then sizes within a twentieth.
CLASSES = list(range(1, 33))
while CLASSES[-1] < 1 << 31:
    CLASSES.append(CLASSES[-1] * 21 // 20)
#: Keys that a Python worker gives out at a time.
KEYS = 1 << 18
#: A template recurs if it opens answers to at least so many different questions.
RECURS = 3
#: A formula accompanies refusals if at least this part of its questions is refused; a template is a refusal if at
#: least FRAMED of its questions have such a formula, and APART of its answers share nothing with their question.
ACCOMPANIES, FRAMED, APART = 0.5, 0.25, 0.5
#: Least words (Chinese characters) of a refusal that is known by its recurrence only.
LEAST_WORDS = 3

# Role spellings, function words and phrases of the languages in the data.
_USER = ("user", "human")
_ASSISTANT = ("assistant", "gpt")
_FUNCTION_WORDS = {
    "en": "the a an of to and is are in that for with on it which how can you why does do my should i be this by was were before whenever when then not from every has have had at as its into only they but what",
    "de": "der die das und den dem des von mit wird wurde werden nach wie ist sind im zu ich warum als auf ein eine einen einem bei beim nicht durch weil ohne soll an ab bitte",
    "fr": "le la les de du des et est que qui pour dans avec par sur une un ce cette pourquoi comment avant il je ne pas au aux soit mais dois sont puis car",
    "es": "el la los las de del que en se por con para una un como cada vez debo es al lo su no sin qué cómo sigue porque aunque son y",
}
#: word -> the languages that have it
_FUNCTION_WORDS = {w: [k for k, v in _FUNCTION_WORDS.items() if w in v.split()] for x in _FUNCTION_WORDS.values() for w in x.split()}
_LANGUAGES = ("en", "de", "fr", "es")
_SCRIPTS = {"ja": "[぀-ヿ]", "zh": "[㐀-鿿]", "ko": "[가-힯]", "ru": "[Ѐ-ӿ]", "th": "[฀-๿]", "hi": "[ऀ-ॿ]", "ar": "[؀-ۿ]"}
_SCRIPTS = {k: re.compile(v) for k, v in _SCRIPTS.items()}
_REQUESTS = {
    "en": r"\b(?:in|into) english\b|\b(?:auf|ins) englisch|en anglais|en inglés|英文|英语",
    "de": r"\b(?:in|into) german\b|auf deutsch|en allemand|en alemán|德文|德语",
    "fr": r"\b(?:in|into) french\b|auf französisch|en français|en francés|法文|法语",
    "es": r"\b(?:in|into) spanish\b|auf spanisch|en espagnol|en español|西班牙",
    "zh": r"\b(?:in|into) (?:simplified |traditional )?(?:chinese|mandarin)\b|auf chinesisch|en chinois|en chino|中文|汉语",
    "ja": r"\b(?:in|into) japanese\b|auf japanisch|en japonais|en japonés|日文|日语",
    "ru": r"\b(?:in|into) russian\b|auf russisch|en russe|en ruso|俄文|俄语",
}
_REQUESTS = {k: re.compile(v, re.I) for k, v in _REQUESTS.items()}
_DECLINES = [
    r"\b(?:i|my|me|we)\b.*\b(?:can(?:no|['’])t|can not|won['’]t|will not|unable to|not able to|not (?:allowed|permitted|going) to|(?:do|does)(?:n['’]t| not) (?:let|allow|permit) me(?: to)?)\b(?:\W+\w+){0,3}?\W+(?:help|assist|answer|respond|reply|provide|discuss|comply|share|give|engage|talk|support|fulfil|do (?:that|this|so))",
    r"\b(?:falls?|is|lies) (?:outside|beyond)\b.*\b(?:i|my|me)\b",
    r"\bi (?:have|must|need|am obliged)(?: to)? (?:decline|refuse)|\bi (?:decline|refuse) to\b|\bi['’]?(?:d| would)? (?:must|have to|rather) (?:decline|refuse|not)\b",
    r"\bno (?:answer|help|guidance|response) can be (?:given|provided|offered)",
    r"\b(?:ich|mir|mich)\b.*\b(?:nicht|keine?n?)\b.*\b(?:helfen|beantworten|antworten|unterstützen|geben|sprechen|weiterhelfen)|(?:muss|möchte|werde) ich.*\bablehnen|ich (?:muss|möchte|werde).*\bablehnen|\bich darf\b.*\bnicht\b",
    r"\bje ne (?:peux|puis|suis|saurais)\b.*\b(?:répondre|aider|traiter|fournir|discuter|parler|en mesure)|\bje (?:dois|préfère) (?:refuser|décliner)",
    r"\bno (?:puedo|podré|me es posible)\b.*\b(?:ayudar|responder|contestar|proporcionar|hablar|dar|atender)|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)",
    r"(?:我|本人).{0,8}(?:无法|不能|不便|不可以|没法|不会|拒绝).{0,8}(?:回答|提供|协助|帮助|讨论|回应|处理|回复)|(?:无法|不能|不便)(?:回答|回应)(?:这个|该|您|你)|超出.{0,6}我.{0,10}范围|我.{0,8}拒绝",
]
_DECLINES = re.compile("|".join(f"(?:{x})" for x in _DECLINES), re.S)
_OPEN_END = frozenset(
    "e.g i.e vs fig no sec approx cf p pp dr mr mrs prof ca z.b bzw u.a abschn nr vgl d.h aprox pág sr sra m mme véase núm ej art vol eq ref".split()
)

_FENCE = re.compile(r"```[^\n`]*\n?(.*?)(?:```|\Z)", re.S)
_INVISIBLE = re.compile(r"[\W_]+")
# runs of ASCII only, since scripts without white space would lose whole sentences
_IDENTIFIER = re.compile(r"https?://[!-~]+|`[^`]*`|[!-~]*[_\d/\\=<>{}\[\]()][!-~]*|[!-~]+\.[A-Za-z0-9_][!-~]*")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LONG_WORDS = re.compile(r"[^\W\d_㐀-鿿]{4,}")
_HAN = re.compile(r"[㐀-鿿]+")
_TOKENS = re.compile(r"[㐀-鿿]|[^\W_]+|#")
_MARKED = re.compile(r"[_\d/\\=<>{}\[\]()]|.\.\w")
_CLAUSE_END = re.compile(r"[,;:，；：]\s*|(?<=[.!?])\s+|(?<=[。！？])\s*")


def pairs(df: DataFrame, id_col: str, messages_col: str) -> DataFrame:
    """(id, pair_no, question, answer): each user message, numbered from 0, with the assistant's right after it.

    Roles count whatever their case and spelling; ``answer`` is null if another message or none follows. Null
    conversations, and messages without a role, give no pair.
    """
    role = F.lower(F.trim(F.col("m.role")))
    kind = F.when(role.isin(*_USER), "u").when(role.isin(*_ASSISTANT), "a").otherwise("o")
    rows = df.select(F.col(id_col).alias("id"), F.col(messages_col).alias("ms"), F.posexplode(messages_col).alias("at", "m")).withColumn("kind", kind)
    users = F.filter("ms", lambda m: F.lower(F.trim(m["role"])).isin(*_USER))
    # the number of user messages before this one
    before = F.size(F.filter(F.slice(F.col("ms"), F.lit(1), F.col("at")), lambda m: F.lower(F.trim(m["role"])).isin(*_USER)))
    following = F.get("ms", F.col("at") + 1)
    answer = F.when(F.lower(F.trim(following["role"])).isin(*_ASSISTANT), following["content"])
    return rows.where((F.col("kind") == "u") & (F.size(users) > 0)).select("id", before.cast("int").alias("pair_no"), F.coalesce(F.col("m.content"), F.lit("")).alias("question"), answer.alias("answer"))


#: all of ASCII but letters and digits
_DROPPED = {i: None for i in range(128) if not chr(i).isalnum()}


def _plain(text: str) -> str:
    """The letters and digits of a text in lower case."""
    low = text.lower()
    return low.translate(_DROPPED) if low.isascii() else _INVISIBLE.sub("", low)


def _blank(value: object) -> bool:
    if isinstance(value, dict):
        return all(map(_blank, value.values()))
    if isinstance(value, list):
        return all(map(_blank, value))
    return value is None or isinstance(value, str) and not _plain(value)


def _document(answer: str) -> tuple[bool, object]:
    """Whether an answer begins as a JSON document, and its value if it is one."""
    body = answer.strip()
    fenced = re.fullmatch(r"```(?:json)?\s*\n(.*?)\n?```", body, re.S)
    body = fenced[1].strip() if fenced else body
    if not re.match(r'\{\s*["}]|\[\s*[\["{\]]', body):
        return False, None
    try:
        return True, json.loads(body, strict=False)
    except ValueError:
        return True, None


def _strings(value: object) -> list[str]:
    if isinstance(value, dict):
        return [s for k, v in value.items() for s in _strings(v)]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v)]
    return [value] if isinstance(value, str) else []


def is_empty(answer: str | None) -> bool:
    """No letter or digit outside empty frames: fences, tags and JSON without values."""
    if answer is None:
        return True
    text = _FENCE.sub(lambda m: m[1], answer) if "```" in answer else answer
    if "<" in text:
        text = re.sub(r"<[^<>]*>", "", text)
    if not _plain(text):
        return True
    framed, value = _document(answer)
    return framed and value is not None and _blank(value)


def is_copy(question: str, answer: str) -> bool:
    """Nothing but the question, or the code that it shows, once or again, under a label at most."""
    own = _plain(answer)
    for label in ("code:", "代码：", "代码:"):
        at = question.lower().find(label)
        code = _plain(question[at + len(label) :]) if at >= 0 else ""
        if len(code) >= 20 and own:
            rest = own.replace(code, "")
            if len(rest) < len(own) and len(rest) <= 12 or len(own) >= 0.5 * len(code) and own in code:
                return True
    asked = _plain(question)
    if len(asked) < 4:
        return False
    for form in {asked, _plain(re.sub(r"(?:please |bitte )?(?:answer|reply|antworte\w*)[^.?!]*[.?!]?\s*$|请用..回答。?\s*$", "", question, flags=re.I))}:
        if len(form) >= 4 and form in own and len(own.replace(form, "")) <= 16:
            return True
    return len(own) >= 0.7 * len(asked) and own in asked


def prose(text: str) -> str:
    """A text without code, addresses and identifiers."""
    if "```" in text:
        text = _FENCE.sub(" ", text)
    if text.isascii() and "`" not in text:
        # the same as the pattern, by words: each run is kept or dropped as a whole
        return " ".join([w for w in text.split() if not _MARKED.search(w)])
    return _IDENTIFIER.sub(" ", text)


def language(text: str) -> str | None:
    """The language of a text's prose; None if there is too little to tell."""
    own = prose(text)
    if not own.isascii():
        counts = {k: len(p.findall(own)) for k, p in _SCRIPTS.items()}
        if counts["ja"] >= 3:
            counts["zh"], counts["ja"] = 0, counts["ja"] + counts["zh"]
        best = max(counts, key=counts.get)
        if counts[best] >= 4 and 3 * counts[best] >= len(_LATIN.findall(own)):
            return best
    hits = dict.fromkeys(_LANGUAGES, 0)
    for word, n in Counter(_LETTERS.findall(own.lower())).items():
        for k in _FUNCTION_WORDS.get(word, ()):
            hits[k] += n
    first, second = sorted(hits.values(), reverse=True)[:2]
    if first >= 2 and first > second:
        return max(hits, key=hits.get)
    return None


def _head(question: str) -> str:
    """A question up to its code."""
    return re.split(r"\n\s*code:|代码[:：]", question, maxsplit=1, flags=re.I)[0]


def _spoken(question: str) -> str:
    """A question without fenced code and, behind a code label, without lines that are indented or look like code."""
    text = _FENCE.sub(" ", question) if "```" in question else question
    head = _head(text)
    rest = [x for x in text[len(head) :].split("\n") if not re.match(r"\s|#|//|/?\*", x) and not re.search(r"[=(){}\[\];]", x)]
    return "\n".join([head, *rest])


def in_other_language(question: str, answer: str) -> bool:
    """The answer's prose is in another language than the question asks for, or is in."""
    framed, value = _document(answer)
    spoken = language(" ".join(_strings(value)) if framed and value is not None else answer)
    if spoken is None:
        return False
    told = _spoken(question)
    asked = [k for k, p in _REQUESTS.items() if p.search(told)]
    if spoken in asked:
        return False
    wanted = language(_head(question)) or ("en" if re.match(r"\s*task:", question, re.I) else language(question))
    return wanted is not None and wanted != spoken


def is_truncated(answer: str) -> bool:
    """The answer breaks off: in a JSON document, a fence, brackets or quotes, or in a sentence."""
    framed, value = _document(answer)
    if framed:
        return value is None
    text = answer.strip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    spoken = _FENCE.sub(" ", text).rstrip("​﻿").rstrip()
    words = re.findall(r"[^\W_]+", spoken)
    if not words:
        return False
    quotes = spoken.count('"') % 2 or spoken.count("“") > spoken.count("”") and "„" not in spoken or spoken.count("„") > spoken.count("“") or spoken.count("«") > spoken.count("»") or spoken.count("「") > spoken.count("」")
    if quotes or spoken.count("(") > spoken.count(")") or spoken.count("（") > spoken.count("）"):
        return True
    last = spoken.split()[-1]
    han = len(re.findall(r"[぀-ヿ㐀-鿿]", spoken))
    if spoken[-1] in ".!?。！？…।؟":
        if spoken[-1] != "." or len(words) < 4:
            return False
        return last[:-1].lower().lstrip("([\"'«„“") in _OPEN_END or last.count("://") == 1 and last.count("/") == 2
    if spoken[-1] in ")）]\"'“”»’」』*":
        return False
    if han >= 6:
        return True
    return len(words) > 3 or spoken[-1] in ",:;-–—(（、，：" and len(words) > 1


def declines(text: str) -> bool:
    """The text says that its author will not, or may not, answer."""
    return _DECLINES.search(text.lower()) is not None


def opening(answer: str | None) -> list[str]:
    """The clauses of an answer's prose, in lower case, numbers and identifiers as placeholders."""
    if answer is None:
        return []
    framed, value = _document(answer)
    text = " ".join(_strings(value)) if framed and value is not None else answer
    clauses = _CLAUSE_END.split((_FENCE.sub(" ", text) if "```" in text else text).strip())
    clauses = [" ".join((_IDENTIFIER.sub(" # ", c) if _MARKED.search(c) or "`" in c else c).lower().split()).strip(" .!?。！？\"'") for c in clauses]
    return list(dict.fromkeys(c for c in clauses if len(c) >= 4))


def _content(text: str) -> set[str]:
    """Words of at least four letters that aren't function words, and pairs of Chinese characters."""
    low = text.lower()
    words = {w for w in _LONG_WORDS.findall(low) if w not in _FUNCTION_WORDS}
    return words if low.isascii() else words.union(*({h[i : i + 2] for i in range(len(h) - 1)} for h in _HAN.findall(low)))


def _words(clause: str) -> list[str]:
    return _TOKENS.findall(clause)


def _shingles(clause: str) -> list[int]:
    words = _words(clause)
    return sorted({zlib.crc32(" ".join(words[i : i + SHINGLE]).encode()) for i in range(max(1, len(words) - SHINGLE + 1))})


def _least(n: int, m: int) -> int:
    """The shingles that two clauses of ``n`` and ``m`` shingles have in common if they are similar."""
    return math.ceil((n + m) * SIMILAR / (1 + SIMILAR) - 1e-9)


@lru_cache(256)
def _reach(n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The class of a clause of ``n`` shingles, and the places and class pairs of its keys.

    The first common shingle of two similar clauses, in any common order, is among the first n - least + 1 of each. How
    many these are follows from both sizes, so a clause has keys of its own for every class it may be similar to.
    """
    own, last = (int(np.searchsorted(CLASSES, x, "right")) - 1 for x in (n, math.floor(n / SIMILAR + 1e-9)))
    shortest = math.ceil(n * SIMILAR - 1e-9)
    places, pairs = [], []
    for other in range(int(np.searchsorted(CLASSES, shortest, "right")) - 1, last + 1):
        least = _least(n, max(shortest, CLASSES[other]))
        # of the size of its own, only an equal set may be similar, and equal sets are one
        if other == own and least == n:
            continue
        places += range(n - least + 1)
        pairs += [min(own, other) << 16 | max(own, other)] * (n - least + 1)
    return own, np.array(places, np.int64), np.array(pairs, np.uint64)


def _keys(parts: Iterator[pd.DataFrame], frequent: np.ndarray, often: np.ndarray) -> Iterator[pd.DataFrame]:
    """(c, class, band): the keys of each set of shingles; a band is a 32-bit shingle and a pair of classes."""
    for part in parts:
        sizes = part["shingles"].map(len).to_numpy()
        for n in np.unique(sizes).tolist():
            own, places, pairs = _reach(n)
            at = np.flatnonzero(sizes == n)
            for some in np.array_split(at, math.ceil(len(at) * max(n, len(places)) / KEYS)) if len(places) else ():
                sets = np.stack(part["shingles"].iloc[some].tolist())
                rank = np.zeros(sets.shape, np.int64)
                if len(frequent):
                    found = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
                    rank = np.where(frequent[found] == sets, often[found], 0)
                first = np.take_along_axis(sets, np.lexsort((sets, rank), axis=-1), 1)[:, places]
                band = (first.astype(np.uint64) << np.uint64(32) | pairs).view(np.int64)
                yield pd.DataFrame({"c": np.repeat(part["c"].to_numpy()[some], len(places)), "class": own, "band": band.ravel()})


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each clause by its number, with its shingles."""
    for batch in batches:
        shingles = [_shingles(c) for c in batch["clause"]]
        slot = ["#" in c for c in batch["clause"]]
        declined = [declines(c) for c in batch["clause"]]
        yield batch[["c", "questions"]].assign(shingles=shingles, words=[len(_words(c)) for c in batch["clause"]], slot=slot, declined=declined)


def _clusters(signed: DataFrame, store: Store) -> DataFrame:
    """(c, template): every clause with the smallest clause of its cluster.

    Clauses are linked if they are similar, and connected links give the clusters. Equal sets of shingles are compared
    once. Of two similar sets, some of the rarest shingles of both are the same, so they share a bucket. The sets of a
    bucket are compared with its smallest one; those that are similar to it are linked through it, and each of the others
    is compared with all of the bucket.
    """
    sets = store.write(signed.groupBy("shingles").agg(F.min("c").alias("c"), F.count("*").alias("n")), "sets")
    same = sets.where(F.col("n") > 1).select("shingles", F.col("c").alias("v"))
    same = signed.select(F.col("c").alias("u"), "shingles").join(same, "shingles").where(F.col("u") != F.col("v")).select("u", "v")
    shingles = sets.select("c", "shingles")
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    most = counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas().sort_values("shingle")
    order = signed.sparkSession.sparkContext.broadcast((most["shingle"].to_numpy(np.int64), most["n"].to_numpy(np.int64)))
    keyed = store.write(shingles.mapInPandas(lambda parts: _keys(parts, *order.value), "c long, class int, band long"), "keys")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) that are similar."""
        both = F.size(F.array_intersect("sa", "sb"))
        pairs = pairs.join(shingles.select(F.col("c").alias("u"), F.col("shingles").alias("sa")), "u").join(shingles.select(F.col("c").alias("v"), F.col("shingles").alias("sb")), "v")
        return store.write(pairs.where(both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).select("u", "v"), name)

    one_class = F.col("band").bitwiseAND(0xFFFF) == F.shiftright("band", 16).bitwiseAND(0xFFFF)
    buckets = keyed.groupBy("band").agg(F.min("c").alias("v"), F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most"))
    buckets = buckets.where((F.col("n") > 1) & (one_class | (F.col("least") < F.col("most")))).select("band", "v")
    near = store.write(keyed.join(buckets, "band").select("band", F.col("c").alias("u"), "v", "class").where(F.col("u") != F.col("v")), "near")
    store.drop("keys")
    links = similar(near.select("u", "v").distinct(), "links-first")
    others = near.select("band", F.col("u").alias("other"), F.col("class").alias("other_class"))
    left = near.join(links, ["u", "v"], "left_anti").join(others, "band")
    left = left.where((F.col("u") != F.col("other")) & (one_class | (F.col("class") != F.col("other_class"))))
    left = left.select(F.greatest("u", "other").alias("u"), F.least("u", "other").alias("v")).distinct()
    links = links.unionByName(similar(left, "links-others")).unionByName(same)
    roots = components(links, store)
    least = roots.groupBy("root").agg(F.min("v").alias("template"))
    roots = roots.join(least, "root").select(F.col("v").alias("c"), "template")
    return signed.select("c", "questions", "declined", "words", "slot").join(roots, "c", "left").withColumn("template", F.coalesce("template", "c"))


def _templates(openings: DataFrame, store: Store) -> DataFrame:
    """(c): the numbers of the clauses that are refusals.

    Equal clauses are counted first, so that a hot template is one row. A template that recurs is a seed if most of its
    clauses decline; a clause that does not recur, if it does. From the seeds, the others are found by recurrence.
    """
    clauses = openings.groupBy("clause").agg(F.count_distinct("asked").alias("questions")).withColumn("c", F.xxhash64("clause"))
    signed = store.write(clauses.mapInPandas(_signed, "c long, questions long, shingles array<long>, words int, slot boolean, declined boolean"), "clauses")
    placed = store.write(_clusters(signed, store), "placed")
    sums = placed.groupBy("template").agg(F.sum("questions").alias("questions"), F.avg(F.col("declined").cast("int")).alias("declining"), F.min("words").alias("words"), F.min("slot").alias("slot"))
    sums = store.write(sums.where((F.col("questions") >= RECURS) | (F.col("declining") == 1.0)), "sums")
    seeds = sums.where(F.when(F.col("questions") >= RECURS, F.col("declining") > 0.5).otherwise(F.lit(True))).select("template")
    uses = openings.select("asked", "said", "apart", F.xxhash64("clause").alias("c")).join(placed.select("c", "template"), "c").join(sums.select("template", "words", "slot"), "template")
    uses = uses.groupBy(F.xxhash64("asked", "said").alias("pair"), "asked", "template", "words", "slot").agg(F.max("apart").alias("apart"))
    learned = _recurring(store.write(uses, "uses"), seeds, store)
    known = placed.join(seeds.unionByName(learned), "template", "left_semi").select("c")
    # a clause that holds a learned template whole and adds to it, as in "... about #", is one too
    parts = placed.join(learned, "template", "left_semi").where(F.col("words") >= SHINGLE).select("c").join(signed, "c")
    parts = parts.select(F.col("c").alias("part"), F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    longer = signed.select("c", F.explode("shingles").alias("shingle")).join(parts, "shingle")
    longer = longer.groupBy("c", "part", "n").agg(F.count("*").alias("held")).where(F.col("held") == F.col("n")).select("c")
    return store.write(known.unionByName(longer).distinct(), "templates")


def _recurring(uses: DataFrame, seeds: DataFrame, store: Store) -> DataFrame:
    """(template): refusals that no phrase shows, by their recurrence.

    ``uses`` has every pair with each of its templates that recurs or is a seed. A template that recurs in answers
    which are refused anyway is a formula that accompanies refusals. One that recurs with such formulas, in answers that
    share nothing with their questions, is a refusal; it may reveal more formulas, so this goes on until nothing new is
    found. Each round adds a template, and two rounds are usual.
    """
    asked = F.count_distinct("asked")
    learned, turn = seeds.limit(0), 0
    while True:
        known = seeds.unionByName(learned)
        refused = uses.join(known, "template", "left_semi").select("pair").distinct().withColumn("refused", F.lit(True))
        others = uses.join(known, "template", "left_anti")
        sums = others.join(refused, "pair", "left").groupBy("template").agg(asked.alias("n"), F.count_distinct(F.when(F.col("refused"), F.col("asked"))).alias("hits"))
        formulas = store.write(sums.where((F.col("n") >= RECURS) & (F.col("hits") >= ACCOMPANIES * F.col("n"))).select("template"), f"formulas-{turn}")
        framed = others.join(formulas, "template", "left_semi").select("pair").distinct().withColumn("framed", F.lit(True))
        sums = others.where((F.col("words") >= LEAST_WORDS) & ~F.col("slot")).join(formulas, "template", "left_anti").join(framed, "pair", "left")
        sums = sums.groupBy("template").agg(asked.alias("n"), F.count_distinct(F.when(F.col("framed"), F.col("asked"))).alias("hits"), F.avg(F.col("apart").cast("int")).alias("apart"))
        new = sums.where((F.col("n") >= RECURS) & (F.col("hits") >= FRAMED * F.col("n")) & (F.col("apart") >= APART)).select("template")
        new = store.write(new, f"learned-{turn}")
        if new.isEmpty():
            return learned
        learned, turn = learned.unionByName(new), turn + 1


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The defects that a pair shows by itself, in the order in which they count, and its opening clauses."""
    for batch in batches:
        before, after, clauses, apart = [], [], [], []
        for q, a in zip(batch["question"], batch["answer"], strict=True):
            if is_empty(a):
                before.append("empty_answer")
            else:
                before.append("copied_question" if is_copy(q, a) else None)
            told = None
            if before[-1] is None:
                told = "truncated_answer" if is_truncated(a) else "other_language" if in_other_language(q, a) else None
            after.append(told)
            clauses.append(opening(a) if before[-1] is None else [])
            apart.append(bool(clauses[-1]) and _content(_head(q)).isdisjoint(_content(a)))
        asked = [zlib.crc32(q.encode()) for q in batch["question"]]
        said = [zlib.crc32((a or "").encode()) for a in batch["answer"]]
        yield batch[["id", "pair_no"]].assign(before=before, after=after, clauses=clauses, asked=asked, said=said, apart=apart)


def defects(df: DataFrame, id_col: str, messages_col: str) -> DataFrame:
    """(``id_col``, pair_no, defect): each defective pair with its one defect.

    An empty answer counts before a copied question, that before a refusal, that before a truncated answer, and that
    before another language. Rows with a null identifier keep it; repeated conversations each come out; null
    conversations, null contents of questions and empty tables have a defined result (no pair, an empty question, no
    rows).
    """
    store = Store(df.sparkSession, "defects")
    kind = df.schema[id_col].dataType.simpleString()
    rows = pairs(df, id_col, messages_col)
    checked = store.write(rows.mapInPandas(_checked, f"id {kind}, pair_no int, before string, after string, clauses array<string>, asked long, said long, apart boolean").withColumn("row", F.monotonically_increasing_id()), "checked")
    openings = checked.select("asked", "said", "apart", F.explode("clauses").alias("clause"))
    templates = _templates(openings, store)
    store.keep("checked", "templates")
    # rows are known by the number that their table gives them, so equal or null identifiers stay apart
    refused = checked.select("row", F.explode("clauses").alias("clause")).select("row", F.xxhash64("clause").alias("c")).join(templates, "c", "left_semi").select("row").distinct()
    defect: Column = F.coalesce("before", "refused", "after")
    judged = checked.drop("clauses").join(refused.withColumn("refused", F.lit("refusal")), "row", "left")
    return judged.select(F.col("id").alias(id_col), "pair_no", defect.alias("defect")).where(F.col("defect").isNotNull())
