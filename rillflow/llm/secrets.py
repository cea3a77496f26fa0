"""Secret scans: fixed patterns, and values in a credential context judged by their guess cost.

The guess cost of a value is the cheapest way to write it as a row of segments, in log10 guesses: a
word by its rank (any case, usual letter substitutions), a date, a repeat, a keyboard walk, or characters
tried one by one.  The minimum is found by dynamic programming over the value's positions and whether
the last segment was a single character, which decides what the next one costs.  Segments have at most
``LONGEST`` characters and longer repeats are read as so many, so the work is linear in the value's
length, and it ends where no way to the end can cost less than asked.  A value that follows a
credential word and costs at least ``MIN_COST`` is a secret of kind ``guess``.

Words and ranks come from three lists: common passwords, a public tokenizer's vocabulary in its order,
and the corpus's own words by their number over all documents.  What stands in a credential context is not
counted, and a word needs many different texts: a secret cannot make itself a word, however often its text is copied.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import send_package
from .common import cut, map_columns, per_task, sorted_spans, texts_of, unused

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}", re.A)
HEX = re.compile(r"[0-9a-f]{32,}", re.A)
#: A credential word, a link word or sign, and a value up to white space, quotes or brackets.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credentials?|login)["'`]?\x20*(?:[:=]>?|->|\x20(?:is|was)\x20)\x20*["'`]?([^\s"'`<>(){}\[\],;]{6,})""", re.I | re.A)
#: What a credential context begins with, in lower case: texts without any have none.
CREDENTIALS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "login")
LONGEST = 32
MIN_COST = 8.0
#: A word of the corpus is in the dictionary if it is at least this share of all words: 50,000 words at most.
WORD_SHARE = 2e-5
#: It also needs so many of the 64 groups that a hash deals different texts to; copies of a text are in one group.
LEAST_GROUPS = 8
#: Per further segment: an attacker has to try the ways to put segments together.
SEGMENT_COST = 0.5
#: Common passwords and words in them, first in the dictionary.
COMMON = (
    "password pass admin root user login welcome secret token letmein master monkey dragon shadow sunshine "
    "princess football baseball iloveyou hello love summer winter spring autumn monday friday january june "
    "july august october november december test guest default changeme hunter computer internet server "
    "example sample company office money freedom whatever trust star super batman michael jordan key"
).split()
UNLEET = str.maketrans("013457@$!", "oieastasi")
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azerty")
NEXT_KEYS = {pair for row in KEY_ROWS for a, b in zip(row, row[1:]) for pair in (a + b, b + a)}
#: A year, a year and month, and a whole date in either order; what each costs.
DATES = tuple(
    (re.compile(pattern, re.A), math.log10(ways))
    for pattern, ways in (
        (r"(?:19|20)\d\d", 120),
        (r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])", 12 * 120),
        (r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", 366 * 120),
        (r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", 366 * 120),
    )
)
LONG_REPEATS = tuple((re.compile(r"(.{%d})\1{%d,}" % (unit, LONGEST // unit), re.S), LONGEST // unit) for unit in (1, 2, 3, 4))


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000


def vocabulary_words(path: str) -> list[str]:
    """Whole words of three letters or more in a word-end vocabulary file (tokens that end with ``</w>``), by their ids."""
    with open(path, encoding="utf-8") as file:
        ids: dict[str, int] = json.load(file)["model"]["vocab"]
    words = (t[:-4] for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    return [w for w in words if w.isascii() and w.isalpha() and 3 <= len(w) <= LONGEST]


def corpus_words(docs: DataFrame, least_share: float = WORD_SHARE, least_groups: int = LEAST_GROUPS) -> list[str]:
    """Words of 3 to ``LONGEST`` letters with at least ``least_share`` of all words of all texts, most frequent first.

    Credential contexts with their values do not count, nor do words whose texts fall into fewer than
    ``least_groups`` of 64 groups.  At most ``1 / least_share`` words come to the driver.
    """
    texts = texts_of(docs).filter("text is not null")
    group = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("text"), F.lit(64)).cast("int"))
    held = reduce(Column.__or__, (F.contains(F.lower("text"), F.lit(c)) for c in CREDENTIALS))
    outside = F.lower(F.when(held, F.regexp_replace("text", f"(?i){CONTEXT.pattern}", " ")).otherwise(F.col("text")))
    split = texts.select(group.alias("grp"), F.split(outside, r"[^\p{L}]+").alias("words"))  # once a text, not once a word
    words = split.select("grp", F.explode_outer("words").alias("word"))  # else Spark splits a second time to leave out empty arrays
    counts = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.bit_or("grp").alias("groups")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    sized = (F.length("word") >= 3) & (F.length("word") <= LONGEST)
    known = counts.filter(sized & (F.col("n") >= least_share * total) & (F.bit_count("groups") >= least_groups))
    return [r["word"] for r in sorted(known.select("word", "n").collect(), key=lambda r: (-r["n"], r["word"]))]


def dictionary(*lists: list[str]) -> dict[str, int]:
    """The rank of each word: its best place in any of the lists, from 1."""
    ranks: dict[str, int] = {}
    for words in lists:
        for place, word in enumerate(words, 1):
            ranks[word] = min(place, ranks.get(word, place))
    return ranks


class GuessCost:
    def __init__(self, ranks: dict[str, int] | None = None):
        ranks = dictionary(COMMON) if ranks is None else ranks
        self.words = {w: math.log10(rank + 1) for w, rank in ranks.items() if len(w) <= LONGEST}
        self.longest_word = max(map(len, self.words), default=0)

    def cost(self, value: str, enough: float = math.inf) -> float:
        """log10 of the guesses that the cheapest segmentation needs, or what is at least ``enough`` if it needs that; 0 for an empty value."""
        for pattern, times in LONG_REPEATS:
            value = pattern.sub(lambda m: m[1] * times, value)
        low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
        plain, words = low.translate(UNLEET), self.words
        single = [math.log10(_class_size(c)) for c in value]
        # cheapest ways to each position: where a single character ends them, and where another segment does
        ones, others, best = [0.0], [math.inf], [0.0]
        run, walk, dear = [0] * 5, 1, 0
        for end in range(1, len(value) + 1):
            cheapest = math.inf

            def offer(length: int, cost: float) -> None:
                nonlocal cheapest
                start = end - length
                cheapest = min(cheapest, best[start] + cost + (SEGMENT_COST if start else 0.0))

            for length in range(3, min(self.longest_word, end) + 1):
                word = low[end - length : end]
                changed = 0.3 * (value[end - length : end] != word)
                if (cost := words.get(word)) is not None:
                    offer(length, cost + changed)
                if (spelled := plain[end - length : end]) != word and (cost := words.get(spelled)) is not None:
                    offer(length, cost + changed + 0.6)
            if value[end - 1].isdigit():
                for length in range(4, min(10, end) + 1):
                    for pattern, cost in DATES:
                        if pattern.fullmatch(value, end - length, end):
                            offer(length, cost)
            for unit in (1, 2, 3, 4):  # the unit is guessed once, then how often it stands
                run[unit] = run[unit] + 1 if end > unit and value[end - 1] == value[end - 1 - unit] else 0
                for times in range(2, min(run[unit] + unit, LONGEST) // unit + 1):
                    if unit * times >= 3:
                        offer(unit * times, sum(single[end - unit : end]) + math.log10(times))
            walk = walk + 1 if end > 1 and low[end - 2 : end] in NEXT_KEYS else 1
            for length in range(3, min(walk, LONGEST) + 1):
                offer(length, math.log10(2 * 47 * length))
            ones.append(min(ones[-1], others[-1] + SEGMENT_COST) + single[end - 1])
            others.append(cheapest)
            best.append(min(ones[-1], cheapest))
            dear = dear + 1 if best[-1] >= enough else 0
            if dear == LONGEST:  # every way on comes through one of these positions
                return min(best[-LONGEST:])
        return best[-1]


def is_guess_secret(value: str, guesses: GuessCost, min_cost: float = MIN_COST) -> bool:
    return guesses.cost(value, min_cost) >= min_cost


def find_secrets(text: str, guesses: GuessCost, min_cost: float = MIN_COST) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive; leftmost and non-overlapping within a kind."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?:")
        if len(value) >= 6 and is_guess_secret(value, guesses, min_cost):
            spans.append(("guess", m.start(1), m.start(1) + len(value)))
    return spans


def learn(docs: DataFrame, vocabulary: str | None = None, least_share: float = WORD_SHARE) -> dict[str, int]:
    """The dictionary for a corpus; ``vocabulary`` is the path of a word-end vocabulary file, read by the driver."""
    return dictionary(list(COMMON), vocabulary_words(vocabulary) if vocabulary else [], corpus_words(docs, least_share))


def scan(docs: DataFrame, ranks: dict[str, int] | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans and all spans, for each whole text.

    ``ranks``: the dictionary of ``learn``; without it common passwords only.  A null or empty text has no
    spans: zero counts, the digest of the empty string, an empty ``spans``; a null doc_id stays null.
    Overlapping spans of different kinds all stay.  Repeated rows give repeated rows, an empty table none.
    Texts and values of any length are read whole, in linear time; further columns are not read.
    """

    @per_task
    def start():
        guesses = GuessCost(ranks)

        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                spans = find_secrets(text or "", guesses, min_cost)
                base = sorted_spans([s for s in spans if s[0] != "guess"], KINDS)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                for k, v in zip(out, (doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), sorted_spans(spans, KINDS))):
                    out[k].append(v)
            return out

        return work

    return map_columns(texts_of(docs), start, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """Replace each run of overlapping spans by one mask."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_texts(docs: DataFrame, ranks: dict[str, int] | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """The documents with every secret of every text masked and n_chars brought up to date; null texts stay null.

    All rows and columns stay, repeated ones too, whatever the columns' names; an empty text stays empty, an
    empty table too.  Texts are read whole, however long, in linear time.
    """
    send_package(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        guesses = GuessCost(ranks)
        for batch in texts:
            yield pd.Series([t if t is None else redact(t, find_secrets(t, guesses, min_cost)) for t in batch], dtype=object)

    (name,) = unused(docs, "__masked")
    out = docs.withColumn(name, masked(F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col(name).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(changed, F.length(name).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(name)).select(*(F.col(f"`{c}`") for c in docs.columns))
