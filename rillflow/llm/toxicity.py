"""Toxicity: a lexicon trie met with Levenshtein automata, and context windows.

The lexicon is learned from labelled rows.  Terms are beginnings of words, and whole words, that toxic
training texts hold far more often than clean ones.  Stems are beginnings that ordinary words have too, by
chance; a stem counts in a text that holds two different words with it, as toxic training texts do far
more often than clean ones.  Stems are matched as they are.  The terms' trie is run as one automaton whose states are sets of
(trie node, edits); states are made when first reached and kept up to a bound.  A word hits when it
begins with a term, when the whole word is within a term's edits (one from four letters on, two from
nine), or, for terms of six letters and more, when any beginning of it is.  Misspellings that clean
training texts hold are set aside, and a term whose misspellings are no rarer there, by the same odds,
than the term is in toxic texts is matched as it is.

A hit's window of words tells quotation (quote marks, words of reporting) from abuse (address).  The
score is a logistic function of direct, quoted and misspelled hits, fitted on the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import send_package
from .common import cut, map_columns, per_task, texts_of
from .labelled import fit_logistic, fold, labelled_sample

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Labelled rows of each class that are used at most.
PER_CLASS = 3000
#: Letters of the shortest term and of the longest beginning that is one; whole words have no upper limit.
SHORTEST, STEM = 4, 24
#: Single toxic texts that a term needs, how much larger its share in toxic texts is, and its surprise at least.
LEAST_TEXTS, ODDS, SURPRISE = 3, 20.0, 5.0
#: Different words with a stem that a text needs, and single toxic texts with so many that a stem needs.
FORMS, STEM_TEXTS = 2, 2
#: A term of so many letters allows one and two edits; one of ``INFLECTED`` letters also at a word's beginning.
ONE_EDIT, TWO_EDITS, INFLECTED = 4, 9, 6
#: States of an automaton, and words whose verdict is kept, at most; beyond that they are made anew.
STATES, KNOWN = 50_000, 300_000
WINDOW = 6
COPY_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
WORD = re.compile(r"[^\W_]+")
REPORTING = frozenset("said says called calls quote quoted quotes term word wrote writes slur insult dit disait mot terme sagte nannte wort zitat dijo dicho palabra cita".split())
ADDRESS = frozenset("you your youre u are tu te vous toi votre es du dich dir ihr sie bist usted ustedes eres".split())
QUOTES = "\"'“”„«»‹›‘’"
#: A misspelled hit is so much of a direct one.
MISSPELLED = 0.7
FEATURES = ("direct", "quoted", "addressed", "share")
#: Where the fit starts and is drawn to, so that what the sample lacks still counts sensibly.
PRIOR = np.array([3.0, 1.0, 0.5, 5.0, -4.0])


class LexiconAutomaton:
    """The Levenshtein automata of all terms at once, as a deterministic automaton made on demand."""

    def __init__(self, terms: list[str], exact: frozenset = frozenset(), states: int = STATES):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.allowed: dict[int, tuple[int, bool]] = {}  # of a term's last node: its edits, and whether it may go on
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children.append({})
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
            edits = 0 if term in exact else 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0
            self.allowed[node], self.term[node] = (edits, len(term) >= INFLECTED), term
        self.most = max((e for e, _ in self.allowed.values()), default=0)
        self.limit = states
        self._begin()

    def _begin(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.whole: list[int] = []  # edits of the nearest term if the word ends here, or -1
        self.open: list[int] = []  # the same if it may go on
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Follow skipped term letters, then number the set of (node, edits)."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            edits = nodes[node] + 1
            if edits <= self.most:
                for child in self.children[node].values():
                    if nodes.get(child, 99) > edits:
                        nodes[child] = edits
                        todo.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            near = [(e, self.allowed[n][1] or e == 0) for n, e in key if n in self.allowed and e <= self.allowed[n][0]]
            self.whole.append(min((e for e, _ in near), default=-1))
            self.open.append(min((e for e, goes_on in near if goes_on), default=-1))
        return self.number[key]

    def step(self, state: int, c: str) -> int:
        found = self.moves[state].get(c)
        if found is None:
            nodes: dict[int, int] = {}
            for node, edits in self.states[state]:
                for letter, child in self.children[node].items():
                    cost = edits + (letter != c)
                    if cost <= self.most and nodes.get(child, 99) > cost:
                        nodes[child] = cost
                if edits < self.most and nodes.get(node, 99) > edits + 1:
                    nodes[node] = edits + 1
            found = self.moves[state][c] = self._state(nodes)
        return found

    def edits(self, word: str) -> int:
        """0 if the word begins with a term, else the fewest edits by which it or a beginning of it hits, or -1."""
        if len(self.states) > self.limit:
            self._begin()
        state, best = self.start, -1
        for c in word:
            state = self.step(state, c)
            here = self.open[state]
            if here == 0:
                return 0
            if here > 0 and (best < 0 or here < best):
                best = here
            if not self.states[state]:
                return best
        last = self.whole[state]
        return last if best < 0 else best if last < 0 else min(best, last)

    def near(self, word: str) -> set[str]:
        """The terms that a word hits with edits."""
        state, found = self.start, set()
        for i, c in enumerate(word, 1):
            state = self.step(state, c)
            for node, edits in self.states[state]:
                most, goes_on = self.allowed.get(node, (-1, False))
                if 0 < edits <= most and (goes_on or i == len(word)):
                    found.add(self.term[node])
        return found


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    exact: frozenset = frozenset()  # terms that are matched without edits
    harmless: frozenset = frozenset()
    apart: frozenset = frozenset()  # those that stand in two clean training texts, for the fit
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())


class Scorer:
    """Features and scores of texts; words' verdicts are kept in a table of bounded size."""

    def __init__(self, model: ToxicityModel, entries: int = KNOWN):
        self.model, self.automaton, self.entries = model, LexiconAutomaton(model.terms, model.exact), entries
        self.stems = {stem: i for i, stem in enumerate(model.stems)}
        self.lengths = sorted({len(stem) for stem in model.stems})
        self.known: dict[str, int] = {}

    def verdict(self, word: str) -> int:
        """Edits from the nearest term; below zero: -1 for none, -2 and so on for a word with the first stem and so on."""
        found = self.known.get(word)
        if found is None:
            low = word.lower()
            found = self.automaton.edits(low)
            if found and (stem := next((low[:n] for n in self.lengths if low[:n] in self.stems), None)):
                found = -2 - self.stems[stem]
            elif found > 0 and low in self.model.harmless:
                found = -1
            if len(self.known) >= self.entries:
                self.known.clear()
            self.known[word] = found
        return found

    def hits(self, words: list[str]) -> dict[str, int]:
        """Edits of the words that count: hits of terms, and of stems with different forms."""
        verdicts = {w: v for w in set(words) if (v := self.verdict(w)) != -1}
        forms: dict[int, set[str]] = {}
        for w, v in verdicts.items():
            if v < 0:
                forms.setdefault(v, set()).add(w.lower())
        return {w: max(v, 0) for w, v in verdicts.items() if v >= 0 or len(forms[v]) >= FORMS}

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text)
        hits = self.hits(words)
        direct = quoted = misspelled = addressed = 0
        if hits:
            places = list(WORD.finditer(text))
            for i, m in enumerate(places):
                edits = hits.get(m[0])
                if edits is None:
                    continue
                near = [p[0].lower() for p in places[max(0, i - WINDOW) : i + WINDOW + 1]]
                before = text[places[max(0, i - WINDOW)].start() : m.start()]
                after = text[m.end() : places[min(len(places) - 1, i + WINDOW)].end()]
                in_marks = any(before.count(q) % 2 for q in QUOTES[:3]) or any(before.rfind(a) > before.rfind(b) and b in after for a, b in ("“”", "„“", "«»", "‹›", "‘’"))
                told = in_marks or any(w in REPORTING for w in near)
                if edits:
                    misspelled += 1
                elif told:
                    quoted += 1
                else:
                    direct += 1
                addressed += not told and any(w in ADDRESS for w in near)
        direct += MISSPELLED * misspelled
        return [math.log1p(direct), math.log1p(quoted), math.log1p(addressed), direct / (len(words) + 20)]

    def score(self, text: str | None) -> float:
        w = self.model.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(self.features(text or ""), w)) + w[-1]))))


def terms_of(word: str) -> set[str]:
    """The beginnings of a word that can be terms, and the word itself."""
    return {word[:n] for n in range(SHORTEST, min(STEM, len(word)) + 1)} | ({word} if len(word) >= SHORTEST else set())


#: Of a term, over toxic (p) and clean (n) texts: texts with a word that begins with it (or is it, beyond
#: ``STEM`` letters), texts with ``FORMS`` such words, and such words in all.
COUNTS = ("p", "n", "p_forms", "n_forms", "p_words", "n_words")


def _term_counts(sample: DataFrame) -> DataFrame:
    """term and ``COUNTS`` over the training texts."""

    def counts(rows: dict[str, list]) -> dict[str, list]:
        found: dict[str, list[int]] = {}
        for text, label in zip(rows["text"], rows["label"]):
            forms = Counter(t for w in {w.lower() for w in WORD.findall(text or "")} for t in terms_of(w))
            for term, words in forms.items():
                figures = found.setdefault(term, [0] * 6)
                for i, v in enumerate((1, int(words >= FORMS), words)):
                    figures[2 * i + (label == 0)] += v
        return {"term": list(found)} | {k: [v[i] for v in found.values()] for i, k in enumerate(COUNTS)}

    parts = map_columns(sample, counts, "term string, " + ", ".join(f"{k} long" for k in COUNTS))
    return parts.groupBy("term").agg(*(F.sum(k).alias(k) for k in COUNTS))


def surprise(pos: int, neg: int, share: float) -> float:
    """-log10 of a bound on the chance that so many of a term's texts are toxic, at this share of toxic texts."""
    df = pos + neg
    ways = (math.lgamma(df + 1) - math.lgamma(pos + 1) - math.lgamma(neg + 1)) / math.log(10)
    return -(ways + pos * math.log10(share) + neg * math.log10(1 - share))


def choose_terms(counts: dict[str, tuple], n_pos: int, n_neg: int) -> tuple[list[str], list[str]]:
    """Terms and stems from ``COUNTS``: ``ODDS`` times the share in toxic texts and a surprise of ``SURPRISE``.

    A term's surprise is that of its texts, a stem's that of its words.  Each is as long as it loses no
    toxic text, and none is the continuation of another of its kind; a stem does not begin with a term.
    """
    share = n_pos / (n_pos + n_neg)
    lifted = lambda p, n, least: p >= least and (p + 0.5) / (n_pos + 1) >= ODDS * (n + 0.5) / (n_neg + 1)

    def shortest(good: dict[str, int], covered: set[str]) -> list[str]:
        longer = {t[:-1] for t, p in good.items() if p >= 0.95 * good.get(t[:-1], math.inf)}
        kept: set[str] = set()
        for term in sorted((t for t in good if t not in longer), key=lambda t: (len(t), t)):
            if not any(term[:n] in kept or term[:n] in covered for n in range(SHORTEST, len(term) + 1)):
                kept.add(term)
        return sorted(kept, key=lambda t: (-good[t], t))

    terms = shortest({t: c[0] for t, c in counts.items() if lifted(c[0], c[1], LEAST_TEXTS) and surprise(c[0], c[1], share) >= SURPRISE}, set())
    stems = {t: c[2] for t, c in counts.items() if lifted(c[2], c[3], STEM_TEXTS) and surprise(c[4], c[5], share) >= SURPRISE}
    return terms, shortest(stems, set(terms))


def one_of_copies(sample: DataFrame) -> DataFrame:
    """Without most near copies: rows that agree in any of four min-hashes of word triples count once.

    A copied toxic text would make each of its words look like a term.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        keys = []
        for text in rows["text"]:
            words = WORD.findall((text or "").lower())
            hashes = np.array([xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
            keys.append([(hashes * np.uint64(m)).min().view(np.int64).item() for m in COPY_MULTIPLIERS])
        return rows | {f"key{i}": [k[i] for k in keys] for i in range(4)}

    keyed = map_columns(sample.select("text", "label"), work, "text string, label int, key0 long, key1 long, key2 long, key3 long")
    for i in range(4):
        keyed = keyed.dropDuplicates([f"key{i}"])
    return keyed.select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Learn lexicon, harmless misspellings and weights from the training folds.

    Without toxic or without clean training rows the lexicon is empty and every score is low.  The sample
    (``per_class`` rows of each class) is the only bound: what comes to the driver are figures of its rows
    and those of its words that look like terms.
    """
    sample, sizes = labelled_sample(texts_of(docs), labels, "toxic", FOLDS, HELD_OUT, per_class)
    sample = cut(sample)
    single = cut(one_of_copies(sample))
    used = {int(r["label"]): int(r["count"]) for r in sample.groupBy("label").count().collect()}
    apart = {int(r["label"]): int(r["count"]) for r in single.groupBy("label").count().collect()}
    n_pos, n_neg = apart.get(1, 0), apart.get(0, 0)
    if not n_pos or not n_neg:
        return ToxicityModel()
    share = n_pos / (n_pos + n_neg)

    def may_be(p: str, n: str, p_all: str, n_all: str, least: int) -> Column:
        ratio = (F.col(p) + 0.5) / (n_pos + 1) / ((F.col(n) + 0.5) / (n_neg + 1))
        most = -(F.col(p_all) * math.log10(share) + F.col(n_all) * math.log10(1 - share))  # the surprise cannot be more
        return (F.col(p) >= least) & (ratio >= ODDS) & (most >= SURPRISE)

    counted = _term_counts(single).filter(may_be("p", "n", "p", "n", LEAST_TEXTS) | may_be("p_forms", "n_forms", "p_words", "n_words", STEM_TEXTS))
    found = {r["term"]: tuple(r[k] for k in COUNTS) for r in counted.collect()}
    terms, stems = choose_terms(found, n_pos, n_neg)

    @per_task
    def misspellings():
        automaton = LexiconAutomaton(terms)

        def work(rows: dict[str, list]) -> dict[str, list]:
            words, texts = Counter(), Counter()
            for text in rows["text"]:
                near = {w for w in {w.lower() for w in WORD.findall(text or "")} if automaton.edits(w) > 0}
                words.update(near)
                texts.update({t for w in near for t in automaton.near(w)})
            return {"word": [*words, *[None] * len(texts)], "term": [*[None] * len(words), *texts], "n": [*words.values(), *texts.values()]}

        return work

    clean = sample.filter("label = 0").select("text")
    near = map_columns(clean, misspellings, "word string, term string, n long").groupBy("word", "term").agg(F.sum("n").alias("n")).collect()
    among = {r["term"]: r["n"] for r in near if r["term"] is not None}
    rarer = {t for t in terms if (found[t][0] + 0.5) / (n_pos + 1) >= ODDS * (among.get(t, 0) + 0.5) / (used.get(0, 0) + 1)}
    near = [r for r in near if r["word"] is not None]
    model = ToxicityModel(terms, stems, exact=frozenset(terms) - rarer, harmless=frozenset(r["word"] for r in near))
    # a clean text is judged by the misspellings of the other clean texts, as a new text will be
    model.apart = frozenset(r["word"] for r in near if r["n"] > 1)
    figures = _features(sample, model).collect()
    x = np.array([r["features"] for r in figures])
    y = np.array([r["label"] for r in figures], float)
    share = {c: sizes[c] / max(1, used[c]) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0]) * len(y) / sum(sizes.values())
    model.weights = fit_logistic(x, y, weight, PRIOR)
    if (wrong := model.weights[:-1] < 0).any():  # no hit speaks for a text
        model.weights = np.where(np.append(wrong, False), 0.0, fit_logistic(np.where(wrong, 0.0, x), y, weight, PRIOR))
    return model


def _features(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    @per_task
    def start():
        scorers = {1: Scorer(model), 0: Scorer(replace(model, harmless=model.apart))}
        return lambda rows: {"label": rows["label"], "features": [scorers[y].features(t or "") for y, t in zip(rows["label"], rows["text"])]}

    return map_columns(sample.select("label", "text"), start, "label int, features array<double>")


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each whole text; null and empty texts get the score of no hits.

    Equal texts have equal scores; repeated rows give repeated rows, an empty table none; a null doc_id stays
    null and counts as 0 for the fold; further columns are not read.  A very long text is read as one.
    """

    @per_task
    def start():
        scorer = Scorer(model)
        return lambda rows: {"doc_id": rows["doc_id"], "score": [scorer.score(t) for t in rows["text"]]}

    scored = map_columns(texts_of(docs), start, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents whose text is not predicted toxic; all their columns stay as they are, null texts and repeated rows too."""

    send_package(docs.sparkSession)
    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype=float)

    return docs.filter(toxicity(F.col("text")) < THRESHOLD)
