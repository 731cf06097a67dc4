"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is a list of general insults and the terms learned from labels:
whole words and stems (a stem matches any ending) that occur in toxic
documents of the sample and next to never in others, more often than chance
explains (one significance test for every size of the sample), chosen greedily
until another term explains too few further toxic documents.  The trie and the
automata of all terms form one automaton, determinised as texts are read, so
a word is dropped at the first letter that no term can still reach.

A hit counts as quoted where quotation marks or a reporting word stand in the
window of ``WINDOW`` words around it.  A logistic score weighs exact and
misspelled, quoted and unquoted hits; its weights are drawn to priors, so a
kind of hit that the labels never show keeps a sensible weight.

Empty and null texts have no hits and get the score of a text without hits.
Without labels the priors and the general list stand alone.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize
from .supervised import SAMPLE_ROWS, fold, labelled, pieces, with_scores

# General insults, reporting words, quotation marks.
INSULTS = ["bastard", "clown", "disgusting", "filth", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
REPORTING = ["called", "calls", "cited", "claimed", "quote", "quoted", "quotes", "said", "says", "wrote"]
QUOTES = "\"“”„«»‘"

# A word begins and ends with a letter; digits and underscores inside stay in it. Its parts are its runs of letters.
WORD = re.compile(r"[^\W\d_](?:\w*[^\W\d_])?")
PART = re.compile(r"[^\W\d_]{3,}")
TOKEN = re.compile(rf"{WORD.pattern}|[{QUOTES}]")
WINDOW = 6
STEMS = (4, 5, 6)
FALSE_SHARE = 0.05
ROUND = 4_000
PRIOR = np.array([-3.0, 4.0, 1.0, 0.7, 0.2])


def edits(term: str, stem: bool) -> int:
    """Edits allowed in a term of this length; terms under 4 letters and stems must match exactly."""
    return 0 if stem or len(term) < 4 else 1 if len(term) < 9 else 2


def spellings(text: str) -> set[str]:
    """The words of a text and, of words with digits or underscores inside, their parts too; 3 letters at least."""
    words = {w for w in WORD.findall(text) if len(w) > 2}
    return words | {p for w in words if not w.isalpha() for p in PART.findall(w)}


class Automaton:
    """The determinised intersection of Levenshtein automata with a trie of terms."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stem = [False]
        self.most = [0]
        for term, stem in sorted(terms):
            at, k = 0, edits(term, stem)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.stem.append(False)
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends[at] = max(self.ends[at], k)
            self.stem[at] = self.stem[at] or stem
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.best: list[int] = []
        self.final: list[int] = []
        self.memo: dict[str, int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        todo, low = list(found), {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or low.get(node, 99) <= e:
                continue
            low[node] = e
            todo += [(x, e + 1) for x in self.child[node].values()]  # a letter of the term left out
        key = frozenset(low.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.best.append(min((e for n, e in key if self.ends[n] >= e), default=-1))
            self.final.append(min((e for n, e in key if self.stem[n] and e == 0), default=-1))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        found = set()
        for node, e in self.states[state]:
            if c in self.child[node]:
                found.add((self.child[node][c], e))
            if e < self.most[node]:
                found.add((node, e + 1))
                found.update((x, e + 1) for x in self.child[node].values())
        self.next[state][c] = out = self._state(found)
        return out

    def match(self, word: str) -> int:
        """Edits between the word and its nearest term, or -1."""
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 300_000 or len(self.states) > 100_000:
                self.reset()
            state, known = self.start, -1
            for c in word:
                after = self.next[state].get(c)
                state = self._step(state, c) if after is None else after
                if state < 0:
                    break
                if self.final[state] == 0:
                    known = 0
                    break
            else:
                known = self.best[state]
            self.memo[word] = known
        return known


class ToxicityModel:
    def __init__(self, terms: list[tuple[str, bool]], weights: np.ndarray = PRIOR):
        self.terms, self.weights = terms, weights
        self.automaton: Automaton | None = None

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "automaton": None}

    def hits(self, word: str) -> list[int]:
        """Edits of each hit of a word: of the whole, else of its parts."""
        match = self.automaton.match
        if len(word) > 2 and (whole := match(word)) >= 0:
            return [whole]
        return [] if word.isalpha() else [e for p in PART.findall(word) if (e := match(p)) >= 0]

    def features(self, text: str) -> tuple[int, ...]:
        """(hits unquoted and quoted, misspelled hits unquoted and quoted) of a text."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        out, before, parts = [0, 0, 0, 0], [], pieces(text)
        ahead = deque([next(parts).lower()])
        while ahead:
            piece, behind, k = ahead.popleft(), [], 0
            while len(behind) < WINDOW and (k < len(ahead) or (more := next(parts, None)) is not None):
                if k == len(ahead):
                    ahead.append(more.lower())
                behind += [m.group() for m in islice(TOKEN.finditer(ahead[k]), WINDOW - len(behind))]
                k += 1
            hits = {w: found for w in set(WORD.findall(piece)) if (found := self.hits(w))}
            if not hits and not ahead:
                break
            own = TOKEN.findall(piece)
            tokens = before + own + behind
            for at in range(len(before), len(before) + len(own)):
                if tokens[at] in hits:
                    left, right = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + WINDOW + 1]
                    quoted = any(x in QUOTES for x in left) and any(x in QUOTES for x in right) or any(x in REPORTING for x in left + right)
                    for e in hits[tokens[at]]:
                        out[2 * (e > 0) + quoted] += 1
            before = (before + own)[-WINDOW:]
        return tuple(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + np.minimum(features, 3) @ self.weights[1:])))


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def chance(toxic, clean, share: float):
    """Log of a bound (Chernoff) on the probability that a term of so many documents has so many toxic ones by chance."""
    whole = toxic + clean
    q = toxic / whole
    spread = q * F.log(q / share) + F.when(clean > 0, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    return F.when(q > share, -whole * spread).otherwise(0.0)


def accepted(terms: DataFrame) -> float:
    """The largest ``p`` that holds false discoveries under ``FALSE_SHARE`` (Benjamini-Hochberg) over all ``terms``."""
    n = terms.count()
    level, k = -np.inf, 0
    for r in terms.where(F.col("p") <= np.log(FALSE_SHARE)).groupBy("p").count().orderBy("p").collect():  # a row for each pair of document counts
        k += r["count"]
        if r["p"] <= np.log(FALSE_SHARE * k / n):
            level = r["p"]
    return float(level)


def learn_terms(sample: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems of toxic documents; ``sample`` (id, text, y) has a bounded number of rows.

    Terms are chosen greedily by the further toxic documents that they explain, ``ROUND`` candidates at a time: only
    these bring their documents to the driver, and rounds go on until no term that the test admits is left over.
    """

    def count(batches):
        clean, rows = Counter(), []
        for batch in batches:
            for id_, text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = {w for p in pieces(text.lower()) for w in spellings(p)}
                terms = {w + "$" for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}
                if y > 0:
                    rows += [(t, id_) for t in terms]
                else:
                    clean.update(terms)
            if len(clean) + len(rows) > 300_000:
                yield _term_rows(clean, rows)
                clean, rows = Counter(), []
        yield _term_rows(clean, rows)

    found = sample.mapInArrow(count, "term string, id long, clean long")
    n, rows = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not 0 < n < rows:
        return []
    terms = found.groupBy("term").agg(F.collect_list("id").alias("ids"), F.sum("clean").alias("clean")).where(F.size("ids") > 0)
    terms = materialize(terms.withColumn("p", chance(F.size("ids"), F.col("clean"), n / rows)), "terms")
    fit = terms.where(F.col("p") <= accepted(terms)).where(F.col("clean") <= 0.03 * F.size("ids"))
    fit = materialize(fit.select("term", "ids", F.size("ids").alias("n")), "terms")
    discard(terms)
    least = 2  # further toxic documents that a chosen term explains
    open_ = {r["id"] for r in fit.select(F.explode("ids").alias("id")).distinct().collect()}  # at most the sample's rows
    chosen: set[str] = set()
    while open_:
        left = sample.sparkSession.createDataFrame(sorted((i,) for i in open_), "id long")
        gain = fit.select("term", F.explode("ids").alias("id")).join(F.broadcast(left), "id").groupBy("term").agg(F.count("*").alias("gain")).where(F.col("gain") >= least)
        best = gain.orderBy(F.col("gain").desc(), F.length("term"), "term").limit(ROUND)
        took = False
        for r in best.join(fit, "term").orderBy(F.col("gain").desc(), F.length("term"), "term").collect():  # at most ROUND rows
            if r["term"] in chosen:
                continue
            now = open_.intersection(r["ids"])
            if len(now) >= least and len(now) >= 0.8 * r["gain"]:  # one sweep takes every term whose gain still stands
                chosen.add(r["term"])
                open_ -= now
                took = True
        if not took:
            break
    stems = [t for t in chosen if not t.endswith("$")]
    word = F.col("term").endswith("$")
    beside = F.col("n") >= 0.02 * n  # frequent words, and words beside their stems: stems match without edits
    for k in STEMS:
        beside |= F.substring("term", 1, k).isin([t for t in stems if len(t) == k])
    whole = [r["term"] for r in fit.where(word & beside).select("term").collect()]
    discard(fit)
    return sorted({(t.rstrip("$"), not t.endswith("$")) for t in [*chosen, *whole]})


def _term_rows(clean: Counter, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*clean, *(t for t, _ in rows)], pa.string()), pa.array([None] * len(clean) + [i for _, i in rows], pa.int64()), pa.array([*clean.values(), *[0] * len(rows)], pa.int64())], ["term", "id", "clean"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows; ``allowed`` limits whose labels are learned from."""
    sample = materialize(labelled(docs, labels, label_col, id_col, text_col, allowed, sample_rows), "toxicity")
    model = ToxicityModel(sorted({(t, False) for t in INSULTS} | set(learn_terms(sample))))

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.features(t) for t in _texts(batch.column(0))], pa.list_(pa.int64())), batch.column(1)], ["f", "y"])

    rows = sample.select("text", "y").mapInArrow(measure, "f array<long>, y int").groupBy("f", "y").count().collect()  # bounded by sample_rows
    discard(sample)
    if rows:
        x = np.hstack([np.ones((len(rows), 1)), np.minimum(np.array([r["f"] for r in rows], float), 3)])
        y, k, w = np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float), PRIOR.copy()
        for _ in range(50):  # Newton steps on the penalised likelihood
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + np.eye(5), x.T @ (k * (y - p)) - (w - PRIOR))
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        model.weights = w
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score (0 to 1) and the prediction (1 if score >= ``least``)."""

    def score(column):
        for at in range(0, len(column), 1000):
            part = _texts(column.slice(at, 1000))
            yield at, model.score(np.array([model.features(t) for t in part], float).reshape(-1, 4))

    return with_scores(docs, text_col, score, least, names)


def op7_levenshtein_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, fold("id", 4) != 2)
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
