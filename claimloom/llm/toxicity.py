"""Toxicity scores from a learned lexicon, misspellings included.

Terms (whole words, and word beginnings where a language builds its insults by suffixes) are learned from
labelled rows. They form a trie; the trie is intersected with Levenshtein automata: a state is the set of
(trie node, edits) that a word read so far can be in, made deterministic as words are met. A word of five
letters or more may have one edit, of nine or more two; its first letter must stand, and a beginning matches
exactly. Every hit is weighed by its context window: between quotation marks or next to a reporting verb it
counts as quoted, else as abuse. A logistic model over these sums gives the score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import load, share, training_row, unpacked

MAX_TOXIC, MAX_CLEAN = 1500, 3000  # labelled rows that the lexicon and the weights are fitted on: the bound of the sample
MAX_TERMS = 400
WINDOW = 60  # characters of context on either side
QUOTES = "\"“”„«»‘’"
# Reporting verbs that mark a quotation.
REPORTING = ("said", "says", "wrote", "writes", "called", "quoted", "quote", "dijo", "escribió", "dit", "écrit", "sagte", "schrieb")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
FEATURES = 6


class LexiconAutomaton:
    """The lexicon trie under Levenshtein automata, made deterministic on demand."""

    MOST_STATES = 100_000  # beyond, known states are forgotten and made again

    def __init__(self, terms: dict[str, float], beginnings: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[tuple[float, int] | None] = [None]  # weight, allowed edits
        self.begin: list[float | None] = [None]
        self.room = [0]  # edits that any word below allows
        for term, weight in sorted(terms.items()):
            allowed = 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
            self.word[self._node(term, allowed)] = (weight, allowed)
        for term, weight in sorted(beginnings.items()):
            self.begin[self._node(term, 0)] = weight
        self._forget()

    def _node(self, term: str, allowed: int) -> int:
        at = 0
        self.room[0] = max(self.room[0], allowed)
        for c in term:
            if c not in self.child[at]:
                self.child[at][c] = len(self.child)
                for x, empty in ((self.child, {}), (self.word, None), (self.begin, None), (self.room, 0)):
                    x.append(empty)
            at = self.child[at][c]
            self.room[at] = max(self.room[at], allowed)
        return at

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.hits: list[tuple] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, places: frozenset) -> int:
        if places not in self.ids:
            self.ids[places] = len(self.steps)
            self.steps.append({})
            self.sets.append(places)
            words = [(e, -self.word[n][0]) for n, e in places if self.word[n] and e <= self.word[n][1]]
            begins = [-self.begin[n] for n, e in places if e == 0 and self.begin[n] is not None]
            self.hits.append((min(words, default=None), min(begins, default=None)))
        return self.ids[places]

    def _step(self, state: int, c: str) -> int:
        todo, best = [], {}
        for node, e in self.sets[state]:
            if c in self.child[node]:
                todo.append((self.child[node][c], e))
            if node:
                if e < self.room[node]:
                    todo.append((node, e + 1))
                todo += [(k, e + 1) for x, k in self.child[node].items() if x != c and e < self.room[k]]
        while todo:
            node, e = todo.pop()
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(k, e + 1) for k in self.child[node].values() if e < self.room[k]]
        return self._state(frozenset(best.items()))

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the closest term, or None."""
        if len(self.steps) > self.MOST_STATES:
            self._forget()
        state, begin = self.start, None
        for c in word:
            nxt = self.steps[state].get(c)
            if nxt is None:
                nxt = self.steps[state][c] = self._step(state, c)
            state = nxt
            if state == self.dead:
                break
            if self.hits[state][1] is not None:
                begin = self.hits[state][1]
        found = self.hits[state][0]
        if found and (found[0] == 0 or begin is None):
            return -found[1], found[0]
        return None if begin is None else (-begin, 0)


def quoted(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] stands in quotation marks or beside a reporting verb, within the window."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    left = before[before.rfind("\n") + 1 :]
    right = after.split("\n", 1)[0]
    opening = sum(left.count(q) for q in QUOTES)
    if opening % 2 and any(q in right for q in QUOTES):
        return True
    near = WORD.findall(before)[-3:] + WORD.findall(after)[:3]
    return any(w in REPORTING for w in near)


def features(text: str, lexicon: LexiconAutomaton, known: dict) -> list[float]:
    """Log sums of term weights: exact and misspelled, as abuse and quoted; the largest weight; hits by length."""
    text = text.lower()
    words = WORD.findall(text)
    hit = False
    for w in set(words):
        found = known.get(w, 0)
        if found == 0:
            if len(known) > 300_000:
                known.clear()
            found = known[w] = lexicon.match(w)
        hit = hit or found is not None
    if not hit:
        return [0.0] * FEATURES
    sums, most, n = [0.0] * 4, 0.0, 0
    for m in WORD.finditer(text):
        w = m.group()
        found = known[w] if w in known else lexicon.match(w)
        if found is None:
            continue
        weight, edits = found
        aside = quoted(text, m.start(), m.end())
        sums[2 * aside + (edits > 0)] += weight
        if not aside and not edits:
            most = max(most, weight)
        n += 1
    return [*map(math.log1p, sums), most, n / (len(words) + 10)]


class Model:
    def __init__(self, lexicon: LexiconAutomaton, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _featured(docs: DataFrame, lexicon: LexiconAutomaton) -> DataFrame:
    """(y, x) of the sample."""
    def run(batches):
        known: dict = {}
        for batch in batches:
            x = [features(t or "", lexicon, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    return docs.select("y", "text").mapInArrow(run, "y int, x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps; weight 0 is the intercept."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and weights from at most MAX_TOXIC toxic and MAX_CLEAN other training rows, those with the
    smallest id hashes. Without a toxic row the lexicon is empty and the score is the base rate."""
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & training_row(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    )
    present = docs.select(F.col(id_col).alias("id")).distinct()
    usable = marked.join(present, "id", "left_semi").withColumn("h", F.xxhash64("id"))
    chosen = usable.filter("y = 1").orderBy("h", "id").limit(MAX_TOXIC).unionByName(usable.filter("y <> 1").orderBy("h", "id").limit(MAX_CLEAN))
    chosen = {r.id: int(r.y == 1) for r in chosen.select("id", "y").collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k, v) for k, v in chosen.items()], "id long, y int")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")  # at most 4500 pairs
    n1, n0 = sum(chosen.values()), len(chosen) - sum(chosen.values())
    if not n1:
        return Model(LexiconAutomaton({}, {}), np.array([-3.0] + [0.0] * FEATURES))
    words = sample.select("id", "y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).filter("length(w) >= 3")
    pieces = F.array(F.concat(F.lit("="), "w"), *(F.when(F.length("w") > n, F.substring("w", 1, n)) for n in PREFIXES))
    counts = (
        words.select("id", "y", F.explode(pieces).alias("t")).filter("t IS NOT NULL").distinct()
        .groupBy("t").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    )
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    good = counts.filter(F.col("c1") >= max(3, 0.005 * n1)).withColumn("odds", odds).filter("odds >= 2.5")
    rows = {r.t: (r.c1, r.odds) for r in good.orderBy(F.desc(F.col("c1") * F.col("odds")), "t").limit(MAX_TERMS).collect()}
    terms = {t[1:]: v for t, v in rows.items() if t[0] == "="}
    begins = {}
    for t, (c1, weight) in rows.items():
        if t[0] == "=":
            continue
        below = [v[0] for w, v in terms.items() if w.startswith(t)]
        longer = [v[0] for w, v in rows.items() if len(w) > len(t) and w.startswith(t)]
        if c1 >= 1.3 * max(below, default=0) and not any(x >= 0.95 * c1 for x in longer):
            begins[t] = weight
    lexicon = LexiconAutomaton({w: v[1] for w, v in terms.items()}, begins)
    fit = _featured(sample, lexicon).collect()
    return Model(lexicon, fit_logistic(np.array([r.x for r in fit]), np.array([r.y for r in fit], dtype=float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, hits_per_word) per input row, from the whole text alone.

    Null and empty texts have no hit and get the score of such texts. Ids may be null or repeat. An empty
    table gives no rows. Other columns are not read.
    """
    shared = share(docs.sparkSession, model)

    def run(batches):
        model, known = unpacked(shared), {}
        for batch in batches:
            x = np.zeros((batch.num_rows, FEATURES))
            for low in range(0, batch.num_rows, 1024):
                for i, text in enumerate(batch.column(1).slice(low, 1024).to_pylist()):
                    x[low + i] = features(text or "", model.lexicon, known)
            p = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x[:, -1])],
                names=["doc_id", "score", "predicted", "hits_per_word"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int, hits_per_word double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = score(docs, train(docs, load(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "score", "predicted")
