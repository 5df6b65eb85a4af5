"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes, calibrated scores and evidence.

Terms are whole lower-cased words of any length, digits included, the runs of four and five letters inside of words, and those of one to three characters in
scripts without spaces: all whose presence depends on the label by a chi-square test on the learning sample. A text's vector has (1 + ln tf) * idf for each, with unit norm. The
index keeps the examples in blocks; a block's greatest weight of each term bounds the cosine of all its examples, so blocks are scored
from the highest bound down until none can reach the ``NEIGHBOURS`` best: the result is that of a full scan. Votes are weighted by
the square of the cosine, with a prior for texts without terms. A monotone fit makes scores of votes. As terms know the rows they were chosen on, it is fitted
on the votes that each of ``FOLDS`` parts of the sample gets from terms and examples of the others. The parts are dealt in order of the text, so that
copies are met in the other parts as often as they will be among documents to score.

The sample is bounded by ``LEARN_ROWS`` for each label, evenly drawn by a hash of the key; all else covers whole texts. Labels and keys
of documents that are scored are no part of a score. Of several texts of one labelled key the least is learned from. Null, empty and blank texts have no terms and get the score of such texts.
Rows without a label are not learned from; with no label of one kind, the score is the share of the other. Repeated rows get equal rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import small_batches, tidied
from .word_model import UNSPACED

LEARN_ROWS = 3_000
#: Chi-square with one degree of freedom at a probability of 1e-5.
LEAST_CHI2 = 19.5
NEIGHBOURS = 15
BLOCK = 64
GRAMS = (4, 5)
SHORT = (1, 2, 3)
PRIOR_WEIGHT = 0.05
FOLDS = 5

#: Bytes of blocks that a worker keeps spread out.
_DENSE = 128 << 20

_LETTERS = re.compile(r"[^\W\d_]{4,}")
_WORD = re.compile(r"\w+")
_RUN = re.compile(f"[{UNSPACED}]+")


def _plain(text: str) -> str:
    """The words of a text with a space before and after each, so that a whole word is a run of characters like any other."""
    return f" {' '.join(_WORD.findall(text.lower()))} "


def _runs(words: set[str], lengths: tuple[int, ...]) -> set[str]:
    return {w[i : i + n] for w in words for n in lengths for i in range(len(w) - n + 1)}


def _grams(text: str) -> set[str]:
    plain = _plain(text)
    return {f" {w} " for w in plain.split()} | _runs(set(_LETTERS.findall(plain)), GRAMS) | _runs(set(_RUN.findall(plain)), SHORT)


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    keys: list  # of examples, in the order of the index
    labels: np.ndarray
    weights: np.ndarray  # rows that an example stands for
    prior: float
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # by block: terms, places in the block and weights
    block_max: np.ndarray | None = None  # by term and block
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def __post_init__(self) -> None:
        self._automaton = self._blocks = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_blocks": None}

    def _block(self, b: int) -> np.ndarray:
        """The weights of a block by term and place; its postings spread out once in each worker, or each time if all would take too much."""
        if self._blocks is None:
            self._blocks = [None] * self.block_max.shape[1]
        if self._blocks[b] is not None:
            return self._blocks[b]
        w = np.zeros((len(self.terms), BLOCK), np.float32)
        term, place, weight = self.postings[b]
        w[term, place] = weight
        if w.nbytes * len(self._blocks) <= _DENSE:
            self._blocks[b] = w
        return w

    def counts(self, text: str) -> Counter:
        """How often each term occurs in a text."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                self._automaton.add_word(term, i)
            if self.terms:
                self._automaton.make_automaton()
        return Counter(i for _, i in self._automaton.iter(_plain(text))) if self.terms and text else Counter()

    def weighted(self, counts: dict[int, int]) -> dict[int, float]:
        """Weights of counted terms, with unit norm."""
        raw = {i: (1 + math.log(c)) * self.idf[i] for i, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {i: x / norm for i, x in raw.items()}

    def vector(self, text: str) -> dict[int, float]:
        return self.weighted(self.counts(text))

    def index(self, vectors: list[dict[int, float]]) -> None:
        blocks = -(-len(vectors) // BLOCK)
        self.postings, self.block_max = [], np.zeros((len(self.terms), blocks))
        for b in range(blocks):
            found = [(i, n, x) for n, v in enumerate(vectors[b * BLOCK : (b + 1) * BLOCK]) for i, x in v.items()]
            term, place, weight = (np.array(c, kind) for c, kind in zip(zip(*found, strict=True), (np.int64, np.int64, np.float32), strict=True))
            self.postings.append((term, place, weight))
            np.maximum.at(self.block_max[:, b], term, weight)

    def nearest(self, v: dict[int, float], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best examples with a term in common, best first, ties by place."""
        if not v or not len(self.labels):
            return np.zeros(0, np.int64), np.zeros(0)
        ids, q = np.fromiter(v, np.int64), np.fromiter(v.values(), float)
        bound = q @ self.block_max[ids]
        place, score = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(score) == k and bound[b] < score[-1] - 1e-12):
                break
            part = q @ self._block(int(b))[ids]
            some = np.flatnonzero(part > 0)
            place, score = np.append(place, some + b * BLOCK), np.append(score, part[some])
            order = np.lexsort((place, -score))[:k]
            place, score = place[order], score[order]
        return place, score

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine**2 * self.weights[place]
        return float((w @ self.labels[place] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.curve), 0.0, 1.0))


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of x nearest to y by weighted squares, as points to interpolate between."""
    at, same = np.unique(x, return_inverse=True)  # equal votes get one score
    weight = np.bincount(same, w)
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for a, b, c in zip(at.tolist(), (np.bincount(same, w * y) / weight).tolist(), weight.tolist(), strict=True):
        pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            q = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + q[0] * q[1]) / (p[1] + q[1]), p[1] + q[1], q[3]
    points = [(at, p[0]) for p in pools for at in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    return np.array([a for a, _ in points]), np.array([b for _, b in points])


def _terms(names: list[str], a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> tuple[list[str], np.ndarray]:
    """The terms that depend on the label, most dependent first, and their weights, from the rows of each label with the term (``a``, ``b``) and in all."""
    a, b = a.astype(float), b.astype(float)
    c, d = n1 - a, n0 - b
    spread = (a + b) * (c + d) * n1 * n0
    chi2 = np.divide((n1 + n0) * (a * d - b * c) ** 2, spread, out=np.zeros(len(a)), where=spread > 0)
    order = sorted(np.flatnonzero(chi2 >= LEAST_CHI2).tolist(), key=lambda i: (-chi2[i], names[i]))
    return [names[i] for i in order], np.log((1 + n1 + n0) / (1 + a[order] + b[order])) + 1


def _indexed(rows: list[tuple], terms: list[str], idf: np.ndarray, found: list[dict[str, int]], weight: dict[int, float], rate: float) -> Model:
    """A model without its curve, whose examples are the rows with terms; ``found`` has the counts of terms in each row."""
    model = Model(terms, idf, [], np.zeros(0), np.zeros(0), rate)
    place = {t: i for i, t in enumerate(terms)}
    vectors = [model.weighted({place[t]: c for t, c in x.items() if t in place}) for x in found]
    bare = [r[2] for r, v in zip(rows, vectors, strict=True) if not v]
    spread = sum(weight[c] for c in bare)
    model.prior = weight[1] * sum(bare) / spread if spread else rate
    kept = [i for i, v in enumerate(vectors) if v]
    kept.sort(key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], -t)), i))  # like examples side by side
    model.keys = [rows[i][0] for i in kept]
    model.labels = np.array([rows[i][2] for i in kept], float)
    model.weights = np.array([weight[rows[i][2]] for i in kept])
    model.index([vectors[i] for i in kept])
    return model


def fit(rows: list[tuple], totals: dict[int, int]) -> Model:
    """A model from (key, text, label) rows and the number of rows of each label that they were drawn from."""
    rows = sorted(rows, key=lambda r: (str(r[1]), str(r[0])))
    n = Counter(r[2] for r in rows)
    weight = {c: totals[c] / n[c] for c in n}
    all_rows = sum(totals.values())
    rate = totals.get(1, 0) / all_rows if all_rows else 0.0
    if len(n) < 2:
        return Model([], np.zeros(0), [], np.zeros(0), np.zeros(0), rate, curve=(np.array([0.0, 1.0]), np.array([rate, rate])))
    fold = np.arange(len(rows)) % FOLDS
    label = np.array([r[2] for r in rows])
    at: dict[str, int] = {}
    grams = [np.fromiter((at.setdefault(g, len(at)) for g in _grams(r[1] or "")), np.int32) for r in rows]
    names = list(at)
    # Rows with each term, by fold and label; and rows.
    having = np.array([[np.bincount(np.concatenate([np.zeros(0, np.int32), *(grams[i] for i in np.flatnonzero((fold == f) & (label == c)))]), minlength=len(names)) for c in (0, 1)] for f in range(FOLDS)])
    rows_of = np.array([[((fold == f) & (label == c)).sum() for c in (0, 1)] for f in range(FOLDS)])
    chosen = []
    for out in (*range(FOLDS), None):  # without each part, and without none
        h, k = (x.sum(axis=0) - (0 if out is None else x[out]) for x in (having, rows_of))
        chosen.append(_terms(names, h[1], h[0], int(k[1]), int(k[0])))
    every = Model(sorted({t for terms, _ in chosen for t in terms}), np.zeros(0), [], np.zeros(0), np.zeros(0), rate)
    found = [{every.terms[i]: c for i, c in every.counts(r[1] or "").items()} for r in rows]
    votes = np.zeros(len(rows))
    for f in range(FOLDS):
        own, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        m = _indexed([rows[i] for i in others], *chosen[f], [found[i] for i in others], weight, rate)
        place = {t: i for i, t in enumerate(m.terms)}
        for i in own:
            votes[i] = m.vote(*m.nearest(m.weighted({place[t]: c for t, c in found[i].items() if t in place})))
    model = _indexed(rows, *chosen[-1], found, weight, rate)
    model.curve = _monotone(votes, label.astype(float), np.array([weight[c] for c in label.tolist()]))
    return model


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most about ``LEARN_ROWS`` labelled documents of each label among those that are ``allowed`` (a condition on the key)."""
    usable = labels.where(allowed & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    totals = {r._label: r["count"] for r in usable.groupBy("_label").count().collect()}
    share = F.coalesce(*[F.when(F.col("_label") == c, F.lit(min(1.0, LEARN_ROWS / t))) for c, t in totals.items()], F.lit(0.0))
    drawn = usable.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < share * 1_000_000)  # of bounded size
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_key")
    rows = found.groupBy("_key", "_label").agg(F.min("_text").alias("_text")).collect()  # so that repeats of a key add no rows
    return fit([(r._key, r._text, r._label) for r in rows], totals)


def toxicity(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``score`` (0 to 1) and ``evidence``: up to three nearest examples with their cosine and label."""
    item = T.StructType([T.StructField("example", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())])
    schema = T.StructType([df.schema[key], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(item))])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bare = own.score(own.prior)
        for whole in batches:
            for b in slices(whole):
                scores, shown = [], []
                for t in b.column(text).to_pylist():
                    v = own.vector(t or "")
                    if not v:
                        scores.append(bare)
                        shown.append([])
                        continue
                    place, cosine = own.nearest(v)
                    scores.append(own.score(own.vote(place, cosine)))
                    shown.append([{"example": str(own.keys[p]), "cosine": min(1.0, c), "label": int(own.labels[p])} for p, c in zip(place[:3].tolist(), cosine[:3].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(scores, pa.float64()), pa.array(shown, kind)], names=schema.names)

    return small_batches(df).select(key, text).mapInArrow(tidied(run), schema)
