"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features are its characters' kinds, its words (hashed) and those of the
lines on either side; the chain adds a weight for each pair of neighbouring labels.  Line labels are hidden: the field is fitted to labelled documents, whose
label depends on the length-weighted share of good lines, by gradient ascent on the likelihood.  Scoring runs forward and backward over all lines
of a text and averages the marginal of "good", weighted by line length; a logistic curve fitted on
the same training rows maps the average to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, unused

MARKS = b"!\"#$%&()*+/<=>@[\\]^_`{|}~"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WORD_MASK = (1 << 14) - 1
TAGS = re.compile(rb"(\S)\1\1")
OWN = ("marks", "shout", "capitals", "repeats", "again", "lone", "digits", "runs", "long", "short", "sentence", "length")


def line_features(line: bytes) -> list[float]:
    """Features of one line, each between 0 and about 1 (order: ``OWN``)."""
    n = len(line) + 1
    words = line.split()
    k = len(words) + 1
    marks = len(line) - len(line.translate(None, MARKS))
    letters = len(line) - len(line.translate(None, LETTERS)) + 1
    upper = len(line) - len(line.translate(None, LETTERS[:26]))
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    return [
        min(1.0, 4 * marks / n),
        upper / letters if letters > 8 else 0.0,
        min(1.0, upper / k),
        max(counts.values(), default=0) / k if k > 4 else 0.0,
        min(1.0, 2 * same / k),
        min(1.0, 2 * lone / k),
        min(1.0, 4 * (len(line) - len(line.translate(None, b"0123456789"))) / n),
        min(1.0, 4 * len(TAGS.findall(line)) / k),
        min(1.0, max(map(len, words), default=0) / 40),
        min(1.0, 4 / k),
        1.0 if line.rstrip()[-1:] in (b".", b"!", b"?") else 0.0,
        min(1.0, math.log1p(n) / 8),
    ]


def _words(line: bytes) -> list[int]:
    """Hash cells of a line's words (lower case, A-Z only)."""
    return [crc32(w) & WORD_MASK for w in line.lower().split()]


@dataclass
class Lines:
    """Lines of a text: surface features with the neighbours' (the last constant), the words of every line, and lengths."""

    surface: np.ndarray
    words: np.ndarray  # hash cells, line by line
    of_line: np.ndarray  # line of each word
    share: np.ndarray  # weight of each word: one by the root of the words of its line
    lengths: np.ndarray


def text_lines(text: str | None) -> Lines:
    """All lines of a text, blank ones too; a null or empty text has one empty line."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    own = np.array([line_features(x) for x in lines])
    before, after = np.vstack([own[:1] * 0, own[:-1]]), np.vstack([own[1:], own[:1] * 0])
    edge = np.zeros((len(own), 2))
    edge[0, 0] = edge[-1, 1] = 1
    surface = np.hstack([own, own[:, :7] ** 2, before, after, edge, np.ones((len(own), 1))])
    cells = [_words(x) for x in lines]
    sizes = np.array([len(c) for c in cells])
    words = np.fromiter((c for line in cells for c in line), np.int64, int(sizes.sum()))
    share = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    return Lines(surface, words, np.repeat(np.arange(len(lines)), sizes), share, np.array([len(x) + 1.0 for x in lines]))


def line_scores(x: Lines, weights: np.ndarray, own: np.ndarray, near: np.ndarray, firsts: np.ndarray | None = None) -> np.ndarray:
    """Log odds of good by features alone: the line's surface and words, and its neighbours' words.  ``firsts`` marks lines that begin a text."""
    n = len(x.lengths)
    beside = np.bincount(x.of_line, near[x.words] * x.share, n)
    out = x.surface @ weights + np.bincount(x.of_line, own[x.words] * x.share, n)
    later = np.append(0.0, beside[:-1])
    earlier = np.append(beside[1:], 0.0)
    if firsts is not None:
        later[firsts] = 0
        earlier[np.append(firsts[1:], n) - 1] = 0
    return out + later + earlier


def _messages(score: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Log odds passed into each line from the lines before it.  ``score``: log odds of good by the line's own features;
    ``pair[a][b]``: weight of label b after label a."""
    (p00, p01), (p10, p11) = pair.tolist()
    out, m = np.zeros(len(score)), 0.0
    exp, log = math.exp, math.log
    for t, s in enumerate(score.tolist()):
        out[t] = m
        x = m + s
        # Both sums over the former label are divided by the larger term, so that nothing overflows.
        if x > 0:
            e = exp(-x)
            m = p11 + log(1 + e * exp(p01 - p11)) - p10 - log(1 + e * exp(p00 - p10))
        else:
            e = exp(x)
            m = p01 + log(1 + e * exp(p11 - p01)) - p00 - log(1 + e * exp(p10 - p00))
    return out


def marginals(score: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability of good for each line, given all lines."""
    return _sigmoid(_messages(score, pair) + score + _messages(score[::-1], pair.T)[::-1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Chains:
    """Forward-backward over many texts at once: texts in falling order of length, so that those with a t-th line come first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[self.order]
        self.sizes = sizes[self.order]
        active = [int(np.searchsorted(-self.sizes, -t, side="left")) for t in range(int(self.sizes[0]))]
        self.steps = [starts[:n] + t for t, n in enumerate(active)]  # places of the t-th lines
        self.ends = starts + self.sizes - 1

    def passed(self, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds passed into each line from before, and the log of each text's sum over all labellings."""
        into, mass = np.zeros(len(score)), np.zeros(len(self.sizes))
        odds = np.zeros(len(self.sizes))
        for t, at in enumerate(self.steps):
            n = len(at)
            if t:
                x = odds[:n]
                low = np.logaddexp(pair[0, 0], pair[1, 0] + x)
                into[at] = np.logaddexp(pair[0, 1], pair[1, 1] + x) - low
                mass[:n] += low
            odds[:n] = into[at] + score[at]
        total = np.empty(len(self.sizes))
        total[self.order] = mass + np.logaddexp(0, odds)
        return into, total

    def all(self, score: np.ndarray, pair: np.ndarray, turned: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of good for each line, expected pairs for each border between lines of a text (by its later line), and the logs of the texts' sums."""
        into, total = self.passed(score, pair)
        back = turned.passed(score[::-1], pair.T)[0][::-1]
        left, right = (into + score)[:-1], (back + score)[1:]
        log = np.stack([np.full(len(left), pair[0, 0]), pair[0, 1] + right, pair[1, 0] + left, pair[1, 1] + left + right], axis=1)
        p = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf))
        return _sigmoid(into + score + back), p / p.sum(axis=1, keepdims=True), total


@dataclass(frozen=True)
class LineField:
    weights: np.ndarray
    own: np.ndarray
    near: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float

    def lines(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good for each line, and the lines' lengths."""
        x = text_lines(text)
        return marginals(line_scores(x, self.weights, self.own, self.near), self.pair), x.lengths

    def document(self, text: str | None) -> float:
        """Probability that the document is good."""
        return float(_sigmoid(self.slope * _odds(*self.lines(text)) + self.shift))


def _odds(p: np.ndarray, lengths: np.ndarray) -> float:
    mean = float((p * lengths).sum() / lengths.sum())
    return math.log((mean + 1e-3) / (1 - mean + 1e-3))


def fit(texts: list[str | None], labels: list[int], steps: int = 80, ridge: float = 2e-3, word_ridge: float = 1e-2, evidence: float = 4.0, chain: bool = True) -> LineField:
    """Field fitted by Adam on the likelihood of the document labels; line labels are hidden.

    A document is good with log odds ``evidence * (2 g - 1)``, g the length-weighted share of its good lines.  Summed over all labellings of the lines,
    each weighted by the field, that gives the likelihood; its gradient is the difference of the expected counts given a good
    and given a bad document, times the label's residual.  So a line of a bad document may well be good, and pair weights are learned from how labels
    run through documents (``chain`` false leaves them at 0).  With labels of one kind only, or none, every document gets that kind's smoothed share as its score."""
    good = sum(labels)
    prior = math.log((good + 1) / (len(labels) - good + 1))
    parts = [text_lines(t) for t in texts]
    width = text_lines("").surface.shape[1]
    w, own, near, pair = np.zeros(width), np.zeros(WORD_MASK + 1), np.zeros(WORD_MASK + 1), np.zeros((2, 2))
    if good in (0, len(labels)):
        return LineField(w, own, near, pair, 0.0, prior)
    sizes = np.array([len(x.lengths) for x in parts])
    starts = np.cumsum(sizes) - sizes
    every = Lines(*(np.concatenate([getattr(x, f) + (at if f == "of_line" else 0) for x, at in zip(parts, starts.tolist(), strict=True)]) for f in ("surface", "words", "of_line", "share", "lengths")))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pull = evidence * every.lengths / np.bincount(doc, every.lengths)[doc]
    chains, turned = Chains(sizes), Chains(sizes[::-1])
    border = np.flatnonzero(doc[1:] == doc[:-1])
    y = np.array(labels, float)
    balance = np.where(y > 0, 0.5 / good, 0.5 / (len(y) - good))  # both kinds weigh the same
    params = [w, own, near, pair]
    moments, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, own, near, pair = params
        score = line_scores(every, w, own, near, starts)
        p1, pairs1, z1 = chains.all(score + pull, pair, turned)
        p0, pairs0, z0 = chains.all(score - pull, pair, turned)
        residual = (y - _sigmoid(z1 - z0 - evidence)) * balance
        d = residual[doc] * (p1 - p0)
        word = d[every.of_line] * every.share
        sides = np.append(d[1:] * (doc[1:] == doc[:-1]), 0.0) + np.append(0.0, d[:-1] * (doc[1:] == doc[:-1]))
        gradient = [
            every.surface.T @ d - ridge * w,
            np.bincount(every.words, word, len(own)) - word_ridge * own,
            np.bincount(every.words, sides[every.of_line] * every.share, len(near)) - word_ridge * near,
            (residual[doc[border + 1], None] * (pairs1 - pairs0)[border]).sum(axis=0).reshape(2, 2) - ridge * pair if chain else 0 * pair,
        ]
        for i, g in enumerate(gradient):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            params[i] = params[i] + 0.1 * (moments[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-6)
    w, own, near, pair = params
    score = line_scores(every, w, own, near, starts)
    p = chains.all(score, pair, turned)[0]
    mean = np.bincount(doc, p * every.lengths) / np.bincount(doc, every.lengths)
    z = np.log((mean + 1e-3) / (1 - mean + 1e-3))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method for the logistic curve, with a weak pull towards the identity
        p = _sigmoid(slope * z + shift)
        d, s = p - y, p * (1 - p)
        g = np.array([d @ z + 0.1 * (slope - 1), d.sum() + 0.1 * shift])
        h = np.array([[s @ (z * z) + 0.1, s @ z], [s @ z, s.sum() + 0.1]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(h, g)
    return LineField(w, own, near, pair, float(max(slope, 0.0)), float(shift))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 2000, max_bytes: int = 32_768) -> LineField:
    """Field fitted on a sample of labelled rows that are not held out.

    The sample is bounded: the ``max_docs`` rows first by a hash of the id, among those whose text has at most ``max_bytes``
    bytes.  Only the fit uses it; scoring reads every text whole.  Null labels and ids are left out.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(~held_out(F.col("id")) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes))
    picked = rows.select("id").join(marked, "id").distinct().orderBy(F.xxhash64("id"), "id", "label").limit(max_docs)
    # One text a labelled id, also where rows repeat: the least of them.
    sample = rows.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["id", "label"])
    return fit([t if isinstance(t, str) else None for t in sample["text"]], (sample["label"] > 0).astype(int).tolist())


def score(text: Column, field: LineField) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([field.document(t) for t in texts], dtype="float64")

    return of(text)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    Null and empty texts are scored as one empty line; a null id is never held out.  Repeated rows come back as often as they
    occur; equal texts have equal scores, so ties stay ties.  A very long text is scored whole.  With no usable labels every score is one half.  An empty table gives no rows.  Other columns are ignored.
    """
    field = train(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col), field).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose score reaches ``threshold``, with all their columns as they were.  Nulls, repeated rows, ties, very long texts and empty tables
    are as in ``quality``."""
    mark = unused(docs, "score")
    field = train(docs, labels, id_col, text_col)
    return docs.withColumn(mark, score(F.col(text_col), field)).filter(F.col(mark) >= threshold).drop(mark)


def op7_line_crf(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_line_crf": op7_line_crf}
