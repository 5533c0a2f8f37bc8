"""Toxicity by maximum-scoring segments.

Every word has a log-odds score, toxic against clean, under Dirichlet priors whose shape is the whole corpus's word counts.
A word's evidence is read at two levels, the word and its first letters, and the level with the stronger evidence speaks;
weak evidence counts nothing, and each word costs a small drift, so that a clean text's expected score is negative. A linear
scan then finds all maximal scoring segments of a text. By extreme-value theory the best segment of n words of a clean text
exceeds S with probability 1 - exp(-K n exp(-lambda S)). Lambda and K are fitted to the best segments that clean training
texts really have under scores learnt from other texts (two folds); segments that pass a significance level are toxic
passages, and a document's score is a logistic calibration, on the same two folds, of the strongest segment's extreme-value
statistic and of the sum of its significant ones.

Words are counted in a fixed number of hash buckets, so the model's size has a bound of its own: counts for all documents
cover every word of every text, and the broadcast tables are 2^18 and 2^16 floats at any corpus size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.labelled import MAX_TRAINING_ROWS, labelled_sample, logistic_fit, sigmoid
from corpusloom.llm.labelled import with_scores as score_texts

WORD_BITS, STEM_BITS = 18, 16
WORDS, STEMS = 1 << WORD_BITS, 1 << STEM_BITS
STEM_LETTERS = 4
#: Pseudo-words that the prior is worth, as a share of the labelled ones.
PRIOR_SHARE = 0.01
#: Root of the deviance below which a word's evidence counts nothing.
EVIDENCE_CUT = 4.5
DRIFT = 0.05
SIGNIFICANCE = 0.01
#: Clean texts with a scoring segment from which lambda and K are fitted to them; below, lambda comes from the words alone.
MIN_SCORING = 30
_CACHE = 400_000
_WORD = re.compile(r"[^\W\d_]+")


class _Buckets(dict):
    """Word to its word bucket and stem bucket in one number; forgets everything when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        w = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        s = zlib.crc32(word[:STEM_LETTERS].encode("utf-8", "surrogatepass"), 1)
        code = self[word] = (w & (WORDS - 1)) | ((s & (STEMS - 1)) << WORD_BITS)
        return code


def _codes(text: str, buckets: _Buckets) -> list[int]:
    return list(map(buckets.__getitem__, _WORD.findall(text.lower())))


def _count(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    """(text, kind 0 or 1) to (bucket, n0, n1): word buckets first, then stem buckets. once: a word counts once a text, so
    that one text full of a word proves no more than one with it."""
    buckets = _Buckets()
    sums = np.zeros((2, WORDS + STEMS), np.int64)
    for batch in batches:
        codes: tuple[list[int], list[int]] = ([], [])
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                codes[kind].extend(set(_codes(text, buckets)) if once else _codes(text, buckets))
            if len(codes[kind]) > 1_000_000:
                _add(sums[kind], codes[kind])
        for kind in (0, 1):
            _add(sums[kind], codes[kind])
    there = np.flatnonzero(sums.any(0))
    for at in range(0, len(there), 50_000):
        some = there[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0, some]), pa.array(sums[1, some])], ["bucket", "n0", "n1"])


def _add(sums: np.ndarray, codes: list[int]) -> None:
    if codes:
        c = np.array(codes, np.int64)
        sums[:WORDS] += np.bincount(c & (WORDS - 1), minlength=WORDS)
        sums[WORDS:] += np.bincount(c >> WORD_BITS, minlength=STEMS)
        codes.clear()


def word_counts(texts: DataFrame, once: bool = False) -> np.ndarray:
    """(text, kind 0 or 1) to counts by kind and bucket, summed by Spark; as many rows as buckets reach the driver."""
    rows = texts.mapInArrow(lambda batches: _count(batches, once), "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, WORDS + STEMS))
    at = rows["bucket"].to_numpy()
    out[0, at], out[1, at] = rows["n0"].to_numpy(), rows["n1"].to_numpy()
    return out


def dirichlet_log_odds(toxic: np.ndarray, clean: np.ndarray, background: np.ndarray, prior_share: float = PRIOR_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds, evidence, share among clean words) of each bucket, with pseudo-words dealt out as the background is.

    Evidence is the signed root of the deviance of the two counts from equal rates, which also holds for small counts.
    """
    prior = max(1.0, prior_share * (toxic.sum() + clean.sum()))
    alpha = prior * (background + 0.5) / (background.sum() + 0.5 * len(background))
    a, b = toxic + alpha, clean + alpha
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    share = toxic.sum() / max(1.0, toxic.sum() + clean.sum())
    both = toxic + clean
    term = lambda n, part: n * np.log(np.maximum(n, 1e-12) / np.maximum(both * part, 1e-12))
    deviance = 2 * (term(toxic, share) + term(clean, 1 - share))
    return odds, np.sign(odds) * np.sqrt(np.maximum(deviance, 0)), b / b.sum()


def karlin_lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * scores)) = 1; needs a negative mean and some positive score."""
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def extreme_value_fit(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of P(best <= S) = exp(-K words exp(-lambda S)) by maximum likelihood; a text without a scoring segment
    (best of 0) tells no more than that its best is not above 0."""
    scores, mass = best[best > 0], words[best > 0]
    censored = float(words[best <= 0].sum())
    d, total = len(scores), float(scores.sum())
    k = lambda x: d / (float((mass * np.exp(-x * scores)).sum()) + censored)
    grid = np.geomspace(0.01, 50, 400)
    for _ in range(3):
        likelihood = [d * np.log(x) + d * np.log(k(x)) - x * total for x in grid]
        at = int(np.argmax(likelihood))
        x = float(grid[at])
        grid = np.linspace(grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)], 100)
    return x, k(x)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time, as Ruzzo and Tompa define them.

    Runs of words that score nothing are stepped over at once, so only the words with a positive score cost a step.
    """
    ups = np.flatnonzero(scores > 0)
    if not len(ups):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=float)))
    found: list[list] = []  # start, end, sum before the start, sum at the end
    before: list[int] = []  # of each: the nearest earlier one with a smaller sum before its start, or -1
    for i in ups.tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = before[j]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right])
                before.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], before[j:]
    return [(a, b, float(r - x)) for a, b, x, r in found]


@dataclass
class ToxicityModel:
    """words and stems: score and evidence of each bucket. lam and k: of the extreme-value distribution. weights: of the
    calibration (constant, strongest, sum)."""

    word_score: np.ndarray
    word_z: np.ndarray
    stem_score: np.ndarray
    stem_z: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    @cached_property
    def buckets(self) -> _Buckets:
        return _Buckets()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "buckets"}

    def word_scores(self, codes: list[int]) -> np.ndarray:
        c = np.array(codes, np.int64)
        w, s = c & (WORDS - 1), c >> WORD_BITS
        scores = np.where(np.abs(self.word_z[w]) >= np.abs(self.stem_z[s]), self.word_score[w], self.stem_score[s])
        scores[1:][c[1:] == c[:-1]] = 0  # a word said again at once adds nothing
        return scores - DRIFT

    def strength(self, score: float | np.ndarray, words: int) -> float | np.ndarray:
        """Minus the logarithm of the number of segments as strong that so many words of clean texts would have."""
        return self.lam * score - np.log(self.k * max(1, words))

    def segment_scores(self, text: str | None) -> tuple[int, list[float]]:
        """The number of words, and the scores of all maximal segments."""
        codes = _codes(text, self.buckets) if text else []
        return len(codes), [s for _, _, s in maximal_segments(self.word_scores(codes))] if codes else []

    def features(self, words: int, scores: list[float]) -> tuple[float, float]:
        strong = self.strength(np.array([0.0, *scores]), words)
        return min(50.0, float(strong.max())), float(np.log1p(strong[1:][strong[1:] >= -np.log(SIGNIFICANCE)].sum()))

    def score(self, text: str | None) -> float:
        a, b = self.features(*self.segment_scores(text))
        return float(sigmoid(self.weights[0] + self.weights[1] * a + self.weights[2] * b))

    def passages(self, text: str | None) -> list[dict]:
        """Every significant toxic passage: start and end in code points, score, and extreme-value probability."""
        lower = text.lower() if text else ""
        spans = [m.span() for m in _WORD.finditer(lower)]
        if not spans or len(lower) != len(text):  # a letter that grows in lower case would shift the places
            spans = [m.span() for m in _WORD.finditer(text)] if text else []
            lower = text or ""
        codes = [self.buckets[lower[a:b].lower()] for a, b in spans]
        found = []
        for a, b, s in maximal_segments(self.word_scores(codes)) if codes else []:
            p = float(-np.expm1(-np.exp(-self.strength(s, len(codes)))))
            if p <= SIGNIFICANCE:
                found.append({"start": spans[a][0], "end": spans[b - 1][1], "score": s, "p": p})
        return found


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Learns from at most `rows` labelled texts outside the held-out fold; the priors come from all texts.

    Without labels of both kinds every text gets the share of toxic labels as its score.
    """
    sample = labelled_sample(docs, labels, "toxic", rows).withColumn("fold", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)).cast("int"))
    background = word_counts(docs.select("text", F.lit(0).alias("kind")))[0]
    counts = [word_counts(sample.filter(F.col("fold") == f).select("text", (F.col("label") == 1).cast("int").alias("kind")), once=True) for f in (0, 1)]
    model, of_words = _scored(counts[0] + counts[1], background)
    # Each fold is scanned under what the other one taught; where that lacks a kind, under the whole.
    whole = [c.sum(1).min() > 0 for c in counts]
    others = [_scored(counts[1 - f], background)[0] if all(whole) else model for f in (0, 1)]
    held = sample.sparkSession.sparkContext.broadcast(others)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value[f].segment_scores(t) for t, f in zip(batch["text"].to_pylist(), batch["fold"].to_pylist(), strict=True)]
            columns = [batch["label"].cast(pa.int32()), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "words", "scores"])

    seen = sample.select("text", "label", "fold").mapInArrow(scanned, "label int, words long, scores array<double>").toArrow()
    y = (seen["label"].to_numpy() == 1).astype(float)
    words, scores = seen["words"].to_numpy(), seen["scores"].to_pylist()
    best = np.array([max(x, default=0.0) for x in scores])
    clean = (y == 0) & (words > 0)
    if (best[clean] > 0).sum() >= MIN_SCORING:
        model.lam, model.k = extreme_value_fit(best[clean], words[clean].astype(float))
    elif of_words:
        model.lam = of_words
    if 0 < y.sum() < len(y):
        both = np.array([model.features(n, x) for n, x in zip(words.tolist(), scores, strict=True)])
        model.weights = tuple(logistic_fit(np.column_stack([np.ones(len(y)), both]), y, ridge=1e-4))
    else:
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        model.weights = (float(np.log(rate / (1 - rate))), 0.0, 0.0)
    return model


def _scored(counts: np.ndarray, background: np.ndarray) -> tuple[ToxicityModel, float | None]:
    """The scores that counts of clean and toxic texts give, and the lambda of the clean words alone, where there is one."""
    clean, toxic = counts
    parts, shares = [], []
    for part in (slice(0, WORDS), slice(WORDS, None)):
        odds, z, share = dirichlet_log_odds(toxic[part], clean[part], background[part])
        shares.append(share)
        parts += [odds * np.maximum(0, 1 - (EVIDENCE_CUT / np.maximum(np.abs(z), 1e-9)) ** 2), z]
    model = ToxicityModel(*(x.astype(np.float32) for x in parts))
    scores = np.asarray(model.word_score, float) - DRIFT
    fits = (scores > 0).any() and (shares[0] * scores).sum() < 0
    return model, karlin_lambda(scores, shares[0]) if fits else None


def toxic_passages(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, score, p), a row for every significant passage of every text. Null and empty texts have none, repeated
    rows each have theirs, and an empty table gives none. `doc_id` is read as a long."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [{"doc_id": i} | p for i, t in zip(part["doc_id"], part["text"], strict=True) for p in held.value.passages(t)]
            yield pd.DataFrame(found, columns=["doc_id", "start", "end", "score", "p"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(spans, "doc_id long, start long, end long, score double, p double")


def with_scores(docs: DataFrame, model: ToxicityModel, name: str = "score", text: str = "text") -> DataFrame:
    """`docs` with the column `name`, 0 to 1; every row stays, in one pass and without a shuffle.

    Null and empty texts get the score of a text without words; repeated rows are scored each; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, name, text, lambda texts: np.array([held.value.score(t) for t in texts]))
