"""Document quality by Bradley-Terry ranking.

Each text has a vector of plain measures of form. Pairs of a good and a bad text say which is preferred; the score's weights
minimise the logistic loss on differences of the two vectors. The cut lies at the quantile of training scores that the share
of bad labels names, and scores are shifted so that the cut comes out as CUT.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.llm.labelled import MAX_TRAINING_ROWS, labelled_sample, logistic_fit, sigmoid
from corpusloom.llm.labelled import with_scores as score_texts

CUT = 0.3
#: Preference pairs to fit on, as a multiple of the labelled texts.
PAIRS_PER_TEXT = 4
SEED = 7
_SIGNS = b"!#$%&*+-/:;<=>?@[]^_`{|}~\"'(),."
_FEATURES = 15 + len(_SIGNS)


def measures(text: str | None) -> np.ndarray:
    """The vector of a text; a null counts as empty. Lengths enter as logarithms, everything else as shares."""
    out = np.zeros(_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    out[0], out[1] = np.log1p(n), np.log1p(len(words))
    if not words:
        return out
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    out[2], out[3], out[4] = h[48:58].sum(), h[65:91].sum(), h[97:123].sum()
    out[5], out[6], out[7] = h[10], h[32], h[128:].sum()
    count = len(words)
    kinds = Counter(words)
    out[8] = len(kinds) / count
    out[9] = sum(map(eq, words, words[1:])) / count
    out[10] = kinds.most_common(1)[0][1] / count
    lines = raw.split(b"\n")
    out[11] = 1 - len(set(lines)) / len(lines)
    out[12] = np.log1p(n / count)
    out[13] = sum(map(bytes.isupper, words)) / count
    out[14] = sum(map(bytes.isalpha, words)) / count
    out[15:] = h[list(_SIGNS)]
    return out


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(_FEATURES))
    cut: float = 0.0

    def raw(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        above = self.raw(np.array([measures(t) for t in texts])) - self.cut
        return np.where(above == 0, CUT, sigmoid(above + np.log(CUT / (1 - CUT))))


def fit_pairs(good: np.ndarray, bad: np.ndarray, seed: int = SEED) -> QualityModel:
    """Fits on seeded pairs of a row of `good` and one of `bad`. Without rows of both, every score is CUT."""
    if not len(good) or not len(bad):
        return QualityModel()
    every = np.vstack([good, bad])
    model = QualityModel(every.mean(0), np.maximum(every.std(0), 1e-6))
    unit = lambda x: np.clip((x - model.mean) / model.scale, -8, 8)
    draw = np.random.default_rng(seed)
    n = PAIRS_PER_TEXT * len(every)
    gap = unit(good)[draw.integers(len(good), size=n)] - unit(bad)[draw.integers(len(bad), size=n)]
    model.weights = logistic_fit(np.vstack([gap, -gap]), np.repeat([1.0, 0.0], n), ridge=1e-3)
    raw = np.sort(model.raw(every))
    at = len(bad)  # the quantile of as many texts as are bad
    model.cut = float((raw[at - 1] + raw[min(at, len(raw) - 1)]) / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> QualityModel:
    """Learns from at most `rows` labelled texts outside the held-out fold. Their vectors, of a fixed length, reach the driver."""
    sample = labelled_sample(docs, labels, "quality", rows)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"v": [measures(t) for t in part["text"]], "label": part["label"]})

    seen = sample.mapInPandas(measured, "v array<double>, label int").toPandas()
    seen = seen.assign(key=[np.asarray(v).tobytes() for v in seen["v"]]).sort_values(["label", "key"])  # whatever order tasks end in
    of = lambda k: np.array([np.asarray(v) for v in seen["v"][seen["label"] == k]]).reshape(-1, _FEATURES)
    return fit_pairs(of(1), of(0))


def with_scores(docs: DataFrame, model: QualityModel, name: str = "score", text: str = "text") -> DataFrame:
    """`docs` with the column `name`, 0 to 1, at least CUT for texts to keep; every row stays, without a shuffle.

    Null and empty texts have one vector and so one score; equal texts score alike, whatever their other columns. A model that
    saw no labels, or labels of one kind, gives CUT to all, so nothing is rejected. An empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, name, text, lambda texts: held.value.scores(texts))
