"""Quality scores by Bradley-Terry pairwise ranking.

Every pair of one good and one bad labelled document is a preference. The model gives a document a score that is
linear in its features and is fitted by the logistic loss on feature differences. The threshold is the quantile of
the training scores at the share of bad documents; a logistic curve through it turns scores into 0..1 such that
the published cut (0.3) is that quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.llm.sampling import bounded_sample, id_and_text
from sedge.workspace import small_batches

#: Labelled documents to learn from at most, and preference pairs drawn from them.
SAMPLE, PAIRS, EPOCHS, SEED = 6000, 60_000, 60, 5
CUT = 0.3

#: Character classes: 0 lower-case or other letter, 1 capital, 2 digit, 3 space, 4 line feed, 5 stop or comma, 6 other sign.
_CLASS = np.array(
    [4 if c == 10 else 3 if chr(c).isspace() else 2 if chr(c).isdigit() else 1 if chr(c).isupper() else 0 if chr(c).isalpha() else 5 if chr(c) in ".,;:?'-" else 6 for c in range(1 << 16)],
    dtype=np.uint8,
)


def features(text: str | None) -> np.ndarray:
    """Shape of a text; null counts as empty."""
    text = text or ""
    n = max(len(text), 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lower, upper, digit, space, feed, stop, sign = np.bincount(_CLASS[np.minimum(points, 0xFFFF)], minlength=7)
    letters = max(lower + upper, 1)
    words = text.split()
    m = max(len(words), 1)
    distinct = len(set(words))
    lines = text.split("\n")
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return np.array(
        [
            1.0,
            np.log1p(len(text)),
            np.log1p(len(words)),
            upper / letters,
            min(upper / letters, 0.3),
            digit / n,
            sign / n,
            np.sqrt(sign / n),
            np.log1p(1000 * sign / n),
            stop / n,
            np.log1p(100 * stop / m),
            feed / n,
            distinct / m,
            np.log(distinct / m + 0.01),
            np.log1p(len(words)) * (1 - distinct / m),
            same / m,
            np.sqrt(same / m),
            len(set(lines)) / len(lines),
            (lower + upper) / m,
            (lower + upper + space + stop) / n,
            len(words) < 8,
            len(text) == 0,
        ],
        dtype=float,
    )


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Fit on features and labels, already in a fixed order. One label only: every document scores on its side of the cut."""
    width = x.shape[1] if x.size else len(features(""))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0 if len(good) or not len(bad) else 1.0, 1.0)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(SEED)
    difference = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(width)
    size, velocity = 256, np.zeros(width)
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(PAIRS), PAIRS // size):
            d = difference[batch]
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            velocity = 0.9 * velocity + (p @ d) / len(batch) - 1e-4 * w
            w = w + 0.05 / (1 + epoch / 10) * velocity
    raw = z @ w
    threshold = float(np.quantile(raw, len(bad) / len(y)))
    # Between the classes rather than on the edge of one of them.
    below, above = raw[raw < threshold], raw[raw >= threshold]
    if len(below) and len(above):
        threshold = (below.max() + above.min()) / 2
    slope = min((float(s) for s in np.geomspace(0.05, 20, 50)), key=lambda s: _loss(s * (raw - threshold) + np.log(CUT / (1 - CUT)), y))
    return QualityModel(mean, spread, w, float(threshold), slope)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())


def fit_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> QualityModel:
    """Learn from a bounded sample of the labels that may_learn allows; features are taken where the texts lie."""
    chosen = bounded_sample(labels.where(may_learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct(), sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    small_batches(docs.sparkSession)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [features(t) for t in batch["text"]]})

    rows = sorted(texts.select("doc_id", F.col("quality").cast("int"), "text").mapInPandas(extract, "doc_id long, quality int, x array<double>").orderBy("doc_id").limit(2 * sample).collect())
    return train(np.array([r[2] for r in rows], dtype=float).reshape(len(rows), -1), np.array([r[1] for r in rows]))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 if score >= 0.3) of every whole text; a null text is scored as empty."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["_text"]], dtype=float).reshape(len(batch), -1)
            s = model.score(x) if len(batch) else np.zeros(0)
            yield pd.DataFrame({id_col: batch["_id"], "score": s, "predicted": (s >= CUT).astype("int32")})

    kind = docs.schema[id_col].dataType.simpleString()
    return id_and_text(docs, id_col, text_col).mapInPandas(score, f"{id_col} {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
