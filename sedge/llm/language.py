"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's subwords are its character n-grams, word ends included. Each is hashed to a row of an embedding table, a
text is the average of its subwords' rows, and a linear softmax gives the languages. Hashes are rolled over the
characters of many texts at once; no word is looked at by itself. Table and softmax are
trained together by stochastic gradient descent in numpy. A temperature, fitted on documents that training did
not see, makes the highest probability a calibrated confidence; the rejection threshold is a low quantile of the
confidence of those documents that were predicted rightly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.llm.sampling import bounded_sample, id_and_text
from sedge.workspace import small_batches

#: Documents to learn from, at most about so many; a fifth of them only calibrate.
SAMPLE = 2000
BUCKET_BITS, DIM, EPOCHS, RATE, SEED = 15, 16, 4, 0.5, 11
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (1, 2, 3, 4)
#: Share of rightly predicted calibration documents that the threshold may reject.
REJECTED = 0.001
#: Characters hashed at once.
AT_ONCE = 1 << 17
UNKNOWN = "und"

_latin = re.compile("[A-Za-z]").search
_SPACE, _BASE, _MIX = np.uint32(32), np.uint32(0x01000193), np.uint32(0x9E3779B1)


def has_letter(text: str) -> bool:
    return bool(_latin(text)) or any(map(str.isalpha, text))


def prepared(text: str) -> str:
    """Lower-cased words with one space around each."""
    return f" {' '.join(text.lower().split())} "


def hashed(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length the starts and buckets of the n-grams of prepared texts: a space may only be an end, and
    of one character it is none."""
    space = codes == _SPACE
    letter = ~space
    inner = np.ones(len(codes), bool)  # no space between the first and the last character
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        rolled = (rolled[:size] * _BASE) + codes[n - 1 :] + np.uint32(1)
        if n > 2:
            inner = inner[:size] & letter[n - 2 : n - 2 + size]
        good = letter if n == 1 else letter[:size] | letter[1:] if n == 2 else inner[:size]
        if n in NGRAMS:
            at = np.flatnonzero(good)
            mixed = (rolled[at] ^ np.uint32(n)) * _MIX
            yield at, ((mixed ^ (mixed >> np.uint32(15))) * _BASE >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    codes = np.frombuffer(prepared(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = [b for _, b in hashed(codes)]
    rows, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, int))
    return rows, (counts / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding rows after the softmax's weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


def train(texts: list[str], labels: list[str]) -> LanguageModel:
    """Fit on texts and their languages, already in a fixed order. No labelled text: a model that knows no language."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    bags = [bag(t) for t in texts]
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(bags))
    hold = order[: max(1, len(order) // 5)] if len(order) > 20 else order
    fit = order[len(hold) :] if len(order) > 20 else order
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            rows, shares = bags[k]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(rows):
                continue
            mean = shares @ table[rows]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # A row moves with its share, scaled so that long texts teach as much as short ones.
            table[rows] -= rate * np.outer(np.minimum(shares * 50, 1), back)
    scores = table @ weights
    logits = np.array([bags[k][1] @ scores[bags[k][0]] + bias for k in hold])
    model = LanguageModel(languages, scores, bias, 1.0, 0.0)
    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=lambda t: _loss(logits, y[hold], t))
    best = model.probabilities(logits)
    right = best.argmax(1) == y[hold]
    model.threshold = min(float(np.quantile(best.max(1)[right], REJECTED)) if right.any() else 1.0, 0.5) if len(languages) > 1 else 0.0
    return model


def _loss(logits: np.ndarray, y: np.ndarray, t: float) -> float:
    z = logits / t
    z = z - z.max(1, keepdims=True)
    return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())


def fit_language(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of the rows that may_learn allows and whose language is known."""
    rows = bounded_sample(docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), sample, id_col).select(id_col, text_col, lang_col).collect()
    rows.sort(key=lambda r: r[0])
    return train([r[1] for r in rows], [r[2] for r in rows])


class Predictor:
    """Languages of whole texts: bucket scores are summed between the texts' ends, many texts at once."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.scores = model.scores.astype(np.float64)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, confidence) of each; a null text or one without letters is unknown with confidence 0."""
        found = [(UNKNOWN, 0.0)] * len(texts)
        if not self.model.languages:
            return found
        some, size = [], 0
        for k, text in enumerate(texts):
            if text is None or not has_letter(text):
                continue
            some.append(k)
            size += len(text)
            if size > AT_ONCE:
                self._decide([texts[i] for i in some], some, found)
                some, size = [], 0
        if some:
            self._decide([texts[i] for i in some], some, found)
        return found

    def _decide(self, texts: list[str], places: list[int], found: list[tuple[str, float]]) -> None:
        ready = [prepared(t) for t in texts]
        lengths = np.array([len(r) for r in ready])
        codes = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
        sums, counts = self.totals(codes, np.cumsum(lengths) - lengths)
        p = self.model.probabilities(sums / np.maximum(counts, 1)[:, None] + self.model.bias)
        best = p.argmax(1)
        for k, place in enumerate(places):
            found[place] = self.model.languages[best[k]], float(p[k, best[k]])

    def totals(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores and numbers of subwords of the texts that start at the given places; a long stretch goes in parts."""
        sums, counts = np.zeros((len(starts), self.scores.shape[1])), np.zeros(len(starts), np.int64)
        reach = max(NGRAMS) - 1
        for low in range(0, len(codes), AT_ONCE):
            high = min(low + AT_ONCE, len(codes))
            for at, buckets in hashed(codes[low : high + reach]):
                mine = at < high - low  # the rest belongs to the part that follows
                at, buckets = at[mine] + low, buckets[mine]
                if not len(at):
                    continue
                edges = np.searchsorted(at, starts)
                held = np.flatnonzero(np.diff(np.append(edges, len(at))))
                sums[held] += np.add.reduceat(self.scores[buckets], edges[held], axis=0)
                counts[held] += np.diff(np.append(edges, len(at)))[held]
        return sums, counts


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and accepted of every whole text, one row per input row.

    accepted is false where the language is unknown or the confidence is under the model's threshold. Ties go to
    the first language in alphabetical order; other columns are ignored; rows without an id are left out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x languages

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Predictor(shared.value)
        for batch in batches:
            found = own.predict(batch["_text"].tolist())
            scores = np.array([s for _, s in found], dtype=float)
            langs = [x for x, _ in found]
            yield pd.DataFrame({id_col: batch["_id"], "lang_pred": langs, "score": scores, "accepted": [x != UNKNOWN and s >= own.model.threshold for x, s in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    return id_and_text(docs, id_col, text_col).mapInPandas(predict, f"{id_col} {kind}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents whose language the model accepts, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Predictor(shared.value)
        for batch in batches:
            yield pd.Series([lang != UNKNOWN and score >= own.model.threshold for lang, score in own.predict(batch.tolist())], dtype=bool)

    return docs.where(accepts(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
