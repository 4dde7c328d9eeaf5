"""Operator 1: toxicity by a convolutional text classifier, trained here in numpy.

Words are embedded as the mean of hashed rows for the word, its beginnings and its end, so unseen forms of a known
stem are recognised. Filters of widths 1, 2 and 3 run over the whole text; each filter's largest value over all
positions (max pooling) feeds a logistic output. Thresholds are set for each language, as guessed from the text
alone, on a part of the sample that training leaves out, and shift the score so that 0.5 is the threshold.

Scoring is a map over the scan in which only texts go through Python: the model is a few MB and travels with the
tasks, a worker keeps one bounded vocabulary for all its tasks, and long texts go through the filters a slice at a
time, so memory depends on neither the corpus nor a text's length.

Defined results
* null or empty text, or white space alone: the score of a text without any word (that of the output's bias);
* no labelled rows of one class in the sample: every score is that class's share of the sample (0 without labels);
* ties between languages go to the first of LANGUAGES; very long texts are pooled whole;
* repeated rows, and rows with one or no doc_id, each give their own result; an empty table gives an empty result;
* extra columns are kept by `score`, which replaces those named like its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table
from .training import sample

ROWS, WIDTH = 1 << 15, 16
#: Filters of each width.
FILTERS = {1: 16, 2: 8, 3: 8}
N_FILTERS = sum(FILTERS.values())
#: Passes over a sample: enough for VISITS documents in all, within bounds.
EPOCHS, VISITS, RATE, SEED = (3, 20), 7000, 0.1, 7
#: Words at a time that go through the filters, and words in a worker's cache.
SLICE, CACHE = 1 << 13, 50_000
#: Texts of a batch that are split into words at a time.
TEXTS = 64
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
#: Function words by which a text's language is guessed.
LANGUAGES = {
    "en": "the of and to in is it that for was on are as with be by this an or at from".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im nicht ein eine als auch".split(),
    "fr": "le la les de des et en un une du que qui dans pour par sur au est pas avec".split(),
    "es": "el los las que y del se por con una para su al lo como más no es de la".split(),
}
#: Rows of each class that a language's threshold needs; with fewer the threshold of all languages holds.
LEAST_FOR_THRESHOLD = 8


def features(word: str) -> list[int]:
    """Rows of a word: itself, its first 4 and 5 characters, its last 4."""
    w = word.strip(PUNCTUATION) or word
    return [zlib.crc32(x.encode()) % ROWS for x in (w, "^" + w[:4], "^^" + w[:5], w[-4:] + "$")]


def guess_language(words: list[str]) -> str:
    """The language with most function words; the first of LANGUAGES for a tie."""
    seen = Counter(words)
    return max(LANGUAGES, key=lambda k: sum(seen.get(w, 0) for w in LANGUAGES[k]))


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # by which a worker knows the model again

    def logit(self, pooled: np.ndarray) -> float:
        return float(pooled @ self.out) + self.out_bias


class Vocabulary:
    """Numbers of words and, for each word, its projection by every slice of every filter.

    It holds `limit` words, in an array made once; when it is full it starts anew. Words of a text beyond the limit
    get a larger array for that text alone.
    """

    def __init__(self, model: Model, limit: int = CACHE):
        self.model, self.limit = model, limit
        self.slices = [(w, j) for w in FILTERS for j in range(w)]
        self.weights = np.concatenate([model.filters[w][j] for w, j in self.slices], axis=1)
        at = np.cumsum([0, *(FILTERS[w] for w, _ in self.slices)])
        self.columns = {s: slice(at[k], at[k + 1]) for k, s in enumerate(self.slices)}
        self.reset()

    def reset(self, room: int = 0) -> None:
        self.known: dict[str, int] = {}
        if room > self.limit or len(getattr(self, "projected", ())) != self.limit:
            self.projected = np.zeros((max(room, self.limit), self.weights.shape[1]), np.float32)

    def add(self, new: list[str]) -> None:
        first = len(self.known)
        for at in range(0, len(new), SLICE):
            part = new[at : at + SLICE]
            rows = np.array([features(w) for w in part])
            self.projected[first + at : first + at + len(part)] = self.model.embed[rows].mean(axis=1) @ self.weights
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = set().union(*docs).difference(self.known) if docs else set()
        if len(self.known) + len(new) > self.limit:
            new = set().union(*docs)
            self.reset(len(new))
        if new:
            self.add(sorted(new))
        get = self.known.__getitem__
        return [np.fromiter(map(get, d), np.int32, len(d)) for d in docs]

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Largest value of each filter over all positions, at least 0 (the rectifier)."""
        out, k = np.zeros(N_FILTERS, np.float32), 0
        for w, n in FILTERS.items():
            b = self.model.bias[k : k + n]
            for at in range(0, len(ids) - w + 1, SLICE):
                part = ids[at : at + SLICE + w - 1]
                m = len(part) - w + 1
                s = self.projected[part[:m], self.columns[w, 0]]
                for j in range(1, w):
                    s = s + self.projected[part[j : m + j], self.columns[w, j]]
                np.maximum(out[k : k + n], s.max(axis=0) + b, out=out[k : k + n])
            k += n
        return out


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def train(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows; every fifth row is left out of the fit and sets the thresholds."""
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.3, (ROWS, WIDTH)).astype(np.float32)
    filters = {w: rng.normal(0, 0.3, (w, WIDTH, n)).astype(np.float32) for w, n in FILTERS.items()}
    model = Model(embed, filters, np.zeros(N_FILTERS, np.float32), rng.normal(0, 0.3, N_FILTERS).astype(np.float32), 0.0)
    fit = [r for k, r in enumerate(rows) if k % 5]
    if len({y for _, y in fit}) < 2:
        model.constant = float(np.mean([y for _, y in rows])) if rows else 0.0
        return model
    known: dict[str, int] = {}
    docs = []
    for text, _ in fit:
        docs.append(np.unique(np.array([known.setdefault(w, len(known)) for w in tokens(text)], np.int32), return_inverse=True))
    rows_of = np.array([features(w) for w in known], np.int32).reshape(-1, 4)
    labels = np.array([y for _, y in fit], np.float32)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    memory = {id(a): np.full(a.shape, 1e-2, np.float32) for a in (embed, *filters.values(), model.bias, model.out)}

    def descend(a: np.ndarray, g: np.ndarray, rate: float) -> None:
        m = memory[id(a)]
        m += g * g
        a -= rate * g / np.sqrt(m)

    bias_memory = 1e-2
    epochs = min(max(-(-VISITS // len(docs)), EPOCHS[0]), EPOCHS[1])
    for epoch in range(epochs):
        rate = RATE / (1 + 5 * epoch / epochs)
        for d in rng.permutation(len(docs)):
            uniq, back = docs[d]
            ids = back
            if not len(ids):
                continue
            vectors = embed[rows_of[uniq]].mean(axis=1)
            best, where, k = np.zeros(N_FILTERS, np.float32), np.full(N_FILTERS, -1), 0
            for w, n in FILTERS.items():
                m = len(ids) - w + 1
                if m > 0:
                    s = sum((vectors @ filters[w][j])[back[j : m + j]] for j in range(w))
                    top = s.argmax(axis=0)
                    value = s[top, np.arange(n)] + model.bias[k : k + n]
                    best[k : k + n], where[k : k + n] = np.maximum(value, 0), np.where(value > 0, top, -1)
                k += n
            p = 1 / (1 + np.exp(-np.clip(model.logit(best), -30, 30)))
            g = float((p - labels[d]) * weight[d])
            if abs(g) < 1e-3:
                continue
            through = np.where(where >= 0, g * model.out, 0).astype(np.float32)
            descend(model.out, (g * best).astype(np.float32), rate)
            bias_memory += g * g
            model.out_bias -= rate * g / bias_memory**0.5
            touched: dict[int, np.ndarray] = {}
            k = 0
            for w, n in FILTERS.items():
                grad = np.zeros_like(filters[w])
                for f in range(n):
                    at = where[k + f]
                    if at < 0:
                        continue
                    for j in range(w):
                        u = back[at + j]
                        grad[j, :, f] = through[k + f] * vectors[u]
                        touched[u] = touched.get(u, 0) + through[k + f] * filters[w][j][:, f]
                descend(filters[w], grad, rate)
                k += n
            descend(model.bias, through, rate)
            for u, gu in touched.items():
                r = rows_of[uniq[u]]
                m = memory[id(embed)]
                m[r] += (gu / 4) ** 2
                embed[r] -= rate * (gu / 4) / np.sqrt(m[r])
    _calibrate(model, [r for k, r in enumerate(rows) if k % 5 == 0])
    return model


def _calibrate(model: Model, rows: list[tuple[str, int]]) -> None:
    """Thresholds on the logit with the best balanced accuracy: for all rows, and for languages with enough of them."""
    words = Vocabulary(model)
    docs = [tokens(t) for t, _ in rows]
    z = np.array([model.logit(words.pooled(i)) for i in words.numbers(docs)])
    y = np.array([y for _, y in rows])
    lang = np.array([guess_language(d) for d in docs])

    def best(z: np.ndarray, y: np.ndarray) -> float:
        cuts = np.unique(z)
        cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
        value = [((z[y == 1] >= c).mean() + (z[y == 0] < c).mean()) for c in cuts]
        top = [c for c, v in zip(cuts, value, strict=True) if v == max(value)]
        return float(np.median(top)) if len(top) % 2 else float(top[len(top) // 2])

    both = lambda m: min((y[m] == 1).sum(), (y[m] == 0).sum()) if m.any() else 0
    every = best(z, y) if both(np.ones(len(y), bool)) >= LEAST_FOR_THRESHOLD else 0.0
    model.thresholds = {k: best(z[lang == k], y[lang == k]) if both(lang == k) >= LEAST_FOR_THRESHOLD else every for k in LANGUAGES}


def scores(model: Model, docs: list[list[str]], words: Vocabulary) -> list[float]:
    if model.constant is not None:
        return [model.constant] * len(docs)
    out = []
    for d, ids in zip(docs, words.numbers(docs), strict=True):
        z = model.logit(words.pooled(ids)) - model.thresholds[guess_language(d)]
        out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
    return out


_vocabulary: list[Vocabulary] = []


def vocabulary(model: Model) -> Vocabulary:
    """This worker's vocabulary; that of another model gives way to it."""
    if not _vocabulary or _vocabulary[0].model.key != model.key:
        _vocabulary[:] = [Vocabulary(model)]
    return _vocabulary[0]


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """df with the double `name`, 0 to 1; 0.5 is the threshold of the text's language."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(model)
        for batch in batches:
            out: list[float] = []
            for k in range(0, len(batch), TEXTS):
                out += scores(model, [tokens(t) for t in batch.slice(k, TEXTS).to_pylist()], words)
            yield pa.array(out, pa.float64())

    return df.withColumn(name, scored(F.col(text)))


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    return train(sample(documents, labels, "toxic"))


def op1_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    scored = score(documents.select("doc_id", "text"), fitted(documents, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier, fitted on this stage's documents, does not find toxic."""
    name = "_toxicity"
    return score(docs, fitted(docs, table(spark, sf_dir, "labels")), name=name).filter(F.col(name) < 0.5).drop(name)
