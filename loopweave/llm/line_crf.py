"""Operator 2: document quality from a linear-chain conditional random field over lines, trained here in numpy.

Every line is labelled good or bad. A line's features are ratios of its characters and words, whether it or its word
windows came before in the document, and the ratios of the lines before and after it; the chain adds a potential for
each pair of labels. Forward and backward sums give each line's marginal, and the marginals, weighted by the lines'
lengths, give the document's quality, which a logistic curve on the sample turns into the score.

Only documents are labelled: for training each line has its document's label. Scoring is a map over the scan with
the model in the closure, in which only texts go through Python; documents are taken by the hundred and their lines in
padded arrays, a long document's in one of its own.

Defined results
* null or empty text, or white space alone: no line; the score of a document whose marginals are even;
* no labelled rows of one class in the sample: every score is the share of class 1 in the sample (0 without labels);
* a line that comes again counts as repeated from its second place on; very long texts are labelled whole;
* repeated rows, and rows with one or no doc_id, each give their own result; an empty table gives an empty result;
* extra columns are kept by `score`, which replaces those named like its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .training import sample

#: Words of the windows whose repetition is a feature.
WINDOW = 4
STEPS, RATE, DECAY = 80, 0.15, 1e-3
PREDICT = 0.3
#: Lines of a batch of documents that go through the chain together, when padded.
CELLS = 1 << 15
#: Texts of a batch that are taken together.
TEXTS = 128
SYMBOLS = re.compile(r"[#*$%&|<>=~^@{}\[\]\\_+]")
UPPER, DIGIT, LOUD = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[!?]")
OWN = 10
N = 3 * OWN + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Own features of each line that has a word, (lines, OWN), and the lines' lengths in characters."""
    rows, lengths = [], []
    lines_seen: set[str] = set()
    windows_seen: set[tuple] = set()
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        chars = len(line)
        grams = set(zip(words, words[1:], words[2:], words[3:], strict=False))
        n_grams = n - WINDOW + 1
        again = (n_grams - len(grams - windows_seen)) / n_grams if n_grams > 0 else 0.0
        windows_seen |= grams
        rows.append(
            (
                min(len(SYMBOLS.findall(line)) / n, 2.0),
                min(2.0 * len(UPPER.findall(line)) / chars, 1.0) if chars else 0.0,
                min(len(LOUD.findall(line)) / n, 1.0),
                min(2.0 * len(DIGIT.findall(line)) / chars, 1.0),
                min(chars / n, 20.0) / 10.0,
                min(n, 100) / 50.0,
                float(line in lines_seen),
                again,
                sum(map(str.__eq__, words, words[1:])) / n,
                1.0 - len(set(words)) / n,
            )
        )
        lines_seen.add(line)
        lengths.append(chars)
    return np.array(rows, np.float32).reshape(-1, OWN), np.array(lengths, np.float32)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of lines: their own, those of the line before and of the line after (zero at the ends), and 1."""
    edge = np.zeros((1, OWN), np.float32)
    if not len(own):
        return np.zeros((0, N), np.float32)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1), np.float32)])


@dataclass
class Model:
    weights: np.ndarray  # (N,): how much a feature speaks for label 1 against label 0
    pairs: np.ndarray  # (2, 2): potential of a label and its successor
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, docs))
    x, mask = np.zeros((len(docs), longest, N), np.float32), np.zeros((len(docs), longest), bool)
    for k, d in enumerate(docs):
        x[k, : len(d)], mask[k, : len(d)] = d, True
    return x, mask


def _lse(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=-1)
    return m + np.log(np.exp(a - m[..., None]).sum(axis=-1))


def forward_backward(model: Model, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 (docs, lines), expected counts of the label pairs (docs, 2, 2), and log partition sums (docs)."""
    n, t, _ = x.shape
    unary = np.zeros((n, t, 2))
    unary[:, :, 1] = x @ model.weights
    ahead, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    ahead[:, 0] = unary[:, 0]
    for k in range(1, t):
        step = unary[:, k] + _lse(ahead[:, k - 1, None, :] + model.pairs.T[None])
        ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
    for k in range(t - 2, -1, -1):
        step = _lse((back[:, k + 1] + unary[:, k + 1])[:, None, :] + model.pairs[None])
        back[:, k] = np.where(mask[:, k + 1, None], step, 0)
    z = _lse(ahead[:, -1])
    both = ahead + back
    marginal = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -50, 50)))
    expected = np.zeros((n, 2, 2))
    if t > 1:
        joint = ahead[:, :-1, :, None] + model.pairs + (unary[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * mask[:, 1:, None, None]).sum(axis=1)
    return marginal, expected, z


def _batches(features: list[np.ndarray]) -> Iterator[list[int]]:
    """Documents with lines, in batches of at most CELLS cells when padded (or one document)."""
    order = sorted((k for k in range(len(features)) if len(features[k])), key=lambda k: -len(features[k]))
    while order:
        n = max(1, CELLS // len(features[order[0]]))
        yield order[:n]
        order = order[n:]


def quality(model: Model, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Length-weighted mean marginal of label 1 of each document (0.5 without lines), and its lines' marginals."""
    features = [with_neighbours(own) for own, _ in docs]
    mean, lines = np.full(len(docs), 0.5), [np.zeros(0)] * len(docs)
    for batch in _batches(features):
        marginal, _, _ = forward_backward(model, *_padded([features[k] for k in batch]))
        for row, k in enumerate(batch):
            lines[k] = marginal[row, : len(features[k])]
            mean[k] = np.average(lines[k], weights=docs[k][1])
    return mean, lines


def objective(model: Model, x: np.ndarray, mask: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood of documents whose lines all have the label y, each weighted by its share over its
    number of lines, and its gradient by the N weights and the four pairs."""
    marginal, expected, z = forward_backward(model, x, mask)
    n = mask.sum(axis=1)
    weight = share / n
    steps = (n - 1) * weight
    loss = (weight * (z - y * (x @ model.weights * mask).sum(axis=1))).sum() - (steps * model.pairs[y, y]).sum()
    seen = np.diag([(steps * (y == 0)).sum(), (steps * (y == 1)).sum()])
    pairs = np.einsum("d,dij->ij", weight, expected) - seen
    return float(loss), np.concatenate([np.einsum("nt,ntf->f", (marginal - y[:, None]) * mask * weight[:, None], x), pairs.ravel()])


def train(rows: list[tuple[str, int]]) -> Model:
    """Conditional maximum likelihood by Adam, documents of both classes in balance, lines of a document in mean."""
    model = Model(np.zeros(N), np.zeros((2, 2)))
    y = np.array([label for _, label in rows])
    if len(set(y.tolist())) < 2:
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    docs = [line_features(t) for t, _ in rows]
    features = [with_neighbours(own) for own, _ in docs]
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    prepared = [(*_padded([features[k] for k in batch]), y[batch], share[batch]) for batch in _batches(features)]
    momentum, scale = np.zeros(N + 4), np.zeros(N + 4)
    for step in range(1, STEPS + 1):
        grad = DECAY * np.concatenate([model.weights, model.pairs.ravel()])
        for part in prepared:
            grad = grad + objective(model, *part)[1]
        momentum = 0.9 * momentum + 0.1 * grad
        scale = 0.99 * scale + 0.01 * grad * grad
        move = RATE * (momentum / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
        model.weights = model.weights - move[:N]
        model.pairs = np.clip(model.pairs - move[N:].reshape(2, 2), -2, 2)
    mean, _ = quality(model, docs)
    _curve(model, mean, y, share)
    return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(model: Model, mean: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
    """Slope and shift of the logistic curve from mean marginals to scores, by gradient descent."""
    x, a, b = _logit(mean), 1.0, 0.0
    for _ in range(500):
        g = share * (1 / (1 + np.exp(-np.clip(a * x + b, -40, 40))) - y)
        a, b = max(a - 0.5 * float(g @ x), 0.05), b - 0.5 * float(g.sum())
    model.slope, model.shift = a, b


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    mean, _ = quality(model, [line_features(t) for t in texts])
    return 1 / (1 + np.exp(-np.clip(model.slope * _logit(mean) + model.shift, -40, 40)))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with the double `score`, 0 (bad) to 1 (good)."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [scores(model, batch.slice(k, TEXTS).to_pylist()) for k in range(0, len(batch), TEXTS)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return df.withColumn("score", scored(F.col(text)))


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    return train(sample(documents, labels, "quality"))


def op2_quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    scored = score(documents.select("doc_id", "text"), fitted(documents, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
