"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are labelled rows of quality 1; the unlabelled sample is web text of
unknown class, labels unseen.  A first classifier tells positives from unlabelled
texts, and the class prior is the least ratio, over its thresholds, of the unlabelled
to the positive share above (best-bin estimate, with a margin for small bins).  A
second one minimises

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

with the logistic loss, a network of one small hidden layer and full-batch Adam.
Features are twelve shape statistics of the text; nothing else enters a score.

The sample is bounded (`most_positive`, `most_unlabelled`), chosen by a hash of
doc_id; its features, not its texts, visit the driver.  Every row is then scored
where it lies, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.minhash import _BASE, _INVERSE, _MIX, PIECE_BYTES, _grouped, _pieces, _power, _word_hashes, mix64
from panelweave.llm.text import small_batches, text_or_empty

FEATURES = ("words", "symbols", "upper", "digits", "marks", "wide", "blank", "word_length", "distinct_words", "stutter",
            "repeated_shingles", "repeated_lines")
_SETS = {
    "symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": b"0123456789",
    "marks": b"!?.,;:\"'()-_=+/\\~^@[]{}`", "wide": bytes(range(128, 256)), "blank": b" \t\n\x0b\x0c\r"}
_TABLES = np.zeros((len(_SETS), 256), "u1")
for _row, _set in zip(_TABLES, _SETS.values()):
    _row[list(_set)] = 1


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    fresh = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])] if len(o) else np.zeros(0, bool)
    return np.bincount(o[fresh], minlength=n)


def _line_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every line that is not empty; bounds: starts of the texts and the end."""
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.r_[bounds[:-1], breaks + 1])
    start = start[start < bounds[-1]]
    end = np.minimum(np.r_[start[1:], bounds[-1]] - 1, bounds[-1])
    keep = end > start
    start, end = start[keep], end[keep]
    value = mix64((sums[end] - sums[start]) * _power(_INVERSE, len(data) + 1)[start] + (end - start).astype("u8"))
    return np.searchsorted(bounds, start, side="right") - 1, value


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if n == 1 and len(texts[0]) > PIECE_BYTES:
        pieces = list(_pieces(texts[0]))
        word = np.concatenate([_word_hashes(p)[0] for p in pieces])
        owner = np.zeros(len(word), "i8")
        counts = sum(_TABLES[:, np.frombuffer(p, "u1")].sum(axis=1, dtype="i8") for p in pieces)[:, None]
        lines = np.array([hash(line) for line in texts[0].split(b"\n") if line], "i8").view("u8")
        line_owner = np.zeros(len(lines), "i8")
    else:
        # a line end after each text keeps words and lines apart
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, "u1")
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        word, start = _word_hashes(joined)
        owner = np.searchsorted(bounds, start, side="right") - 1
        counts = np.stack([np.add.reduceat(table[data], bounds[:-1], dtype="i8") for table in _TABLES])
        counts[-1] -= 1
        line_owner, lines = _line_hashes(data, bounds)
    size = np.maximum(np.array([len(t) for t in texts]), 1)
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    out[:, 0] = np.log1p(words)
    out[:, 1:7] = (counts / size).T
    out[:, 7] = (size - counts[5]) / some
    out[:, 8] = _distinct(owner, word, n) / some
    out[:, 9] = np.bincount(owner[1:][(word[1:] == word[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / some
    if len(word) > 3:
        whole = owner[3:] == owner[:-3]
        shingle = mix64(word[:-3] * _MIX[0] + word[1:-2] * _MIX[1] + word[2:-1] * _MIX[2] + word[3:] * _MIX[3])[whole]
        at = owner[3:][whole]
        total = np.bincount(at, minlength=n)
        out[:, 10] = 1 - _distinct(at, shingle, n) / np.maximum(total, 1) * (total > 0) - (total == 0)
    total = np.bincount(line_owner, minlength=n)
    out[:, 11] = np.where(total > 0, 1 - _distinct(line_owner, lines, n) / np.maximum(total, 1), 0)
    # square roots spread small shares
    out[:, [1, 2, 3, 4, 5, 6, 9, 10, 11]] = np.sqrt(np.maximum(out[:, [1, 2, 3, 4, 5, 6, 9, 10, 11]], 0))
    return out


@dataclass(frozen=True)
class Model:
    """Scores rows of features."""

    mean: np.ndarray
    scale: np.ndarray
    parts: tuple
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_forward(self.parts, _scaled(x, self.mean, self.scale))[0]))


def _scaled(x, mean, scale):
    return np.clip((x - mean) / scale, -6, 6)


def _forward(parts, x):
    w, b, v, c = parts
    hidden = np.tanh(x @ w + b)
    return np.clip(hidden @ v + c, -30, 30), hidden


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int, epochs: int, rate: float = 0.02) -> tuple:
    """The non-negative risk with a prior; without one, positives against unlabelled."""
    rng = np.random.default_rng(7)
    parts = [rng.normal(0, 0.3, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in parts], [np.zeros_like(a) for a in parts]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, epochs + 1):
        fp, hp = _forward(parts, p)
        fu, hu = _forward(parts, u)
        if prior is None:
            dp, du = -sigmoid(-fp) / len(p), sigmoid(fu) / len(u)
        else:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            dp, du = -prior * sigmoid(fp) / len(p), sigmoid(fu) / len(u)
            if negative < 0:  # back out of the overfitted negative part
                dp, du = -dp, -du
            else:
                dp = dp - prior * sigmoid(-fp) / len(p)
        grads = [np.zeros_like(a) for a in parts]
        for x, h, d in ((p, hp, dp), (u, hu, du)):
            back = np.outer(d, parts[2]) * (1 - h * h)
            for g, more in zip(grads, (x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()]))):
                g += more
        for k, g in enumerate(grads):
            g = g + (1e-4 * parts[k] if k in (0, 2) else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            parts[k] = parts[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(parts)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Least ratio of unlabelled to positive share above a threshold, from held-back scores of the first classifier."""
    p, u = np.sort(p), np.sort(u)
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(2 / 0.1) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 12, epochs: int = 300) -> Model:
    """Half of either sample trains the first classifier, the other half estimates the prior; all train the second."""
    every = np.r_[positive, unlabelled]
    mean, scale = every.mean(0), every.std(0) + 1e-6
    p, u = _scaled(positive, mean, scale), _scaled(unlabelled, mean, scale)
    if len(p) >= 20 and len(u) >= 20:
        apart = _train(p[::2], u[::2], None, hidden, epochs // 2)
        prior = estimate_prior(_forward(apart, p[1::2])[0], _forward(apart, u[1::2])[0])
    else:
        prior = 0.5
    return Model(mean, scale, _train(p, u, prior, hidden, epochs), prior)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label is learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _featurise(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        rows = [features(g) for g in _grouped(texts)]
        values = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])


def _sampled(docs: DataFrame) -> np.ndarray:
    rows = docs.select("doc_id", "text").mapInArrow(_featurise, "doc_id long, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return np.array(rows["x"].tolist(), "f8").reshape(len(rows), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 8_000, most_unlabelled: int = 16_000) -> Model:
    """A model from the rows that are not held out.

    docs: doc_id, text; labels: doc_id, quality.  Without positives or texts every
    score is one half.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", text_or_empty().alias("text")).where(~held_out())
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").where(~held_out()).select("doc_id").distinct()
    share = lambda most, n: hashed < max(1, int(1_000_000 * min(1.0, most / max(n, 1))))
    trusted = trusted.where(share(most_positive, trusted.count()))
    positive = _sampled(docs.join(trusted, "doc_id"))
    unlabelled = _sampled(docs.where(share(most_unlabelled, docs.count())))
    if not len(positive) or not len(unlabelled):
        width = len(FEATURES)
        return Model(np.zeros(width), np.ones(width), (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(1)), 0.5)
    return fit(positive, unlabelled)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; a null text scores as the empty one, repeated rows alike."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [model.score(features(g)) for g in _grouped(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(rows) if rows else np.zeros(0))], names=["doc_id", "score"])
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
