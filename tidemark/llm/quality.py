"""Quality scores by positive-unlabelled learning with a non-negative risk (Kiryo et al., 2017).

Trusted positives and unlabelled web texts train a one-layer network on ``prior * E_p[l(g)] +
max(0, E_u[l(-g)] - prior * E_p[l(-g)])``; when the second term is negative, its gradient is taken
back instead. The class prior is estimated from the positives and the unlabelled texts alone (best bin
estimation; Garg et al., 2021): no row is ever used as a negative. Features are shares of bytes, words and
repetitions of the whole text; the text's source, language and id are no features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, Roller, U, mix, spread, text_buffer, words_of
from .tokens import lean, slices

N_FEATURES = 256 + 12


def distinct_share(keys: np.ndarray, row: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Distinct keys of each row over its number of keys (1 for none)."""
    both = mix(keys ^ (row.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    _, where = np.unique(both, return_index=True)
    return np.where(total > 0, np.bincount(row[where], minlength=n) / np.maximum(total, 1), 1.0)


def features(column: pa.Array, roller: Roller) -> np.ndarray:
    """A row of ``N_FEATURES`` per text."""
    n = len(column)
    data, at = text_buffer(column)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :256] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    words = words_of(column)
    w = roller.words(words.data, words.start, words.end)
    per = words.counts
    owner = np.repeat(np.arange(n), per)
    letters = counts[:, 65:91].sum(1) + counts[:, 97:123].sum(1)
    span = words.end - words.start
    # a line's hash is the sum of its words' hashes by place; empty lines do not count
    breaks = np.cumsum(data == 10)
    line = (breaks[words.start] if len(data) else np.empty(0, np.int64)) + owner
    _, where, inverse = np.unique(line, return_index=True, return_inverse=True)
    place = np.arange(len(w)) - where[inverse]
    sums = np.zeros(len(where), np.uint64)
    np.add.at(sums, inverse, mix(w + place.astype(np.uint64)))
    lines = np.bincount(owner[where], minlength=n)
    trow, tplace = spread(np.maximum(per - 2, 0))
    grams = roller.ngrams(w, 3)
    extra = [
        np.log1p(size) / 10,
        np.log1p(per) / 10,
        np.bincount(owner, span, n) / np.maximum(per, 1) / 10,
        np.sqrt(np.bincount(owner, span.astype(float) ** 2, n) / np.maximum(per, 1)) / 10,
        distinct_share(w, owner, n, per),
        distinct_share(grams[words.first[:-1][trow] + tplace], trow, n, np.maximum(per - 2, 0)),
        distinct_share(sums, owner[where], n, lines),
        counts[:, 65:91].sum(1) / np.maximum(letters, 1),
        letters / np.maximum(size, 1),
        counts[:, SPACE].sum(1) / np.maximum(size, 1),
        np.log1p(lines) / 5,
        lines / np.maximum(per, 1),
    ]
    out[:, 256:] = np.stack(extra, axis=1)
    return out


def _vectors(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("x", pa.binary())])
    roller = Roller(101)
    for batch in batches:
        for a, b in slices(batch.column(1)):
            x = features(batch.column(1).slice(a, b - a), roller)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)


class Model:
    """Standardised features, one hidden layer, a logistic score."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 1200, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3) -> Model:
    """Minimise the non-negative risk (sigmoid loss, Adam)."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean = both.mean(0)
    scale = both.std(0) + 0.02
    norm = lambda x: np.clip((x - mean) / scale, -6, 6)
    p, u = norm(positive), norm(unlabelled)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    average = [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), 2 * batch)]
        x = np.concatenate([xp, xu])
        a = np.tanh(x @ params[0] + params[1])
        g = a @ params[2] + params[3][0]
        d = np.concatenate(risk(g[:batch], g[batch:], prior)[1:])
        da = d[:, None] * params[2] * (1 - a * a)
        grads = [x.T @ da + decay * params[0], da.sum(0), a.T @ d + decay * params[2], np.array([d.sum()])]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            if step > steps // 2:
                average[i] += params[i] / (steps - steps // 2)
    model = Model(mean, scale, *average[:3], average[3][0])
    # the unlabelled scores should have the prior as their mean
    z, lo, hi = model.margin(unlabelled), -20.0, 20.0
    for _ in range(60):
        shift = (lo + hi) / 2
        lo, hi = (shift, hi) if sigmoid(z + shift).mean() < prior else (lo, shift)
    model.b2 = model.b2 + shift
    return model


def risk(g_positive: np.ndarray, g_unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of margins with the sigmoid loss, and the slopes that a step follows: the
    risk's own where its second term is not negative, else that term's with its sign turned."""
    sp, su = sigmoid(g_positive), sigmoid(g_unlabelled)
    second = su.mean() - prior * sp.mean()
    slope_p, slope_u = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    value = prior * (1 - sp).mean() + max(0.0, second)
    if second >= 0:
        return value, -2 * prior * slope_p, slope_u
    return value, prior * slope_p, -slope_u


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled. A model ranks held-back texts of both kinds; above a
    threshold that negatives do not reach, the share of unlabelled texts is the prior times the share of
    positives. The threshold is the one with the smallest upper confidence bound of their ratio."""
    rng = np.random.default_rng(seed)
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    held_p, held_u = p[: len(p) // 3], u[: len(u) // 3]
    if len(held_p) < 10 or len(held_u) < 10:
        return 0.5
    model = train(p[len(held_p) :], u[len(held_u) :], 0.5, steps=400)
    sp, su = np.sort(model.margin(held_p)), np.sort(model.margin(held_u))
    share = lambda sorted_scores, c: 1 - np.searchsorted(sorted_scores, c, "left") / len(sorted_scores)
    cuts = np.unique(sp)
    above_p, above_u = share(sp, cuts), share(su, cuts)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _picked(frame: DataFrame, most: int, total: int, what: str) -> DataFrame:
    share = min(1.0, 1.2 * most / max(total, 1))
    return frame.where(F.pmod(F.xxhash64("doc_id", F.lit(what)), F.lit(1_000_003)) < share * 1_000_003)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 4000, unlabelled: int = 8000, prior: float | None = None) -> Model | None:
    """Train on at most some ``positives`` trusted rows and ``unlabelled`` texts, picked by a hash of
    their ids, and on whole texts. Only labels of 1 are used. Without a positive or a text there is no
    model."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("mark")).where("mark is not null and doc_id is not null")
    good = marks.where("mark = 1").count()
    if not good:
        return None
    trusted = _picked(marks.where("mark = 1").select("doc_id").distinct(), positives, good, "positive")
    sure = source.join(F.broadcast(trusted), "doc_id").withColumn("kind", F.lit(1))
    loose = _picked(source, unlabelled, source.count(), "unlabelled").withColumn("kind", F.lit(0))
    rows = sure.union(loose).mapInArrow(lean(_vectors), "doc_id long, kind int, x binary").collect()
    rows.sort(key=lambda r: (r["kind"], r["doc_id"]))
    x = {k: np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["kind"] == k], np.float32).reshape(-1, N_FEATURES) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return None
    if prior is None:
        prior = estimate_prior(x[1], x[0])
    return train(x[1], x[0], prior)


def _score(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        roller = Roller(101)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                x = features(batch.column(1).slice(a, b - a), roller)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(x))], schema=schema)

    return lean(run)


def quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per document, 0 to 1. Null texts score as empty ones; without a model every
    score is 0.5; equal texts have equal scores; other columns are ignored."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(0.5).alias("score"))
    return source.mapInArrow(_score(model), "doc_id long, score double")
