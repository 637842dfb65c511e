"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good, unlabelled data are rows without a label. A linear
model over hashed byte trigrams and text statistics minimises the non-negative unbiased risk (the negative part is
clipped at zero) on a bounded sample. What the risk takes from the corpus, the class prior and the scale of every
feature, is measured on all documents: the prior from the best bin of first scorers, each on documents it was not
trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U64, _SPACE, batch_of, distinct, prefix_hash, row_index, slices, span_hash, word_spans
from ._sampling import first_by_hash, held_out, labelled

#: Default bounds of the sample that the risk is minimised on, in documents.
MAX_POSITIVE, MAX_UNLABELLED = 5000, 10000
BINS = 1024
STATS = 24
#: Rows whose features are computed at once.
ROWS = 1024
#: Steps of a score in the histogram that the prior is read from, and how many there are.
STEP, STEPS = 0.02, 2000

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A float32 row for each text: root shares of hashed byte trigrams, then statistics."""
    rows, n = len(offs) - 1, len(buf)
    size = np.maximum(np.diff(offs), 1)
    out = np.zeros((rows, BINS + STATS), np.float32)
    if n >= 3:
        b = buf.astype(np.uint32)
        b[_DIGIT[buf]] = 48
        code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(22)
        inside = np.ones(n - 2, bool)
        for c in offs[1:-1].tolist():
            inside[max(c - 2, 0) : c] = False
        row = np.repeat(np.arange(rows), np.diff(offs))[: n - 2]
        counts = np.bincount((row * BINS + code)[inside], minlength=rows * BINS).reshape(rows, BINS)
        out[:, :BINS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offs[1:]] - total[offs[:-1]]) / size

    starts, ends, at = word_spans(buf, offs)
    h, count = prefix_hash(buf), np.diff(at)
    words, many = span_hash(h, starts, ends), np.maximum(count, 1)
    row = row_index(at)

    def kinds(items: np.ndarray, rows_of: np.ndarray) -> np.ndarray:
        keys = distinct(rows_of.astype(U64) << U64(40) | items >> U64(24))
        return np.bincount((keys >> U64(40)).astype(np.int64), minlength=rows)

    breaks = distinct(np.concatenate([np.flatnonzero(buf == 10) + 1, offs[:-1]]))
    breaks = breaks[breaks < n]
    line_ends = np.append(breaks[1:], n)
    line_row = np.searchsorted(offs, breaks, "right") - 1
    lines = np.maximum(np.bincount(line_row, minlength=rows), 1)
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (row[1:] == row[:-1])])
    stats = [
        share(_UPPER[buf]), share(_DIGIT[buf]), share(_MARK[buf]), share(_SPACE[buf]), share(buf >= 128),
        np.log1p(count) / 8, np.bincount(row, ends - starts, rows) / many / 10, kinds(words, row) / many,
        kinds(span_hash(h, breaks, line_ends), line_row) / lines, np.minimum(lines / many, 1),
        np.bincount(row, again, rows) / many, np.bincount(row, _MARK[buf[ends - 1]], rows) / many if len(ends) else np.zeros(rows),
    ]
    flat = np.stack(stats, 1)
    out[:, BINS:] = np.concatenate([flat, np.sqrt(flat)], 1)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from counts of both by rising score: the least ratio of the two
    groups' shares above a threshold, with confidence margins (best bin estimation)."""
    n_p, n_u = max(positive.sum(), 1), max(unlabelled.sum(), 1)
    up, uu = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    margin = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    ok = up > 0.01
    if not ok.any():
        return 0.5
    best = np.argmin((uu[ok] + margin) / up[ok])
    return float(np.clip(uu[ok][best] / up[ok][best], 0.05, 0.98))


def histogram(z: np.ndarray) -> np.ndarray:
    """Counts of scores by steps; the first and the last hold what lies beyond."""
    return np.bincount(np.clip(z / STEP + STEPS // 2, 0, STEPS - 1).astype(np.int64), minlength=STEPS)


def _adam(x, unlabelled, rule, epochs: int, seed: int, decay: float = 1e-4):
    """Minimise a risk of scores of (positive, unlabelled) batches; rule gives their gradients. The weights of the last third
    of the steps are averaged, which evens out the steps that keep the risk from falling below zero."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1] + 1)
    a, b, step, mean, averaged = np.zeros_like(w), np.zeros_like(w), 0, np.zeros_like(w), 0
    for epoch in range(epochs):
        parts = max(1, (len(x) + len(unlabelled)) // 512)
        for ip, iu in zip(np.array_split(rng.permutation(len(x)), parts), np.array_split(rng.permutation(len(unlabelled)), parts)):
            if not len(ip) or not len(iu):
                continue
            xp, xu = x[ip], unlabelled[iu]
            gp, gu = rule(xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1])
            g = np.append(gp @ xp + gu @ xu + decay * w[:-1], gp.sum() + gu.sum())
            step += 1
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            late = epoch >= epochs * 2 // 3
            w -= (0.004 if late else 0.02) * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            if late:
                averaged += 1
                mean += (w - mean) / averaged
    return mean if averaged else w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scales(total: np.ndarray, squares: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of every feature from its sum and sum of squares; the many trigram shares weigh less than the statistics."""
    mean = total / max(n, 1)
    scale = np.maximum(np.sqrt(np.maximum(squares / max(n, 1) - mean**2, 0)), 1e-3)
    scale[:BINS] *= 3
    return mean, scale


def first_scorers(positive: np.ndarray, unlabelled: np.ndarray, half_p: np.ndarray, half_u: np.ndarray, seed: int = 11, epochs: int = 20) -> list[Model]:
    """For each half of the sample a plain logistic model of positives against unlabelled texts."""
    sums = [sum(f(x) for x in (positive, unlabelled)) for f in (lambda x: x.sum(0, dtype=np.float64), lambda x: np.einsum("ij,ij->j", x, x, dtype=np.float64))]
    mean, scale = scales(*sums, len(positive) + len(unlabelled))

    def apart(zp, zu):
        return -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)

    out = []
    for half in (0, 1):
        w = _adam((positive[half_p == half] - mean) / scale, (unlabelled[half_u == half] - mean) / scale, apart, epochs, seed, 1e-2)
        out.append(Model(w[:-1], float(w[-1]), mean, scale, 0.5))
    return out


def train(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float, seed: int = 11, epochs: int = 30) -> Model:
    """Minimise the non-negative risk of feature rows of positives and unlabelled texts."""

    def risk(zp, zu):  # logistic loss; the negative part of the risk is kept from falling below zero
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dp, du = _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if negative >= 0:
            return prior * (-_sigmoid(-zp) / len(zp) - dp), du
        return prior * dp, -du

    w = _adam((positive - mean) / scale, (unlabelled - mean) / scale, risk, epochs, seed, 1e-3)
    return Model(w[:-1], float(w[-1]), mean, scale, prior)


def flat_model() -> Model:
    """Without positives or unlabelled texts every score is 0.5."""
    width = BINS + STATS
    return Model(np.zeros(width), 0.0, np.zeros(width), np.ones(width), 0.5)


def _parts(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features) of a slice, some rows at a time."""
    for i in range(0, len(offs) - 1, ROWS):
        cut = offs[i : i + ROWS + 1]
        yield i, features(buf[cut[0] : cut[-1]], cut - cut[0])


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, part, half, x): features as bytes of half floats."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("part", pa.int32()), ("half", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, offs in slices(batch.column(4)):
                for i, x in _parts(buf, offs):
                    yield batch_of(schema, *(batch.column(c).slice(a + i, len(x)) for c in range(4)), [r.tobytes() for r in x.astype(np.float16)])

    return docs.select("doc_id", "tie", "part", "half", "text").mapInArrow(run, "doc_id long, tie long, part int, half int, x binary")


def _measured(docs: DataFrame, scorers: list[Model]) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Over all of (half, text): the sums and squares of every feature, histograms of each half's scores by the other
    half's scorer, and the number of rows. One row a feature and a step reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(scorers)  # two weights vectors
    width = BINS + STATS
    schema = pa.schema([("kind", pa.int32()), ("k", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((2, width)), np.zeros((2, STEPS))
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1)):
                half = batch.column(0).slice(a, b - a).to_numpy()
                for i, x in _parts(buf, offs):
                    sums += x.sum(0, dtype=np.float64), np.square(x).sum(0, dtype=np.float64)
                    own = half[i : i + len(x)]
                    for h in (0, 1):
                        if (own == h).any():
                            counts[h] += histogram(shared.value[1 - h].raw(x[own == h]))
        whole = [*sums, *counts]
        yield batch_of(schema, np.repeat(np.arange(4, dtype=np.int32), [len(w) for w in whole]), np.concatenate([np.arange(len(w), dtype=np.int32) for w in whole]), np.concatenate(whole))

    got = docs.select("half", "text").mapInArrow(run, "kind int, k int, v double").groupBy("kind", "k").agg(F.sum("v").alias("v")).toArrow()
    shared.destroy()
    kind, k, v = (got[c].to_numpy() for c in ("kind", "k", "v"))
    out = [np.zeros(n) for n in (width, width, STEPS, STEPS)]
    for i in range(4):
        out[i][k[kind == i]] = v[kind == i]
    return np.stack(out[:2]), out[2:], float(sum(c.sum() for c in out[2:]))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Minimise the risk on at most ``max_positive`` good labelled rows and ``max_unlabelled`` documents without a label, none held out;
    the prior and the features' scales come from all documents that are not held out.

    Rows without an id are not learned from; null texts count as empty; several rows of an id all count.
    """
    doc_id = docs["doc_id"].cast("long")
    texts = docs.select(doc_id.alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = texts.withColumn("half", (F.xxhash64("doc_id", F.lit(1)) % 2 != 0).cast("int"))
    good = labelled(docs, labels, "quality").where("y = 1").select("doc_id")
    without = texts.select("doc_id").distinct().join(labels.select(labels["doc_id"].cast("long").alias("doc_id")), "doc_id", "left_anti")
    sample = first_by_hash(good, max_positive).withColumn("part", F.lit(1)).union(first_by_hash(without, max_unlabelled).withColumn("part", F.lit(0)))
    # the ids are bounded by the sample's parameters, so that side may be broadcast
    got = _featured(texts.join(F.broadcast(sample), "doc_id").withColumn("tie", F.xxhash64("text"))).toArrow().sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, BINS + STATS).astype(np.float32)
    part, half = got["part"].to_numpy(), got["half"].to_numpy()
    positive, unlabelled = x[part == 1], x[part == 0]
    if not len(positive) or not len(unlabelled):
        return flat_model()
    scorers = first_scorers(positive, unlabelled, half[part == 1], half[part == 0])
    (total, squares), counts, n = _measured(texts, scorers)
    # each half's positives and documents are judged by the other half's scorer
    seen = [histogram(scorers[1 - h].raw(positive[half[part == 1] == h])) for h in (0, 1)]
    prior = float(np.mean([estimate_prior(seen[h], counts[h]) for h in (0, 1)]))
    return train(positive, unlabelled, *scales(total, squares, n), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null counts as the empty text, which is scored by its statistics. Repeated rows
    repeat, an empty table gives no rows; only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, offs in slices(batch.column(1)):
                for i, x in _parts(buf, offs):
                    yield batch_of(schema, batch.column(0).slice(a + i, len(x)), model.score(x))

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
