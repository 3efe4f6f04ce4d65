"""Quality classification by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the documents labelled good; the unlabelled set is all web text that may be learned from, whatever its
labels. A logistic model over format and character features minimises pi*R+(positives) + max(0, R-(unlabelled) -
pi*R-(positives)) by Newton steps, each a pass over all unlabelled rows whose sums are aggregated; where the estimated
negative risk falls below zero, the step goes back along that risk. The class prior pi is estimated from positives and
unlabelled rows alone: a first model tells positives from unlabelled rows, and the prior is the share of unlabelled over the
share of (other) positives above the score where that ratio has the lowest upper confidence bound. A last one-dimensional
logistic fit over the labelled sample turns the margin into a probability of label 1.

Bound: at most ``labelled`` labelled documents are read, those of the least hashes of their ids, a million numbers at most
on the driver. Everything else covers all rows; every document is scored over its whole text.

Edge cases: null and empty texts have the features of an empty text and a finite score; with no usable positives or no
unlabelled rows every score is 0.5; labels of unknown documents and null labels are left out; a document with several labels
counts once, by the smallest; an id with several texts counts once as a labelled document; repeated rows get equal scores;
further columns are kept, a column named score is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, pieces, remainder, scratch, table

_KINDS = 14


def _kind_table() -> np.ndarray:
    kind = np.full(256, 13, np.uint8)
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "'\"()-", "#$%&*", "|", "/\\@=+<>[]{}_~^`")):
        kind[np.frombuffer(chars.encode(), np.uint8)] = i
    kind[128:] = 12
    return kind


KIND = _kind_table()
N_FEATURES = _KINDS + _KINDS * _KINDS + 8


def features(text: str | None) -> np.ndarray:
    """Shares of character kinds and of their successions, and eight measures of form, over the whole text."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float32)
    if raw:
        k = KIND[np.frombuffer(raw, np.uint8)]
        one = np.bincount(k, minlength=_KINDS)
        two = np.bincount(k[:-1].astype(np.int32) * _KINDS + k[1:], minlength=_KINDS * _KINDS)
        out[:_KINDS] = np.sqrt(one / len(k))
        out[_KINDS : _KINDS + _KINDS * _KINDS] = np.sqrt(two / len(k))
    words = raw.split()
    lines = raw.split(b"\n")
    n = max(1, len(words))
    out[-8:] = (
        np.log1p(len(raw)) / 10,
        np.log1p(len(words)) / 10,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        min(20, len(raw) / n) / 20,
        len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2),
        np.log1p(len(raw) / len(lines)) / 10,
        len(zlib.compress(raw, 1)) / len(raw) if raw else 0,
    )
    return out


class PuModel:
    def __init__(self, mean, scale, w, b, slope, shift, prior=None):
        self.mean, self.scale, self.w, self.b, self.slope, self.shift, self.prior = mean, scale, w, b, slope, shift, prior

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def unlabelled_terms(theta: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over rows x (a last column of ones included) of the loss of calling them negative, its gradient and its Hessian."""
    z = x @ theta
    q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return float(np.logaddexp(0, z).sum()), x.T @ q, (x * (q * (1 - q))[:, None]).T @ x


def newton_step(theta: np.ndarray, terms: tuple[float, np.ndarray, np.ndarray], n: float, pos: np.ndarray, prior: float, decay: float, signed: bool = True) -> np.ndarray:
    """What to add to theta, from the sums over n unlabelled rows and the positive rows ``pos``.

    With ``signed``, the non-negative risk; without, the plain logistic loss of positives, weighing ``prior``, against unlabelled rows.
    """
    loss, grad, hess = terms[0] / n, terms[1] / n, terms[2] / n
    z = pos @ theta
    q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    ridge = np.eye(len(theta))
    if not signed:
        curve = prior * (pos * (q * (1 - q))[:, None]).T @ pos / len(pos)
        step = -np.linalg.solve((1 - prior) * hess + curve + decay * ridge, (1 - prior) * grad - prior * (pos * (1 - q)[:, None]).mean(0) + decay * theta)
    elif loss - prior * np.logaddexp(0, z).mean() >= 0:
        step = -np.linalg.solve(hess + decay * ridge, grad - prior * pos.mean(0) + decay * theta)
    else:  # the negative risk is below zero: up along it
        step = 0.5 * np.linalg.solve(hess + decay * ridge, grad - prior * (pos * q[:, None]).mean(0))
    return step * min(1.0, 4.0 / max(1e-12, float(np.linalg.norm(step))))


def class_prior(pos: np.ndarray, above: np.ndarray, n: float, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled rows: ``pos`` positives' scores from high to low, ``above`` how many of n
    unlabelled rows score at least as much as each."""
    share_p = np.arange(1, len(pos) + 1) / len(pos)
    share_u = above / n
    width = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * len(pos)))
    best = int(np.argmin((share_u + (1 + slack) * width) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def calibrate(model: PuModel, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> None:
    """Platt's fit of P(label 1) on labelled rows, by Newton steps with smoothed targets."""
    if not len(y) or y.min() == y.max():
        return
    z = model.margin(x)
    z_mean, z_scale = z.mean(), z.std() + 1e-6
    d = np.c_[(z - z_mean) / z_scale, np.ones(len(z))]
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.zeros(2)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(d @ ab, -30, 30)))
        ab -= np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d + 1e-3 * np.eye(2), d.T @ (q - target) + 1e-3 * ab)
    model.slope, model.shift = max(ab[0], 1e-6) / z_scale, ab[1] - max(ab[0], 1e-6) * z_mean / z_scale


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def featured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``features`` in the place of its text."""
    kept = [c for c in df.columns if c not in (text, "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [features(t).tobytes() for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.binary())], names=[*kept, "features"])

    return df.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(run, T.StructType([df.schema[c] for c in kept] + [T.StructField("features", T.BinaryType())]))


def _sums(rows: DataFrame, each: Callable[[np.ndarray, list[bytes]], np.ndarray]) -> np.ndarray | None:
    """The sum of ``each(matrix, raw rows)``, a flat array, over all rows: one row a task and place, added up by place. None: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in pieces(batches, 2048):
            own = each(_matrix(b.column(0)), b.column(0).to_pylist())
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    found = rows.select("features").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([v for _, v in sorted((r["i"], r["v"]) for r in found)]) if found else None


def fit_features(rows: DataFrame, labels: DataFrame, learn: Column, labelled: int = 4000, passes: int = 10, first_passes: int = 4, decay: float = 1e-3) -> PuModel | None:
    """rows: doc_id, features; labels: doc_id, quality. Only rows and labels where ``learn`` holds are read."""
    lab = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    own = rows.where(learn)
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # at most ``labelled`` rows of two numbers: they may be broadcast
    known = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features")).collect()
    known.sort(key=lambda r: bytes(r["features"]))
    y = np.array([r["quality"] for r in known])
    moments = _sums(own, lambda x, raw: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if moments is None or not (y == 1).any():
        return None
    n = moments[0]
    mean = moments[1 : N_FEATURES + 1] / n
    scale = np.sqrt(np.maximum(0, moments[N_FEATURES + 1 :] / n - mean**2)) + 1e-3
    x_known = np.frombuffer(b"".join(bytes(r["features"]) for r in known), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    with_one = lambda x: np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))]
    pos = with_one(x_known[y == 1])
    even = np.arange(len(pos)) % 3 != 0 if len(pos) > 2 else np.ones(len(pos), bool)
    fold = lambda raw: np.fromiter((zlib.crc32(r) & 1 for r in raw), bool, len(raw))

    def terms(theta: np.ndarray, half: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
        def each(x: np.ndarray, raw: list[bytes]) -> np.ndarray:
            x = with_one(x[~fold(raw)] if half else x)
            loss, grad, hess = unlabelled_terms(theta, x)
            return np.concatenate([[len(x), loss], grad, hess.ravel()])

        out = _sums(own, each)
        k = len(theta)
        return float(out[1]), out[2 : k + 2], out[k + 2 :].reshape(k, k), max(1.0, float(out[0]))

    # positives against unlabelled rows of one half; the prior from the others
    theta = np.zeros(N_FEATURES + 1)
    for _ in range(first_passes):
        *sums, m = terms(theta, True)
        theta = theta + newton_step(theta, tuple(sums), m, pos[even], 0.5, 1e-2, signed=False)
    held = np.sort((pos[~even] if (~even).any() else pos) @ theta)
    above = _sums(own, lambda x, raw: _above(with_one(x[fold(raw)]) @ theta, held))
    prior = class_prior(held[::-1], above[:-1], max(1.0, above[-1]))

    theta = np.zeros(N_FEATURES + 1)
    for _ in range(passes):
        *sums, m = terms(theta, False)
        step = newton_step(theta, tuple(sums), m, pos, prior, decay)
        theta = theta + step
        if np.linalg.norm(step) < 1e-3:
            break
    model = PuModel(mean, scale, theta[:-1], theta[-1], 1.0, 0.0, prior)
    calibrate(model, x_known, y)
    return model


def _above(z: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How many of z are at least as great as each of ``held`` (sorted from low to high), from the greatest on, and how many there are."""
    at_least = len(z) - np.searchsorted(np.sort(z), held[::-1], side="left")
    return np.append(at_least, len(z)).astype(float)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, labelled: int = 4000) -> PuModel | None:
    """docs: doc_id, text; labels: doc_id, quality."""
    with scratch(docs.sparkSession):
        return fit_features(materialise(featured(docs.select("doc_id", "text")), "features"), labels, learn, labelled)


def score_features(df: DataFrame, model: PuModel | None) -> DataFrame:
    """``df`` without its features and with ``score`` in 0 to 1."""
    own = df.sparkSession.sparkContext.broadcast(model)  # a few kB whatever the input
    kept = [c for c in df.columns if c not in ("features", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = own.value
        for b in pieces(batches, 2048):
            s = np.full(b.num_rows, 0.5) if model is None else model.score(_matrix(b.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*kept, "score"])

    return df.select(*[F.col(f"`{c}`") for c in [*kept, "features"]]).mapInArrow(run, T.StructType([df.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())]))


def score(df: DataFrame, model: PuModel | None, text: str = "text") -> DataFrame:
    """``df`` without its text and with ``score`` in 0 to 1."""
    return score_features(featured(df.drop("score"), text), model)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    learn = remainder(F.col("doc_id"), 4) != 2
    with scratch(spark):
        rows = materialise(featured(docs), "features")
        scored = score_features(rows.withColumn("held_out", ~learn), fit_features(rows, labels, learn))
        return materialise(scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0)), "scored", result=True)
