"""Language identification with a byte convolutional network trained in numpy.

One-hot bytes go through filters of several widths (a filter of width w is w tables of 256 x filters), ReLU, max pooling
over a fixed-length window and a softmax. Training takes a bounded, language-stratified sample of labelled texts (at most
``per_lang`` documents a language and ``windows`` windows a document, both parameters) and follows Adam; max pooling
passes gradients only to the winning positions. Prediction covers each whole text: all its windows go through the network
in fixed-size batches, and the window probabilities are averaged.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no labelled text at all everything is
``und``; languages are learned from non-null labels only; repeated rows are predicted alike; ties go to the first
language in order; an empty table gives an empty table; further columns are left out of the model and the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import handing_back, pieces, remainder, table

WINDOW = 256
UND = "und"


@dataclass
class ByteCnn:
    """Tables of shape (width, 256, filters) for each width, and the softmax layer."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(langs: list[str], widths=(2, 3, 4), filters: int = 16, seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in widths]
        bias = [np.zeros(filters, np.float32) for _ in widths]
        return ByteCnn(langs, tables, bias, rng.normal(0, 0.1, (len(widths) * filters, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def pooled(self, x: np.ndarray, winners: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """x: (windows, WINDOW) bytes. Pooled features, and for training the winning positions."""
        feats, won = [], []
        for tab, b in zip(self.tables, self.bias):
            w = len(tab)
            n = x.shape[1] - w + 1
            if w == 1 or winners:
                conv = sum(tab[j].take(x[:, j : j + n], axis=0) for j in range(w))
            else:  # tables for pairs of bytes: half the look-ups
                conv = None
                for j, pair in self._pairs(tab):
                    at = x[:, j : j + n] if pair.shape[0] == 256 else x[:, j : j + n].astype(np.int32) * 256 + x[:, j + 1 : j + 1 + n]
                    got = pair.take(at, axis=0)
                    conv = got if conv is None else np.add(conv, got, out=conv)
            if winners:
                at = conv.argmax(1)
                won.append(at)
                top = np.take_along_axis(conv, at[:, None], 1)[:, 0]
            else:
                top = conv.max(1)
            feats.append(np.maximum(top + b, 0))
        return np.concatenate(feats, 1), won

    def _pairs(self, tab: np.ndarray) -> list[tuple[int, np.ndarray]]:
        cache = self.__dict__.setdefault("_cache", {})
        if id(tab) not in cache:
            found, j = [], 0
            while j < len(tab):
                if j + 1 < len(tab):
                    found.append((j, (tab[j][:, None] + tab[j + 1][None]).reshape(65536, -1)))
                else:
                    found.append((j, tab[j]))
                j += 2
            cache[id(tab)] = found
        return cache[id(tab)]

    def probabilities(self, x: np.ndarray, block: int = 48) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)))
        for a in range(0, len(x), block):
            z = self.pooled(x[a : a + block])[0] @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[a : a + block] = z / z.sum(1, keepdims=True)
        return out


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text, side by side with an overlap of 4 bytes; the last one is moved back, a short text padded by 0."""
    if len(raw) <= WINDOW:
        return np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8)[None]
    starts = np.append(np.arange(0, len(raw) - WINDOW, WINDOW - 4), len(raw) - WINDOW)
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), WINDOW)[starts]


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on cross-entropy, classes weighted to count alike; x: (n, WINDOW) bytes, y: class numbers."""
    net = ByteCnn.fresh(langs, seed=seed)
    rng = np.random.default_rng(seed)
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(y) / np.maximum(1, np.bincount(y, minlength=len(langs))) / len(langs)
    step, k, f = 0, len(net.tables), net.tables[0].shape[2]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            at = order[a : a + batch]
            xb, yb = x[at], y[at]
            feats, won = net.pooled(xb, winners=True)
            z = feats @ net.out + net.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            p[np.arange(len(at)), yb] -= 1
            p *= (weight[yb] / len(at))[:, None]
            back = (p @ net.out.T) * (feats > 0)
            grads = [np.zeros_like(t) for t in net.tables]
            for i, g in enumerate(grads):
                own = back[:, i * f : (i + 1) * f]
                for j in range(len(g)):
                    np.add.at(g[j], (np.take_along_axis(xb, won[i] + j, 1), np.arange(f)[None].repeat(len(at), 0)), own)
            grads += [back[:, i * f : (i + 1) * f].sum(0) for i in range(k)] + [feats.T @ p, p.sum(0)]
            step += 1
            for q, g, mi, vi in zip(params, grads, m, v):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                q -= (rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.__dict__.pop("_cache", None)
    return net


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_lang: int = 800, windows: int = 3, rows: int = 200_000) -> ByteCnn | None:
    """A network from at most about ``per_lang`` labelled texts a language, picked by a hash of the text among rows where ``learn`` holds.

    The sample holds each text once and about ``rows`` texts at most: with many languages each has fewer, and all are learned.
    """
    own = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r["l"]: r["n"] for r in own.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    per_lang = min(per_lang, max(1, rows // len(langs)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    picked = own.where((F.pmod(F.xxhash64("t"), F.lit(1_000_003)) / 1_000_003.0) < share[F.col("l")]).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raw, label = [], []
            for t, lab in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if any(map(str.isalpha, t)):
                    all_of = windows_of(t.encode())
                    at = np.unique(np.linspace(0, len(all_of) - 1, windows).astype(int))
                    raw += [all_of[i].tobytes() for i in at]
                    label += [lab] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(label, pa.string())], names=["x", "l"])

    seen = picked.mapInArrow(handing_back(cut), "x binary, l string").collect()
    if not seen:
        return None
    seen.sort(key=lambda r: (r["l"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in seen), np.uint8).reshape(-1, WINDOW)
    place = {k: i for i, k in enumerate(langs)}
    return train(x, np.array([place[r["l"]] for r in seen]), langs)


def predict(df: DataFrame, net: ByteCnn | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the mean probability of that language over all windows)."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    model = spark.sparkContext.broadcast(net)  # some 100 kB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in pieces(batches):
            pred, score = [UND] * b.num_rows, np.zeros(b.num_rows)
            group: list[tuple[int, np.ndarray]] = []
            size = 0

            def flush():
                p = net.probabilities(np.concatenate([x for _, x in group]))
                ends = np.cumsum([len(x) for _, x in group])
                for (i, _), q in zip(group, np.split(p, ends[:-1])):
                    q = q.mean(0)
                    pred[i], score[i] = net.langs[int(q.argmax())], min(1.0, float(q.max()))

            for i, t in enumerate(b.column(kept.index(text)).to_pylist()):
                if net is None or not t or not any(map(str.isalpha, t)):
                    continue
                group.append((i, x := windows_of(t.encode())))
                size += len(x)
                if size > 4096:
                    flush()
                    group, size = [], 0
            if group:
                flush()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(handing_back(run), schema)


def learnable() -> Column:
    return remainder(F.col("doc_id"), 4) != 2


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs, learnable())
    return predict(docs.select("doc_id", "text", (~learnable()).alias("held_out")), net).drop("text")
