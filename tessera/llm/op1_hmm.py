"""Hidden Markov language model: Baum-Welch over all training texts, exact sequence likelihood by the scaled forward recursion.

Tokens are words with A-Z lower-cased, then one end. The commonest training tokens are classes of their own; every other word
falls into one of the rare classes by a checksum of its last three bytes. The number of both grows with the training tokens:
``per_root`` times their cube root, and a thirtieth of that, so what is learned of words grows with the corpus while the
tables of states stay in memory (some 300 MB for 10**13 tokens). A hidden state emits a class, and a class its word with
probability (c + 0.1) / (C + 0.1 * (V + 1)) over the class's training words (one for frequent tokens; a word never seen has
c = 0). Word counts stay a distributed table, and the model is a proper distribution over texts of known and unknown words.

Word counts, vocabulary and Baum-Welch counts cover all training rows; each pass sums expected counts within a task, then
across tasks in blocks of classes. Before ``passes`` such passes, ``warm_passes`` of the same kind over one row in
``warm_share``, whole texts picked by a hash of the text, set the starting point. Long texts go through Baum-Welch in
segments with the forward values kept at their edges, which gives the same counts in bounded memory.

Edge cases: a null or empty text is one end token; null ids count as remainder 0; repeated rows are scored one by one; words of
equal count at the edge of the frequent ones stand or fall together; with no training rows N and V are 0 and every token
scores as unknown; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, pieces, remainder, scratch, table

END = b"\n"
BLOCKS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().translate(_LOWER).split()
    out.append(END)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for t in b.column(0).to_pylist():
            seen.update(tokens(t))
            if len(seen) > 250_000:
                yield out()
                seen.clear()
    if seen:
        yield out()


class Classes:
    """Which class a word is in, and the constants of the classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], n_rare: int, n_tokens: int, n_words: int, rare_totals: dict[int, tuple[int, int]]):
        self.of = {w: i for i, (w, _) in enumerate(frequent)}
        self.n_frequent, self.n_rare, self.n_tokens, self.n_words = len(frequent), n_rare, n_tokens, n_words
        counts = np.array([c for _, c in frequent] + [rare_totals.get(r, (0, 0))[0] for r in range(n_rare)], np.float64)
        #: shares of the classes with 0.1 for each word and one unknown word a class, as in the base
        smooth = counts + 0.1 * np.append(np.ones(len(frequent)), [rare_totals.get(r, (0, 0))[1] + 1 for r in range(n_rare)])
        self.prior = smooth / smooth.sum()
        #: log10 of a frequent token's count + 0.1; rare words get theirs by a join
        self.log_count = np.log10(np.append(counts[: len(frequent)], np.full(n_rare, 0.9)) + 0.1)
        #: log10 of the denominator of a rare class; frequent tokens are alone in their class
        self.log_class = np.append(np.zeros(len(frequent)), [np.log10(t[0] + 0.1 * (t[1] + 1)) for t in (rare_totals.get(r, (0, 0)) for r in range(n_rare))])

    @property
    def size(self) -> int:
        return self.n_frequent + self.n_rare

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, Counter]:
        """Class numbers of a text, and its rare words with their counts."""
        get = self.of.get
        at = np.array([get(w, -1) for w in words], np.int32)
        away = np.flatnonzero(at < 0).tolist()
        rare: Counter[bytes] = Counter()
        if away:
            own = [words[i] for i in away]
            rare.update(own)
            at[away] = [self.n_frequent + zlib.crc32(w[-3:]) % self.n_rare for w in own]
        return at.astype(np.uint32), rare


class Hmm:
    """start (K), move (K, K), emit (classes, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def fresh(prior: np.ndarray, states: int, seed: int = 5) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * np.exp(rng.normal(0, 0.5, (len(prior), states)))
        move = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1))
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def _grid(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sequences sorted from long to short as columns, and how many are longer than t."""
        size = np.array([len(s) for s in seqs])
        obs = np.zeros((int(size[0]), len(seqs)), np.uint32)
        for i, s in enumerate(seqs):
            obs[: len(s), i] = s
        return obs, np.searchsorted(-size, -np.arange(len(obs)), side="left")

    def forward(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihoods of sequences sorted from long to short."""
        obs, live = self._grid(seqs)
        log, alpha = np.zeros(len(seqs)), None
        for t in range(len(obs)):
            n = live[t]
            e = self.emit.take(obs[t, :n], axis=0)
            alpha = self.start * e if t == 0 else (alpha[:n] @ self.move) * e
            s = alpha.sum(1)
            alpha /= s[:, None]
            log[:n] += np.log(s)
        return log

    def _segment(self, obs: np.ndarray, live: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward values, scales and emission of a run of positions that follows the forward values ``before``; single precision."""
        first, move, table = (x.astype(np.float32, copy=False) for x in (self.start, self.move, self.emit))
        emitted = table.take(obs, axis=0)
        alphas, scales = np.zeros((*obs.shape, len(first)), np.float32), np.ones(obs.shape, np.float32)
        alpha = before
        for t in range(len(obs)):
            n = live[t]
            alpha = (first if alpha is None else alpha[:n] @ move) * emitted[t, :n]
            s = alpha.sum(1)
            alpha /= s[:, None]
            alphas[t, :n], scales[t, :n] = alpha, s
        return alphas, scales, emitted

    def expect(self, seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, segment: int = 65_536) -> float:
        """Add the expected counts of sequences (long to short) to the three arrays (emit: K, classes); their log-likelihood."""
        obs, live = self._grid(seqs)
        edges = [None]  # forward values before each segment
        for a in range(segment, len(obs), segment):
            edges.append(self._segment(obs[a - segment : a], live[a - segment : a], edges[-1])[0][-1])
        k, log = len(self.start), 0.0
        back = np.ascontiguousarray(self.move.T.astype(np.float32))
        carry = None  # emission times backward value over scale, of the position after the segment
        for at in reversed(range(len(edges))):
            here = slice(at * segment, (at + 1) * segment)
            o, n = obs[here], live[here]
            alphas, scales, emitted = self._segment(o, n, edges[at])
            betas, after = np.ones_like(alphas), np.zeros_like(alphas)
            for t in range(len(o) - 1, -1, -1):
                if t + 1 < len(o):
                    m = n[t + 1]
                    x = emitted[t + 1, :m] * betas[t + 1, :m] / scales[t + 1, :m, None]
                elif carry is not None:
                    m, x = len(carry), carry
                else:
                    continue
                after[t, :m] = x
                betas[t, :m] = x @ back
            carry = emitted[0, : n[0]] * betas[0, : n[0]] / scales[0, : n[0], None]
            move += self.move * (alphas.reshape(-1, k).T @ after.reshape(-1, k))
            gamma = alphas * betas  # zero beyond the end of a sequence, as the forward values are
            if at == 0:
                start += gamma[0].sum(0)
            flat, of = o.ravel(), None
            if emit.shape[1] > 2 * len(flat):
                of, flat = np.unique(flat, return_inverse=True)
            for j in range(k):
                if of is None:
                    emit[j] += np.bincount(flat, gamma[:, :, j].ravel(), minlength=emit.shape[1])
                else:
                    emit[j, of] += np.bincount(flat, gamma[:, :, j].ravel(), minlength=len(of))
            log += float(np.log(scales, dtype=np.float64).sum())
        return log

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
        """Counts to probabilities; every state is drawn towards the shares of the classes in all texts, by 0.2 counts a class."""
        start, move = start + 1, move + 1
        emit = np.ascontiguousarray(emit.T) + 0.2 * len(prior) * prior[:, None]  # rows of a class side by side: they are gathered at every step
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def batches_of(seqs: list[np.ndarray], cells: int = 480_000) -> Iterator[list[int]]:
    """Positions of sequences, from long to short, in groups of bounded length times number."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    a = 0
    while a < len(order):
        n = max(1, min(1024, cells // max(1, len(seqs[order[a]]))))
        yield order[a : a + n]
        a += n


def _sequences(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]


def _encoded(docs: DataFrame, held_out, classes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classes.value
        for b in pieces(batches, 1024):
            seqs, rows = [], {k: [] for k in ("n", "known", "log", "words", "times")}
            for t in b.column(3).to_pylist():
                s, rare = own.encode(tokens(t))
                seqs.append(s.tobytes())
                top = s[s < own.n_frequent]
                rows["n"].append(len(s))
                rows["known"].append(len(top))
                rows["log"].append(float(own.log_count[top].sum()))
                rows["words"].append(list(rare))
                rows["times"].append(list(rare.values()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(seqs, pa.binary()), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], names=["doc_id", "held_out", "share", "seq", *rows])

    share = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(1 << 20)), F.lit(0))
    out = docs.select("doc_id", held_out.alias("held_out"), share.alias("share"), "text").mapInArrow(run, "doc_id long, held_out boolean, share long, seq binary, n long, known long, log double, words array<binary>, times array<int>")
    return out.withColumn("uid", F.monotonically_increasing_id())


def _pass(seqs: DataFrame, model: Hmm, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One Baum-Welch pass: expected counts over all rows of ``seqs``, summed in tasks and then in blocks of classes; None: no rows."""
    spark = seqs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # states times classes: a fixed size
    k = len(model.start)
    width = -(-size // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
        for b in pieces(batches, 1024):
            own = _sequences(b.column(0))
            for at in batches_of(own):
                hmm.expect([own[i] for i in at], start, move, emit)
        parts = [np.append(start, move.ravel()).tobytes()] + [np.ascontiguousarray(emit[:, a : a + width]).tobytes() for a in range(0, size, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts) - 1), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in t.column("counts").to_pylist())
        return pa.table({"block": t.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = {r["block"]: np.frombuffer(r["counts"], np.float64) for r in seqs.mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()}
    shared.unpersist()
    if not rows:
        return None
    head = rows.pop(-1)
    return head[:k], head[k:].reshape(k, k), np.concatenate([rows[i].reshape(k, -1) for i in sorted(rows)], 1)


def _likelihoods(encoded: DataFrame, model: Hmm, log_class: np.ndarray) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast((model, log_class))
    names = ["uid", "doc_id", "held_out", "n", "known", "log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, minus = shared.value
        for b in pieces(batches, 1024):
            own = _sequences(b.column(len(names)))
            out = np.zeros(len(own))
            for at in batches_of(own):
                out[at] = hmm.forward([own[i] for i in at]) / np.log(10)
            out -= [float(minus[s].sum()) for s in own]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out)], names=[*names, "model"])

    return encoded.select(*names, "seq").mapInArrow(run, "uid long, doc_id long, held_out boolean, n long, known long, log double, model double")


def hmm_scores(docs: DataFrame, held_out, states: int = 8, passes: int = 2, per_root: int = 190, warm_share: int = 8, warm_passes: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    with scratch(docs.sparkSession):
        return materialise(_scored(docs.select("doc_id", "text"), held_out, states, passes, per_root, warm_share, warm_passes), "scored", result=True)


def _scored(docs: DataFrame, held_out, states: int, passes: int, per_root: int, warm_share: int, warm_passes: int) -> DataFrame:
    spark = docs.sparkSession
    counts = docs.where(~held_out).select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialise(counts, "word_counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = int(per_root * round(n ** (1 / 3), 6))
    rare = max(1, frequent // 30)
    # the commonest words by bins of a sixteenth of an octave: some hundred rows tell from which bin on all words fit
    place = F.floor(F.log2(F.col("c").cast("double")) * 16)
    room, least = frequent, None
    for r in counts.groupBy(place.alias("place")).agg(F.count("*").alias("k")).orderBy(F.desc("place")).collect():
        room -= r["k"]
        if room < 0:
            break
        least = r["place"]
    top = [] if least is None else sorted(((bytes(r["word"]), r["c"]) for r in counts.where(place >= least).collect()), key=lambda x: (-x[1], x[0]))
    if n and END not in dict(top):
        top.append((END, counts.where(F.col("word") == F.lit(END)).first()["c"]))
    others = counts
    if top:
        others = counts.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w, _ in top], "word binary")), "word", "left_anti")
    totals = {r["r"]: (r["s"], r["k"]) for r in others.groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % rare).alias("r")).agg(F.sum("c").alias("s"), F.count("*").alias("k")).collect()}
    classes = Classes(top, rare, n, v, totals)

    encoded = materialise(_encoded(docs, held_out, spark.sparkContext.broadcast(classes)), "encoded")
    learned = encoded.where(~F.col("held_out"))
    model = Hmm.fresh(classes.prior, states)
    warm = materialise(learned.where(F.col("share") % warm_share == 0).select("seq"), "warm") if warm_passes else learned
    for seqs in [warm] * warm_passes + [learned.select("seq")] * passes:
        if (sums := _pass(seqs, model, classes.size)) is not None:
            model = Hmm.of_counts(*sums, classes.prior)

    scored = _likelihoods(encoded, model, classes.log_class)
    words = encoded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    known = words.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    base = float(np.log10(n + 0.1 * (v + 1)))
    nil = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(known, "uid", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + nil("rare_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log") + nil("rare_log") - F.col("n") * base).alias("base_score"),
        (F.col("model") + nil("rare_log")).alias("score"),
    )


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)
