"""BPE encoding and decoding by speculation and verification.

A byte-level BPE vocabulary is read from a ``tokenizers`` file. Each distinct word of a batch is first cut by greedy
longest match. A token sequence is what exact merging returns if and only if each token encodes to itself and each
adjacent pair of tokens, joined and merged exactly, gives that pair again; so all adjacent pairs of all new words are
looked up at once as packed integers (numpy), each distinct unknown pair is merged once and remembered, and only words
with a failing pair go through exact merging.

Edge cases: null and empty texts have no ids and decode to the empty text; the text of an added special token is that
token's id, as in the library; repeated rows and other columns stay as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import pieces, table

#: The byte-level pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters added to Unicode lately are letters for ``regex`` and not yet for the library. Texts with any character outside
#: these ranges, which hold no such letter, are split by the library's own splitter.
_SETTLED = regex.compile(r"[^\u0000-՗֐-ࡿḀ-⁯₠-⯿　-꒏가-힣\U0001f300-\U0001faff]")
#: Distinct words and pairs that a worker remembers; beyond that it starts anew.
MEMORY = 300_000
#: Words of more bytes are merged one at a time.
WIDE = 40
NEVER = 1 << 40


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SpeculativeBpe:
    """One vocabulary, with what has been learned about words and pairs so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in byte_chars().items()}
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(a["id"] for a in spec.get("added_tokens", []))]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        special_ids = set(self.special.values())
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b and i not in special_ids}
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)])
        self.reach: dict[bytes, int] = {}  # the longest token that begins with these two bytes
        for b in self.id_of:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        keys = np.array([a * self.size + b for a, b in self.rank])
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank, self.pair_new = (np.array([v[k] for v in self.rank.values()])[order] for k in (0, 1))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.library = None
        self.token_bytes = None
        self.forget()
        self.fits: dict[int, bool] = {}
        self.own: dict[int, bool] = {}

    def forget(self) -> None:
        """Remembered words: a row each of ``start`` and ``count``, which point into ``flat``."""
        self.words: dict[str, int] = {}
        self.start, self.count, self.flat = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        for text, i in self.special.items():
            self._remember([text], [[i]])

    def _remember(self, words: list[str], ids: list[list[int]]) -> None:
        n = len(self.words)
        self.words.update(zip(words, range(n, n + len(words))))
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))])

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word: the lowest-ranked pair first, leftmost first."""
        return self._merge_long([self.id_of[word[i : i + 1]] for i in range(len(word))])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; pairs that don't merge have the rank NEVER."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == key
        return np.where(known, self.pair_rank[at], NEVER), self.pair_new[at]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once; each round merges the best pair of every word."""
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= WIDE]
        for i, w in enumerate(words):
            if len(w) > WIDE:
                out[i] = self.merge(w)
        short.sort(key=lambda i: len(words[i]))
        for a in range(0, len(short), 4096):  # words of like length together
            own = short[a : a + 4096]
            size = np.array([len(words[i]) for i in own])
            wide = int(size.max(initial=0))
            if not wide:
                continue
            raw = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in own), np.uint8).reshape(-1, wide)
            ids = self.byte_id[raw]
            live = np.arange(wide)[None] < size[:, None]
            rank = np.full((len(own), wide), NEVER)
            new = np.zeros((len(own), wide), np.int64)
            if wide > 1:
                rank[:, :-1], new[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
                rank[:, :-1][~live[:, 1:]] = NEVER
            rows = np.arange(len(own))
            done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(rows):
                best = rank.argmin(1)
                k = np.arange(len(rows))
                more = rank[k, best] < NEVER
                if not more.all():
                    done.append((rows[~more], ids[~more], size[~more]))
                    rows, ids, rank, new, size, best = rows[more], ids[more], rank[more], new[more], size[more], best[more]
                    k = np.arange(len(rows))
                    if not len(rows):
                        break
                ids[k, best] = new[k, best]
                shift = np.arange(wide)[None] > best[:, None]
                for m, fill in ((ids, 0), (rank, NEVER), (new, 0)):
                    moved = np.concatenate([m[:, 1:], np.full((len(rows), 1), fill, m.dtype)], 1)
                    m[shift] = moved[shift]
                size = size - 1
                at = np.maximum(best - 1, 0)  # the pairs left and right of the merged one are new
                for left in (at, best):
                    right = np.minimum(left + 1, wide - 1)
                    r, n = self._ranks(ids[k, left], ids[k, right])
                    rank[k, left] = np.where(left + 1 < size, r, NEVER)
                    new[k, left] = n
            for r, x, n in done:
                for i, row, m in zip(r.tolist(), x.tolist(), n.tolist()):
                    out[own[i]] = row[:m]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merging over a linked list and a heap, for words of any length."""
        import heapq

        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.rank.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (r[0], left, ids[left], ids[right], r[1]))
        return [x for x, keep in zip(ids, alive) if keep]

    def greedy(self, word: bytes) -> list[int]:
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        out, i, n, get, reach = [], 0, len(word), self.id_of.get, self.reach.get
        while i < n:
            for j in range(min(n, i + reach(word[i : i + 2], 1)), i, -1):
                if (t := get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def learn(self, new: list[str]) -> None:
        """Encode words that are not remembered: speculate all, check all adjacent pairs, merge what fails."""
        if len(self.fits) > MEMORY:
            self.fits = {}
        raw = [w.encode() for w in new]
        cuts = [self.greedy(b) for b in raw]
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((t for c in cuts for t in c), np.int64, int(lengths.sum()))
        word_of = np.repeat(np.arange(len(cuts)), lengths)
        ok = np.ones(len(cuts), bool)
        tokens, at = np.unique(flat, return_inverse=True)
        own = np.fromiter((self._own(int(t)) for t in tokens), bool, len(tokens))
        np.logical_and.at(ok, word_of, own[at])
        inside = word_of[1:] == word_of[:-1] if len(flat) else np.zeros(0, bool)
        pairs = flat[:-1][inside] * self.size + flat[1:][inside] if len(flat) else flat
        distinct, at = np.unique(pairs, return_inverse=True)
        self._check([p for p in distinct.tolist() if p not in self.fits])
        fit = np.fromiter(map(self.fits.__getitem__, distinct.tolist()), bool, len(distinct))
        np.logical_and.at(ok, word_of[1:][inside] if len(flat) else word_of, fit[at])
        failing = np.flatnonzero(~ok).tolist()
        for i, ids in zip(failing, self.merge_all([raw[i] for i in failing])):
            cuts[i] = ids
        self._remember(new, cuts)

    def _own(self, t: int) -> bool:
        if (known := self.own.get(t)) is None:
            known = self.own[t] = self.merge(self.bytes_of[t]) == [t]
        return known

    def _check(self, pairs: list[int]) -> None:
        split = [divmod(p, self.size) for p in pairs]
        merged = self.merge_all([self.bytes_of[a] + self.bytes_of[b] for a, b in split])
        self.fits.update((p, ids == [*ab]) for p, ab, ids in zip(pairs, split, merged))

    def split(self, text: str) -> list[str]:
        if not _SETTLED.search(text):
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import pre_tokenizers

            self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin, with the end."""
        parts: list[list[str]] = []
        for text in texts:  # the texts of special tokens can't be words of the pattern: they are split before it
            if self.split_special is not None and any(t in text for t in self.special):
                own: list[str] = []
                for piece in self.split_special.split(text):
                    own += [piece] if piece in self.special else self.split(piece)
                parts.append(own)
            else:
                parts.append(self.split(text))
        here = set().union(*parts)
        new = here - self.words.keys()
        if new and len(self.words) + len(new) > MEMORY:
            self.forget()
            new = here - self.words.keys()
        if new:
            self.learn(list(new))
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, int(n_words.sum()))
        return _gather(self.flat, self.start[at], count := self.count[at]), np.append(0, np.cumsum(count))[np.append(0, np.cumsum(n_words))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each list of ids; invalid UTF-8 is replaced as the library does."""
        if self.token_bytes is None:
            count = np.array([len(b) for b in self.bytes_of])
            self.token_bytes = (np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(count) - count, count)
        raw, start, count = self.token_bytes
        ends = np.append(0, np.cumsum(count[ids]))[offsets].tolist()
        out = _gather(raw, start[ids], count[ids]).tobytes()
        return [out[a:z].decode("utf-8", "replace") for a, z in zip(ends, ends[1:])]


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], one after the other."""
    at = np.repeat(start - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return flat[at]


@lru_cache(2)
def load(path: str) -> SpeculativeBpe:
    """One vocabulary and its memory for each Python worker, kept from task to task."""
    return SpeculativeBpe(path)


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids``: the token ids of each whole text, as ``tokenizers`` gives them without special tokens added."""
    kept = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in pieces(batches):
            texts = [t or "" for t in b.column(kept.index(text)).to_pylist()]
            found, ends = [], [np.zeros(1, np.int64)]
            group: list[str] = []
            size = 0
            for i, t in enumerate(texts):  # very long texts make small groups
                group.append(t)
                size += len(t)
                if size > 2_000_000 or i + 1 == len(texts):
                    flat, at = bpe.encode(group)
                    found.append(flat)
                    ends.append(at[1:] + ends[-1][-1])
                    group, size = [], 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*kept, ids])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, _added(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text``: what the ids stand for, special tokens included; null ids: the empty text."""
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in pieces(batches):
            lists = b.column(kept.index(ids)).fill_null([])
            found = bpe.decode(lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*kept, text])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, _added(df, text, T.StringType()))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(df: DataFrame) -> DataFrame:
    """The contract's columns from a frame with ``ids`` and ``decoded``."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, tokenizer_path()).drop("text")
    return digests(decode(encoded, tokenizer_path()))
