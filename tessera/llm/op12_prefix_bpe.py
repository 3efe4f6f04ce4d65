"""Byte-level BPE over ranks by prefix dynamic programming, with exact appends and re-encoding near edits.

For each prefix of a word there is one token that its encoding ends with: the token t that ends there, encodes to itself,
and fits the last token of the prefix in front of it (two tokens fit if merging their joined bytes gives the two again; a
sequence whose neighbours all fit is what merging returns). So a table of last tokens, filled from left to right, holds
the encoding of every prefix. Appending bytes extends the table; after an edit only the entries from there on are
computed again, until as many as the longest token has bytes agree with the old ones.

Whether two tokens fit is read off their last merges: going back in time along the right spine of the first and the left
spine of the second, each pair of parts that stood side by side must not have merged across the border first. That
reading needs the merges within a token to come in the order of their ranks, which is checked for each token; pairs with
a token that fails this are merged out.

Ids are kept as binary columns of little-endian unsigned 32-bit integers. Edge cases: null and empty texts have no ids and
decode to no bytes; very long words cost time in proportion; repeated rows and other columns stay as they are; an empty
table gives an empty table; edits are clipped to the text, and null edits change nothing.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import pieces, table
from tessera.llm.op8_bpe import _SETTLED, SpeculativeBpe, _added, _gather

NEVER = 1 << 40
#: Places for remembered pairs of a worker, 8 bytes each (32 MB); a pair takes the place of the one that was there.
PLACES = 4_194_301
#: Bytes by whose end the lengths of possible tokens are looked up.
ENDING = 5
#: A space between two characters that are none: a match of the pattern begins there, whatever lies before or after.
_BORDER = regex.compile(r"(?<=\S) (?=\S)")


class PrefixBpe(SpeculativeBpe):
    """A rank vocabulary; what has been learned about words, tokens and pairs stays with the worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.id_of = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.longest = max(map(len, ranks))
        self.special: dict[str, int] = {}
        self.split_special = None
        self.pattern = regex.compile(pattern)
        self.pattern_text = pattern
        self.stand_in: dict[int, str] = {}
        self.token_bytes = None
        self.spines: dict[int, tuple | None] = {}
        self.forget()

    # made when first needed: decoding needs none of them

    @cached_property
    def joined(self) -> dict[int, int]:
        """What a pair of tokens merges to."""
        get, found = self.id_of.get, {}
        for z, i in self.id_of.items():
            for k in range(1, len(z)):
                if (a := get(z[:k])) is not None and (b := get(z[k:])) is not None:
                    found[a * self.size + b] = i
        return found

    @cached_property
    def reachable(self) -> dict[bytes, int]:
        """The tokens that merging their bytes gives."""
        return {b: i for b, i in self.id_of.items() if self.merge_steps(b)[0] == [i]}

    @cached_property
    def sizes(self) -> dict[bytes, tuple[int, ...]]:
        """How long these tokens are that end with so many bytes (ENDING, or fewer where no longer token ends so), the longest first."""
        found: dict[bytes, set[int]] = {}
        for z in self.reachable:
            if len(z) > 1:
                found.setdefault(z[-ENDING:], {1}).add(len(z))
        for end, of in found.items():
            of.update(n for n in range(2, len(end)) if end[-n:] in self.reachable)
        return {end: tuple(sorted(of, reverse=True)) for end, of in found.items()}

    @cached_property
    def places(self) -> array:
        """Of remembered pairs twice their number, plus one if they fit, each at its place."""
        return array("q", [-1]) * PLACES

    def split(self, text: str) -> list[str]:
        """Matches of the pattern. Characters whose class depends on the version of Unicode take the class the library gives them."""
        if not _SETTLED.search(text):
            return self.pattern.findall(text)
        new = {c for c in _SETTLED.findall(text) if ord(c) not in self.stand_in}
        if new:
            self._ask(new)
        shown = text.translate(self.stand_in)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]

    def _ask(self, chars: set[str]) -> None:
        """A settled character of the same class for each of these, by the library's own matches."""
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        for lead in "x1!":
            for c in chars:
                whole = (lead + c).encode()
                for k in range(2, len(whole) + 1):
                    ranks.setdefault(whole[:k], len(ranks))
        probe = tiktoken.Encoding("classes", pat_str=self.pattern_text, mergeable_ranks=ranks, special_tokens={})
        for c in chars:
            self.stand_in[ord(c)] = next((lead for lead in "x1!" if len(probe.encode_ordinary(lead + c)) == 1), " ")

    def merge_steps(self, word: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Merging by definition, lowest rank first and leftmost first: the tokens, and the parts of the last merge."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n, last = len(ids), None
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        joined, size = self.joined, self.size
        heap = [(z, i, ids[i], ids[i + 1]) for i in range(n - 1) if (z := joined.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            z, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            last = (a, b)
            ids[i], alive[j], after[i] = z, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (y := joined.get(ids[left] * size + ids[right])) is not None:
                    heapq.heappush(heap, (y, left, ids[left], ids[right]))
        return [x for x, keep in zip(ids, alive) if keep], last

    def spine(self, t: int) -> tuple | None:
        """Both spines of a token, and whether its merges come in the order of their ranks.

        A spine has the parts at one border, each with the ranks of the merge that makes it and of the one that takes it in.
        None for a token that merging its bytes doesn't give.
        """
        found = self.spines.get(t, 0)
        if found != 0:
            return found
        tokens, last = self.merge_steps(self.bytes_of[t])
        if tokens != [t]:
            found = None
        elif last is None:
            found = (((t, -1, NEVER),), ((t, -1, NEVER),), True)
        else:
            own = (t, t, NEVER)
            sides, in_order = [], True
            for k, part in ((0, last[1]), (1, last[0])):
                below = self.spine(part)
                if below is None:  # can't be: parts of a merge are themselves merged from their bytes
                    raise ValueError(f"part {part} of token {t} does not encode to itself")
                sides.append((own, (part, below[k][0][1], t), *below[k][1:]))
                in_order &= below[2] and below[k][0][1] < t
            found = (*sides, in_order)
        self.spines[t] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again."""
        pair = 2 * (a * self.size + b)
        held = self.places[pair % PLACES]
        if held >> 1 == pair >> 1:
            return held > pair
        one, two = self.spine(a), self.spine(b)
        if one[2] and two[2]:
            known = self._apart(one[0], two[1])
        else:
            known = self.merge_steps(self.bytes_of[a] + self.bytes_of[b])[0] == [a, b]
        self.places[pair % PLACES] = pair + known
        return known

    def _apart(self, left: tuple, right: tuple) -> bool:
        i = j = 0
        joined, size = self.joined, self.size
        while True:
            x, made_x, until_x = left[i]
            y, made_y, until_y = right[j]
            z = joined.get(x * size + y)
            # of equal ranks the leftmost merges first: before a merge within the second token, after one within the first
            if z is not None and z < until_x and z <= until_y:
                return False
            if made_x > made_y:  # back to the time before the later of the two was made
                i += 1
            elif made_y >= 0:
                j += 1
            else:
                return True

    def fill(self, word: bytes, last: list[int], begin: int) -> None:
        """Extend a table that holds the last tokens of the prefixes up to ``begin``."""
        get, sizes, places, size = self.reachable.get, self.sizes.get, self.places, 2 * self.size
        for i in range(begin + 1, len(word) + 1):
            for n in (i > 4 and sizes(word[i - 5 : i])) or (i > 3 and sizes(word[i - 4 : i])) or (i > 2 and sizes(word[i - 3 : i])) or (i > 1 and sizes(word[i - 2 : i])) or (1,):
                k = i - n
                if k < 0 or (t := get(word[k:i])) is None:
                    continue
                if k:
                    pair = last[k] * size + t + t
                    held = places[pair % PLACES]
                    if held != pair + 1 and (held == pair or not self.fits(last[k], t)):
                        continue
                last.append(t)
                break

    def back(self, last: list[int], end: int | None = None) -> list[int]:
        """The tokens of a prefix, from its table."""
        i, out, bytes_of = len(last) - 1 if end is None else end, [], self.bytes_of
        while i:
            t = last[i]
            out.append(t)
            i -= len(bytes_of[t])
        return out[::-1]

    def learn(self, new: list[str]) -> None:
        """Encode words that are not remembered, in order of their bytes: the table of one word serves the next as far as both agree."""
        ids: dict[str, list[int]] = {}
        before, last = b"", [0]
        for b, w in sorted((w.encode(), w) for w in new):
            whole = self.id_of.get(b)  # a word that is a token is that token, even if merging gives another result
            if whole is not None:
                ids[w] = [whole]
                continue
            same, most = 0, min(len(before), len(b))
            while same < most and before[same] == b[same]:
                same += 1
            del last[same + 1 :]
            self.fill(b, last, same)
            ids[w] = self.back(last)
            before = b
        self._remember(list(ids), list(ids.values()))

    def lengths(self) -> np.ndarray:
        if self.token_bytes is None:
            count = np.array([len(b) for b in self.bytes_of])
            self.token_bytes = (np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(count) - count, count)
        return self.token_bytes[2]

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        count = self.lengths()
        flat, start, _ = self.token_bytes
        return _gather(flat, start[ids], count[ids]).tobytes()

    def edit(self, text: str, ids: np.ndarray, start: int, end: int, new: str) -> tuple[str, np.ndarray]:
        """The text with code points start to end replaced, and its ids; only the words around the edit are encoded."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        changed = text[:start] + new + text[end:]
        lo = 0
        for a in range(max(0, start - 4096), -1, -4096) if start > 4096 else (0,):  # the last border before the edit, near it if there is one
            near = [m.start() for m in _BORDER.finditer(text, a, max(start, 0)) if m.start() + 2 <= start]
            if near or not a:
                lo = near[-1] if near else 0
                break
        after = _BORDER.search(text, end)
        after = _BORDER.search(text, after.start() + 1) if after and after.start() <= end else after
        hi = after.start() if after else len(text)
        ends = np.cumsum(self.lengths()[ids]) if len(ids) else np.zeros(0, np.int64)
        first = len(text[:lo].encode())
        last = first + len(text[lo:hi].encode())
        a = int(np.searchsorted(ends, first, "right")) if first else 0
        b = int(np.searchsorted(ends, last, "left")) + 1 if last > first else a
        middle, _ = self.encode([changed[lo : len(changed) - (len(text) - hi)]])
        return changed, np.concatenate([ids[:a], middle.astype(ids.dtype), ids[b if last > first else a :]])


class PrefixTable:
    """The table of one word: encodings of all its prefixes, kept up to date under appends and edits."""

    def __init__(self, bpe: PrefixBpe, word: bytes = b""):
        self.bpe, self.word, self.last, self.computed = bpe, b"", [0], 0
        self.append(word)

    def append(self, more: bytes) -> None:
        begin = len(self.word)
        self.word += more
        self.computed += len(more)
        self.bpe.fill(self.word, self.last, begin)

    def tokens(self, end: int | None = None) -> list[int]:
        """The ids of the first ``end`` bytes."""
        return self.bpe.back(self.last, end)

    def replace(self, start: int, end: int, new: bytes) -> None:
        old, shift = self.last, start + len(new) - end
        self.word, size = self.word[:start] + new + self.word[end:], self.bpe.longest
        self.last = old[: start + 1]
        at = start
        while at < len(self.word):
            step = min(at + size, len(self.word))
            self.bpe.fill(self.word[:step], self.last, at)
            self.computed += step - at
            begin, at = at, step
            # a token's bytes and all the entries it can follow are the same from here on
            if begin >= start + len(new) and at - begin == size and self.last[begin + 1 : at + 1] == old[begin + 1 - shift : at + 1 - shift]:
                self.last += old[at + 1 - shift :]
                return


@lru_cache(2)
def load(path: str, pattern: str) -> PrefixBpe:
    """One vocabulary and its memory for each Python worker, kept from task to task."""
    return PrefixBpe(path, pattern)


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a binary column ``ids``: the ids of each whole text, as ``tiktoken`` gives them without special tokens."""
    kept = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for b in pieces(batches):
            found: list[bytes] = []
            group: list[str] = []
            size, texts = 0, _texts(b.column(kept.index(text)))
            for i, t in enumerate(texts):  # very long texts make small groups
                group.append(t)
                size += len(t)
                if size > 2_000_000 or i + 1 == len(texts):
                    flat, at = bpe.encode(group)
                    raw, at = flat.astype("<u4").tobytes(), (4 * at).tolist()
                    found += [raw[a:z] for a, z in zip(at, at[1:])]
                    group, size = [], 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*kept, ids])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, _added(df, ids, T.BinaryType()))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes that the ids stand for; null ids: no bytes."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for b in pieces(batches):
            found = [bpe.raw(np.frombuffer(x or b"", "<u4")) for x in b.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*kept, out])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, _added(df, out, T.BinaryType()))


def edit(df: DataFrame, ranks: str, pattern: str, start: str = "start", end: str = "end", new: str = "new", text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` after one edit a row: code points ``start`` to ``end`` become ``new``; text and ids follow, encoded near the edit alone.

    An append is an edit from the end on; start and end may lie past it.
    """

    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for b in pieces(batches):
            column = {c: b.column(columns.index(c)).to_pylist() for c in (start, end, new, text, ids)}
            texts, found = [], []
            for a, z, n, t, x in zip(*(column[c] for c in (start, end, new, text, ids))):
                if a is None or z is None or n is None:
                    texts.append(t)
                    found.append(x)
                    continue
                changed, own = bpe.edit(t or "", np.frombuffer(x or b"", "<u4"), a, z, n)
                texts.append(changed)
                found.append(own.astype("<u4").tobytes())
            made = {text: pa.array(texts, pa.string()), ids: pa.array(found, pa.binary())}
            yield pa.RecordBatch.from_arrays([made.get(c, b.column(i)) for i, c in enumerate(columns)], names=columns)

    return df.mapInArrow(run, df.schema)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(df: DataFrame) -> DataFrame:
    """The contract's columns from a frame with ``ids`` and ``decoded``."""
    return df.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(decode(encode(docs, *vocabulary()).drop("text"), *vocabulary()))
