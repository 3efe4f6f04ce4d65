"""Personal data by candidate gradient boosting. DataFrame functions only on the main path.

Generators propose spans of four kinds with high recall: what the base patterns match, valid or not, and looser forms
(spelled-out e-mail addresses, IPv6, telephone numbers without a plus). Candidates that the base rules accept are always
kept, those of a base form that they reject never; loose candidates that overlap a kept one, or whose format no value of
their kind can have, go. The others are judged by boosted trees.

The trees learn from base forms alone, whose label is evidence that no feature holds: the checksum of a card number, the
ranges of an address's parts, the number of a telephone number's digits. The features are what base and loose forms have in
common: the kind, the neighbouring characters, hint words in front of the same kind or of something else, and how varied
the digits are. So what is learned is which contexts hold real values, and it carries over to the loose forms, which are
never labelled. All base candidates are grouped by their features, a table of bounded size (the product of the small
feature ranges). Trees are fitted on the candidates of one half of the documents, and each kind's threshold is calibrated
on the other half: the lowest score at which precision stays at ``precision``; a kind without such a score adds nothing.
The trees are applied as one SQL expression.

Edge cases: null and empty texts have no spans; empty tables, repeated rows and null ids are passed through row by row;
spans that end together with the text, or fill it, are found; offsets count code points; further columns are ignored by
``candidates`` and kept by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, scratch, table
from tessera.llm.op6_fingerprint import let

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that a failing run of characters is tried once and nothing recurses.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{{1,63}}+){{1,6}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": None,
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: Words before a candidate that hint at a kind, or at something else (the last group).
HINTS = (r"(?i)mail", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|credit|pay", r"(?i)tel|phone|call|fax|mobil", r"(?i)token|key|order|isbn|serial|version|\bid\b|#|=")
CONTEXT = 24
FEATURES = ("kind", "variety", "before", "after", "hint")


def _found(text: Column, pattern: str, kind: int, base: bool) -> Column:
    """All matches of a pattern from left to right: kind, base form or not, start (from 0), and the match."""
    kind_of = "array<struct<kind:int,base:boolean,start:int,m:string>>"
    runs = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        row = F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), at.alias("start"), x["m"].alias("m"))
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(runs, start, add, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(c: Column) -> Column:
    digits = F.regexp_replace(c["m"], "[^0-9]", "")
    n = F.length(digits)
    part_ok = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 2) | (F.length(q) == 3) & (q <= "255"))
    rule = (
        F.when(c["kind"] == 0, F.lit(True))
        .when(c["kind"] == 1, F.forall(F.split(c["m"], r"\."), part_ok))
        .when(c["kind"] == 2, F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False))
        .otherwise((n >= 9) & (n <= 15))
    )
    return F.when(c["base"], rule).otherwise(False)


def _fits(c: Column) -> Column:
    """Whether a loose candidate has the format of its kind: a domain that ends in letters, eight groups that are not all
    pairs (those are hardware addresses), or area code and exchange of a telephone number."""
    digits = F.regexp_replace(c["m"], "[^0-9]", "")
    rule = (
        F.when(c["kind"] == 0, c["m"].rlike(r"(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,24}$"))
        .when(c["kind"] == 1, (F.size(F.split(c["m"], ":")) == 8) & ~c["m"].rlike("^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})*$"))
        .otherwise(digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"))
    )
    return F.when(c["base"], F.lit(False)).otherwise(rule)


def _side(ch: Column) -> Column:
    """Kind of a neighbouring character: 0 none or space, 1 letter, 2 digit, 3 other."""
    return F.when((ch == "") | ch.rlike(r"\s"), 0).when(ch.rlike(r"\p{L}"), 1).when(ch.rlike("[0-9]"), 2).otherwise(3)


def _described(text: Column, c: Column) -> Column:
    """A candidate with its end, its validity under the base rules, whether a loose one has the format of its kind (and, for
    digits alone, no hint at something else), and its features, all small integers."""
    m, start = c["m"], c["start"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    around = F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
    hint = reduce(lambda w, ih: w.when(around.rlike(ih[1]), ih[0] + 1), enumerate(HINTS[1:], 1), F.when(around.rlike(HINTS[0]), 1)).otherwise(0)
    # digits of an e-mail address say nothing, and those of an IPv6 address something else than those of an IPv4 address
    variety = F.when(c["kind"] >= 2, F.least(F.floor(F.size(F.array_distinct(F.split(digits, ""))) / 2), F.lit(5)).cast("int")).otherwise(0)
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    return F.struct(
        c["kind"].alias("kind"),
        F.when(c["base"], 0).otherwise(1).alias("form"),
        start.alias("start"),
        (start + F.length(m)).alias("end"),
        _valid(c).alias("valid"),
        variety.alias("variety"),
        _side(before).alias("before"),
        _side(F.substring(text, start + F.length(m) + 1, F.lit(1))).alias("after"),
        # a hint at the own kind, at none, at another one, at something else
        F.when(hint == c["kind"] + 1, 0).when(hint == 0, 1).when(hint < len(HINTS), 2).otherwise(3).alias("hint"),
        (_fits(c) & ((c["kind"] != 3) | (hint < len(HINTS)))).alias("fits"),
    )


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text) as doc_id and ``candidates``, an array of described spans by start."""
    t = F.col("t")
    none = F.array().cast("array<struct<kind:int,base:boolean,start:int,m:string>>")
    tests = {"email": (F.contains(t, F.lit("@")), F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))), "ip": (t.rlike(r"[0-9]\.[0-9]"), F.contains(t, F.lit(":"))), "card": (t.rlike("[0-9]{2}|[0-9][ -][0-9]"), None), "phone": (F.contains(t, F.lit("+")), t.rlike("[0-9]{3}[ .-][0-9]{4}"))}
    parts = []
    for i, kind in enumerate(KINDS):
        parts.append(F.when(tests[kind][0], _found(t, BASE[kind], i, True)).otherwise(none))
        if LOOSE[kind]:
            parts.append(F.when(tests[kind][1], _found(t, LOOSE[kind], i, False)).otherwise(none))
    # a run of one or a few digits is no candidate of any kind
    wide = lambda c: (c["kind"] != 2) | (F.length(F.regexp_replace(c["m"], "[^0-9]", "")) >= 9)
    out = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = out.select("doc_id", "t", F.filter(F.concat(*parts), wide).alias("found"))
    own = F.transform("found", lambda c: _described(F.col("t"), c))

    def apart(all_: Column) -> Column:
        """Without the loose candidates that overlap an accepted base span."""
        return let(F.filter(all_, lambda c: c["valid"]), lambda base: F.filter(all_, lambda c: (c["form"] == 0) | ~F.exists(base, lambda b: _overlap(b, c))))

    return out.select("doc_id", let(own, apart).alias("candidates"))


class BoostedTrees:
    """Trees of depth two over rows of small integers, with the logistic loss; a row counts as often as its weight says."""

    def __init__(self, rounds: int = 40, rate: float = 0.3):
        self.rounds, self.rate = rounds, rate
        self.first, self.trees = 0.0, []

    def fit(self, x, y, w) -> BoostedTrees:
        """x: rows of features, y: share of positive labels of each row, w: weights."""
        import numpy as np

        p = min(max((y * w).sum() / w.sum(), 1e-4), 1 - 1e-4)
        self.first = float(np.log(p / (1 - p)))
        z = np.full(len(x), self.first)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = w * (y - q), w * q * (1 - q) + 1e-9
            root = self._split(x, g, h, np.ones(len(x), bool))
            if root is None:
                break
            sides = []
            for side in (x[:, root[0]] <= root[1], x[:, root[0]] > root[1]):
                cut = self._split(x, g, h, side)
                if cut is None:
                    sides.append((None, self._leaf(g, h, side)))
                else:
                    low = x[:, cut[0]] <= cut[1]
                    sides.append((cut, self._leaf(g, h, side & low), self._leaf(g, h, side & ~low)))
            self.trees.append((root, *sides))
            z = z + self._tree(x, self.trees[-1])
        return self

    def _leaf(self, g, h, rows) -> float:
        return float(self.rate * g[rows].sum() / (h[rows].sum() + 1.0))

    @staticmethod
    def _split(x, g, h, rows):
        best, gain = None, 1e-6
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            for t in sorted(set(x[rows, f].tolist()))[:-1]:
                low = rows & (x[:, f] <= t)
                high = rows & ~low
                s = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                if s > gain:
                    best, gain = (f, t), s
        return best

    @staticmethod
    def _tree(x, tree):
        import numpy as np

        of = lambda s: np.full(len(x), s[1]) if s[0] is None else np.where(x[:, s[0][0]] <= s[0][1], s[1], s[2])
        return np.where(x[:, tree[0][0]] <= tree[0][1], of(tree[1]), of(tree[2]))

    def margins(self, x):
        import numpy as np

        return sum((self._tree(x, t) for t in self.trees), np.full(len(x), self.first))

    def expression(self, c: Column) -> Column:
        """The margin as a column over a candidate's fields."""
        below = lambda cut: c[FEATURES[cut[0]]] <= int(cut[1])
        of = lambda s: F.lit(s[1]) if s[0] is None else F.when(below(s[0]), s[1]).otherwise(s[2])
        return reduce(lambda a, t: a + F.when(below(t[0]), of(t[1])).otherwise(of(t[2])), self.trees, F.lit(self.first))


def fit(found: DataFrame, precision: float = 0.98) -> tuple[BoostedTrees | None, dict[int, float]]:
    """Trees from the base candidates of one half of the documents, and a threshold for each kind from those of the other half."""
    import numpy as np

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
    base = found.select(half, F.explode("candidates").alias("c")).where("c.form = 0")
    rows = base.groupBy("half", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum(F.col("c.valid").cast("int")).alias("good")).collect()
    rows.sort()
    of = lambda own: (np.array([[r[f] for f in FEATURES] for r in own]), np.array([r["n"] for r in own], float), np.array([r["good"] for r in own], float))
    learned = [r for r in rows if r["half"] == 0]
    if not learned:
        return None, {}
    x, w, good = of(learned)
    model, limits = BoostedTrees().fit(x, good / w, w), {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["half"] == 1 and r["kind"] == kind]
        if not own:
            continue
        x, w, good = of(own)
        z = model.margins(x)
        order = np.argsort(-z, kind="stable")
        z, w, good = z[order], w[order], good[order]
        ends = np.append(np.flatnonzero(z[:-1] - z[1:] > 1e-9), len(z) - 1)  # rows of one score stand or fall together
        sure = ends[np.cumsum(good)[ends] >= precision * np.cumsum(w)[ends]]
        if len(sure) and good.sum():
            limits[kind] = float(z[sure[-1]] - 1e-9)
    return model, limits


def spans(found: DataFrame, model: BoostedTrees | None, limits: dict[int, float]) -> DataFrame:
    """doc_id, ``base`` and ``all``: arrays of (start, kind, end), by start and then kind."""
    row = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("candidates", lambda c: c["valid"]), row))
    if model is None or not limits:
        return found.select("doc_id", base.alias("base"), base.alias("all"))

    def sure(c: Column) -> Column:
        least = reduce(lambda w, kv: w.when(c["kind"] == kv[0], kv[1]), limits.items(), F.when(F.lit(False), 0.0))
        return (c["form"] == 1) & c["fits"] & F.coalesce(model.expression(c) >= least, F.lit(False))

    more = F.transform(F.filter("candidates", sure), row)
    out = found.select("doc_id", base.alias("base"), F.array_sort(more).alias("more"))
    free = lambda acc, c: ~F.exists(acc, lambda b: _overlap(b, c))
    return out.select("doc_id", "base", F.array_sort(F.aggregate("more", F.col("base"), lambda acc, c: F.when(free(acc, c), F.concat(acc, F.array(c))).otherwise(acc))).alias("all"))


def joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by its (first) kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def add(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.get(names, s["kind"]))).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def find(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """doc_id, base and all spans of each row of docs (doc_id, text)."""
    with scratch(docs.sparkSession):
        found = materialise(candidates(docs), "candidates")
        return materialise(spans(found, *fit(found, precision)), "spans", result=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("all").alias("spans"))
