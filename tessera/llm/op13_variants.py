"""Spelling variants: words at one edit, grouped under the most frequent form.

Even-partition pigeonhole join. A word of length l is indexed by its two halves (the first has l div 2 code points): if one
edit turns it into another word, one half stays whole. Words of the same length probe with their own halves; words one
longer probe with the substrings that would be those halves, the second one shifted by one. Words that meet under
(length, half) are candidates, verified by an edit distance of one on the parts that the key leaves open.

A half that many words share would compare them all, so a bucket of more than ``BUCKET`` words is split again by the same
rule: the open part is cut in two, and one half of it must match too. At an open part of one code point a bucket holds only
words that differ there, so no bucket compares more than what the alphabet allows, and no candidate is left out.

Edge cases: null and empty texts have no runs; a null doc_id counts as an empty text in the checksum; repeated rows count
each; of equally frequent near words the smallest in code-point order is taken; an empty table gives an empty table;
other columns of the documents are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, crc32_sql, materialise, scratch, table

RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST, RAREST = 5, 3
#: Entries of a bucket that are compared with each other; larger buckets are split.
BUCKET = 64
KEY = ["size", "pre", "suf"]


def variant_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the corpus's words with their counts, after the contract's planted deletions."""
    run, h = F.col("run"), F.col("h")
    own = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(0))).alias("run"))
    own = own.where(F.length("run") >= SHORTEST).select("id", ascii_lower(run).alias("run"))
    own = own.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    # counted by run and cut first, so that texts are cut once for each distinct pair and not for each occurrence
    at = F.when(h % 97 == 0, (h % F.length("run")).cast("int"))
    cuts = own.select("run", at.alias("at")).groupBy("run", "at").agg(F.count(F.lit(1)).alias("n"))
    cut = F.concat(F.substring(run, F.lit(1), F.col("at")), F.substring(run, F.col("at") + 2, F.length("run")))
    words = cuts.select(F.when(F.col("at").isNull(), run).otherwise(cut).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.length("word") >= SHORTEST) & (F.col("n") >= RAREST))


def _halves(entries: DataFrame) -> DataFrame:
    """Each entry under both halves of its open part; ``more`` is 1 for words one longer than the indexed ones."""
    opened, more = F.col("opened"), F.col("more")
    a = F.floor((F.length("opened") - more) / 2).cast("int")
    rest = F.length("opened")
    left = F.struct(F.concat("pre", F.substring(opened, F.lit(1), a)).alias("pre"), F.col("suf").alias("suf"), F.substring(opened, a + 1, rest).alias("opened"))
    right = F.struct(F.col("pre").alias("pre"), F.concat(F.substring(opened, a + more + 1, rest), "suf").alias("suf"), F.substring(opened, F.lit(1), a + more).alias("opened"))
    return entries.select("word", "n", "size", "more", F.explode(F.array(left, right)).alias("s")).select("word", "n", "size", "more", "s.*")


def _met(entries: DataFrame) -> DataFrame:
    """Pairs that meet under a key and are one edit apart."""
    short = entries.where("more = 0").select(*KEY, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("opened").alias("a_open"))
    other = entries.select(*KEY, F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("opened").alias("b_open"), "more")
    one = F.levenshtein("a_open", "b_open", 1) == 1
    return short.join(other, KEY).where(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & one).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, a_n, b, b_n: all pairs of different words at one edit, the shorter or smaller first; a pair can come more than once."""
    own = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    # a word is indexed with its own length, and probes those one shorter
    entries = _halves(own.select("word", "n", (F.length("word") - F.col("more")).alias("size"), "more", F.lit("").alias("pre"), F.lit("").alias("suf"), F.col("word").alias("opened")))
    found = []
    while True:
        entries = materialise(entries, "entries")
        still_open = F.col("size") - F.length("pre") - F.length("suf")
        hot = entries.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > bucket) & (still_open > 1)).select(*KEY)
        hot = materialise(hot, "hot")
        if hot.isEmpty():
            return reduce(DataFrame.unionAll, [*found, _met(entries)])
        found.append(_met(entries.join(hot, KEY, "left_anti")))
        entries = _halves(entries.join(hot, KEY, "left_semi"))


def roots(links: DataFrame) -> DataFrame:
    """word, root from word, form: each chain's end, by pointer doubling; counts at least double at each step, so chains are short."""
    links = materialise(links.select("word", F.col("form").alias("root")), "links")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialise(links.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words and their counts."""
    words = materialise(words, "words")
    pairs = near_pairs(words, bucket)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    # one shuffle: rows dealt by word serve the removal of repeats and the aggregation
    each = both.repartition("word").distinct().groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("r"), F.col("near").alias("w"))).alias("best"))
    takes = -F.col("best.r") >= 2 * F.col("n")
    best = materialise(each.select("word", "n_near", F.when(takes, F.col("best.w")).alias("form"), F.when(takes, -F.col("best.r")).alias("form_n")), "best")
    root = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return materialise(variants(variant_words(table(spark, sf_dir, "documents"))), "variants", result=True)


def oracle_sql() -> str:
    return f"""
    with recursive runs as (
      select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(text, '{RUN}')) as run from documents
    ), low as (
      select run, id || ':' || run as x, count(*) as c
      from (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from runs where length(run) >= {SHORTEST}) group by run, id
    ), crc as (
      select run, c, {crc32_sql("x")} as h from low
    ), cut as (
      select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from crc
    ), words as (
      select word, cast(sum(c) as bigint) as n from cut where length(word) >= {SHORTEST} group by word having sum(c) >= {RAREST}
    ), gaps as (
      select word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: {{'k': left(word, i - 1) || '_' || substr(word, i + 1), 'd': left(word, i - 1) || substr(word, i + 1)}})) as g from words
    ), near as (
      select a.word, a.n, b.word as near, b.n as near_n from gaps a join gaps b on a.g.k = b.g.k and a.word <> b.word
      union
      select a.word, a.n, b.word, b.n from gaps a join words b on a.g.d = b.word
      union
      select b.word, b.n, a.word, a.n from gaps a join words b on a.g.d = b.word
    ), best as (
      select word, n, count(*) as n_near, arg_min({{'w': near, 'n': near_n}}, {{'r': -near_n, 'w': near}}) as top from near group by word, n
    ), forms as (
      select word, n_near, case when top.n >= 2 * n then top.w end as form, case when top.n >= 2 * n then top.n end as form_n from best
    ), chain as (
      select word, word as at from words
      union all
      select chain.word, forms.form from chain join forms on chain.at = forms.word where forms.form is not null
    ), ends as (
      select chain.word, chain.at as root from chain left join forms on chain.at = forms.word where forms.form is null
    )
    select words.word, forms.form, ends.root, words.n, coalesce(forms.n_near, 0) as n_near, forms.form_n
    from words left join forms on words.word = forms.word left join ends on words.word = ends.word"""
