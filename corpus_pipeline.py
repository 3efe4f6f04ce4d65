"""The corpus pipeline: language identification, near-duplicate removal, decontamination, redaction, BPE encoding.

Each stage works on what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, op2_near_dedup, op3_pii, op5_decontaminate, op8_bpe, op9_langid

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, empty, or no letter) go; ``lang`` becomes the language found."""
    net = op9_langid.fit(docs, op9_langid.learnable())
    found = op9_langid.predict(docs.select(*COLUMNS), net).where(F.col("lang_pred") != op9_langid.UND)
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id, ids before no id, then by a hash of id and text.

    Rows are told apart by id and text, so an id that names several texts loses only those that are copies of others. Rows
    without words are linked with nothing and stay; of repeated rows (same id and text) one stays.
    """
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.coalesce("text", F.lit(""))))
    own = docs.select(*COLUMNS, row.alias("row"))
    with common.scratch(spark):
        found = op2_near_dedup.linked(own.select("doc_id", "text", "row"), also=["row"]).where("kept")
        stay = found.groupBy(F.coalesce(F.col("label").cast("string"), F.col("row"))).agg(F.min("row").alias("row")).select("row")
        stay = common.materialise(stay, "stay", result=True)
    return own.dropDuplicates(["row"]).join(stay, "row", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item within its error budget go."""
    return op5_decontaminate.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the new text."""
    found = op3_pii.candidates(docs)
    model, limits = op3_pii.fit(found)
    # spans are found again in the row that they are cut from, so no join by id is needed
    own = docs.select("doc_id", "lang", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("whole", F.struct(*own.columns)).withColumn("doc_id", F.col("whole"))
    spans = op3_pii.spans(op3_pii.candidates(own), model, limits).select(F.col("doc_id").alias("row"), F.col("all").alias("found"))
    clean = spans.select("row.doc_id", op3_pii.redact(F.col("row.text"), F.col("found")).alias("text"), "row.lang", "row.source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of what they decode to."""
    path = op8_bpe.tokenizer_path()
    both = op8_bpe.decode(op8_bpe.encode(docs.select("doc_id", "text"), path), path)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", language),
    ("near-duplicate removal", near_duplicates),
    ("decontamination", decontaminated),
    ("redaction", redacted),
    ("BPE encoding", encoded),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and reread; what stages write on the way is deleted."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark):
        for i, (_, stage) in enumerate(STAGES):
            path = common.new_path(spark, f"stage{i}", result=i + 1 == len(STAGES))
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    return docs
