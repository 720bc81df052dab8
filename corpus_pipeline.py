"""The corpus pipeline over ``documents``: quality, near-duplicates, secrets, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet and reads again as the next one's ``docs``. All but the last stage return the columns of ``documents``; other
columns are dropped. Rows with null or empty texts fail the first stage; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import bpe, mixing, neardup, quality, secret_scan
from opsloom.llm.queries import tokenizer
from opsloom.session import work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.apply_rules(docs.select(*COLUMNS), out="_quality").where("_quality.kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return neardup.first_of_class(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of secrets masked."""
    rows = secret_scan.scan_secrets(docs, keep=["doc_id", "lang", "source"], words=secret_scan.frequent_words(docs))
    return rows.withColumn("n_chars", F.char_length("masked").cast("long")).withColumnRenamed("masked", "text").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in shards of shuffled rows; a source's last one may be cut."""
    return mixing.mix(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit) of every row of the mix, with the digest of their decoded form."""
    return bpe.encode(docs, tokenizer("word_bpe_49k.json"), keep=["doc_id", "source", "lang"],
                      outputs=["n_tokens", "ids", "decoded_sha256"])


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scans", secrets),
          ("source mixing", source_mix), ("bpe tokens", tokens)]

#: Near-duplicate classes, guess costs, hypergeometric draws and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is a written table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = work_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
