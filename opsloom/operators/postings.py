"""A stored inverted index: postings by term and document bucket, with document frequencies."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.search import inverted_index

#: Text whose postings one task makes distinct.
TASK_BYTES = 8 << 20


class Postings:
    """Written once, searched often.

    Rows ``(term, doc)`` lie in one folder per term bucket; inside it they are bucketed by document and sorted by term. A
    search opens the folders of its terms alone, and the lists of all terms share the document buckets, so they intersect
    without a shuffle, the rarest term's list first. A frequent term is spread over all document buckets.
    """

    def __init__(self, spark: SparkSession, path: str, doc: str, term_buckets: int) -> None:
        self.spark, self.path, self.doc, self.term_buckets = spark, path.rstrip("/"), doc, term_buckets
        self.table = _table(self.path)

    @staticmethod
    def write(docs: DataFrame, doc: str, text: str, path: str, term_buckets: int = 64, doc_buckets: int = 8) -> Postings:
        """Index every word of every text; null and empty texts and null ids have no postings, repeated rows no second one."""
        path = path.rstrip("/")
        index = Postings(docs.sparkSession, path, doc, term_buckets)
        # A task holds the rows of so much text, however many and whatever their terms; no more than one figure comes here.
        known = docs.where(F.col(doc).isNotNull())
        tasks = max(1, -(-(known.agg(F.sum(F.octet_length(text))).first()[0] or 0) // TASK_BYTES))
        rows = inverted_index(known, doc, text).repartition(tasks, "term", doc).distinct().withColumn("bucket", _bucket(F.col("term"), term_buckets))
        # Rows of a folder's document bucket meet in one task; those of a frequent term are dealt to several.
        cell = rows.withColumn("_part", _bucket(F.col(doc), doc_buckets)).hint("rebalance", "bucket", "_part").drop("_part")
        (cell.write.partitionBy("bucket").bucketBy(doc_buckets, doc).sortBy("term", doc)
         .option("path", f"{path}/postings").saveAsTable(index.table))
        counted = index.postings().groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("docs"))
        counted.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms")
        kind = docs.schema[doc].dataType.simpleString()
        about = docs.sparkSession.range(1).select(F.lit(doc).alias("doc"), F.lit(kind).alias("kind"), F.lit(term_buckets).alias("term_buckets"),
                                                  F.lit(doc_buckets).alias("doc_buckets"))
        about.coalesce(1).write.parquet(f"{path}/about")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> Postings:
        """An index written before, by this session or another."""
        path = path.rstrip("/")
        about = spark.read.parquet(f"{path}/about").first()
        index = Postings(spark, path, about["doc"], about["term_buckets"])
        if not spark.catalog.tableExists(index.table):
            spark.sql(f"CREATE TABLE {index.table} (term STRING, `{about['doc']}` {about['kind']}, bucket INT) USING parquet PARTITIONED BY (bucket) "
                      f"CLUSTERED BY (`{about['doc']}`) SORTED BY (term, `{about['doc']}`) INTO {about['doc_buckets']} BUCKETS LOCATION '{path}/postings'")
            spark.sql(f"MSCK REPAIR TABLE {index.table}")
        return index

    def postings(self) -> DataFrame:
        return self.spark.table(self.table)

    def frequencies(self) -> DataFrame:
        """``bucket, term, docs``: in how many documents each term stands."""
        return self.spark.read.schema("term string, docs bigint, bucket int").parquet(f"{self.path}/terms")

    def search(self, terms: Sequence[str]) -> DataFrame:
        """Ids of the documents that hold every term. One frequency per term comes to the driver."""
        wanted = sorted({t.lower() for t in terms})
        if not wanted:
            raise ValueError("a search needs a term")
        here = lambda t: (F.col("bucket") == _bucket(F.lit(t), self.term_buckets)) & (F.col("term") == t)
        found = self.frequencies().where(reduce(Column.__or__, map(here, wanted))).select("docs", "term").collect()
        order = [r["term"] for r in sorted(found)] if len(found) == len(wanted) else []
        if not order:
            return self.postings().where(F.lit(False)).select(self.doc)
        lists = [self.postings().where(here(t)).select(self.doc) for t in order]
        return reduce(lambda kept, more: kept.join(more, self.doc, "left_semi"), lists)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def _table(path: str) -> str:
    return "postings_" + hashlib.md5(path.encode()).hexdigest()[:12]
