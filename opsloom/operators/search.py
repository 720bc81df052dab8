"""Text, tag, geo and vector search as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import first_n
from opsloom.functions.patterns import every

EARTH_KM = 6371.0088


def tokens(text: str) -> Column:
    """Lower-case words of the whole text."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def inverted_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Distinct ``(term, doc)`` rows; duplicates inside one document fall away before the shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("term"), doc)


def text_search(docs: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Documents that hold every term: one scan, no shuffle.

    The cheap substring test comes first, so only candidates are split into words.
    """
    wanted = [t.lower() for t in terms]
    candidates = every([F.lower(F.col(text)).contains(t) for t in wanted])
    missing = F.array_except(F.array(*[F.lit(t) for t in wanted]), tokens(text))
    return docs.where(candidates & (F.size(missing) == 0))


def index_search(index: DataFrame, doc: str, terms: Sequence[str]) -> DataFrame:
    """The same on a stored index: only the posting rows of the terms are read."""
    wanted = sorted({t.lower() for t in terms})
    counted = index.where(F.col("term").isin(wanted)).groupBy(doc).agg(F.count_distinct("term").alias("_terms"))
    return counted.where(F.col("_terms") == len(wanted)).select(doc)


def tag_search(df: DataFrame, tags: str, wanted: Sequence[str], any_of: bool = True) -> DataFrame:
    values = F.array(*[F.lit(w) for w in wanted])
    hit = F.arrays_overlap(tags, values) if any_of else F.size(F.array_except(values, F.col(tags))) == 0
    return df.where(hit)


def suggest(df: DataFrame, term: str, prefix: str, n: int) -> DataFrame:
    """Most frequent terms that begin with ``prefix``."""
    counted = df.where(F.col(term).startswith(prefix)).groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), term).limit(n)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def geo_radius(df: DataFrame, lon: str, lat: str, centre: tuple[float, float], km: float) -> DataFrame:
    """Members within ``km`` with their distance; a latitude band prunes before the exact test."""
    lon0, lat0 = centre
    band = km / 111.0 + 0.01
    near = df.where(F.col(lat).between(lat0 - band, lat0 + band))
    distance = haversine_km(F.lit(lon0), F.lit(lat0), F.col(lon), F.col(lat))
    return near.withColumn("km", distance).where(F.col("km") <= km)


def knn(vectors: DataFrame, row_id: str, embedding: str, queries: DataFrame, k: int, query_block: int = 2_048,
        vector_block: int = 16_384) -> DataFrame:
    """Exact ``k`` nearest by cosine for ``queries(query_id, vector)``, however many.

    Blocks of queries meet blocks of vectors; a task holds one of each and gives its own k best per query. Zero and null
    vectors have no direction and take no part. Returns ``(query_id, rank, row_id, cosine)``; equal cosines rank by row id.
    """
    directed = lambda c: F.exists(c, lambda x: x != 0)
    asked, known = queries.where(directed("vector")), vectors.select(row_id, embedding).where(directed(embedding))
    blocks = lambda df, size: df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size))).scalar()
    asked_blocks, known_blocks = blocks(asked, query_block), blocks(known, vector_block)
    repeated = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    left = known.withColumn("_v", F.pmod(F.xxhash64(row_id), known_blocks)).withColumn("_q", repeated(asked_blocks))
    right = (asked.select("query_id", "vector").withColumn("_q", F.pmod(F.xxhash64("query_id"), asked_blocks))
             .withColumn("_v", repeated(known_blocks)))

    def units(column: pd.Series) -> np.ndarray:
        found = np.stack(column.to_numpy()).astype(np.float64)
        return found / np.linalg.norm(found, axis=1, keepdims=True)

    def best(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if block.empty or some.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), row_id: pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        points, ids = units(block[embedding]), block[row_id].to_numpy()
        parts = []
        for at in range(0, len(some), 256):
            names = some["query_id"].to_numpy()[at:at + 256]
            scores = (units(some["vector"].iloc[at:at + 256]) @ points.T).round(9)
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
            parts.append(pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), row_id: ids[order].ravel(),
                                       "cosine": np.take_along_axis(scores, order, 1).ravel()}))
        return pd.concat(parts)

    local = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(best, f"query_id bigint, {row_id} bigint, cosine double")
    return first_n(local, ["query_id"], [F.desc("cosine"), F.asc(row_id)], k, F.col(row_id), out="rank")
