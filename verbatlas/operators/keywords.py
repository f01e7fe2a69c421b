"""Most frequent terms of each text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def exploded_terms(rows: DataFrame, keys: list[str], text: str, order: str | None = None, stopwords: Iterable[str] = L.STOPWORDS) -> DataFrame:
    """(keys, at, term): every term of every row; at orders a key's terms by row (order) and place in it."""
    at = F.struct((F.col(order) if order else F.lit(0)).alias("row"), F.col("pos"))
    found = rows.select(*keys, *([order] if order else []), F.posexplode(T.terms(F.col(text))).alias("pos", "term"))
    return found.select(*keys, at.alias("at"), "term").where(T.is_term(F.col("term"), stopwords))


def keywords(rows: DataFrame, keys: list[str], text: str, limit: int = 25, *, order: str | None = None, stopwords: Iterable[str] = L.STOPWORDS) -> DataFrame:
    """(keys, rank, term, n): the `limit` most frequent terms of a key; equal counts go by first place.

    Several rows of a key are read in the order of `order`. Null and empty texts have no terms.
    """
    counted = exploded_terms(rows, keys, text, order, stopwords).groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first", "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).select(*keys, "rank", "term", "n")


def corpus_keywords(rows: DataFrame, text: str, limit: int = 25, stopwords: Iterable[str] = L.STOPWORDS) -> DataFrame:
    """(term, n) over all rows, equal counts by name."""
    return exploded_terms(rows, [], text, None, stopwords).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)
