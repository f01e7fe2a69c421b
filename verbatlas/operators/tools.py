"""Tools that texts name: those of a catalogue, and unknown ones by the shape of their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

RUN = r"[\p{L}\p{N}_.-]+"

# Shapes of names that may be a tool's, in the order that equal counts go by. Their edges are those of
# words in any script, written out because \b means ASCII words in some Java versions.
SHAPES = tuple(rf"(?<![\p{{L}}\p{{N}}_])(?:{x})(?![\p{{L}}\p{{N}}_])" for x in (r"[a-zA-Z][a-zA-Z0-9]*(?:[.-][a-zA-Z0-9]+)+", r"[A-Z]{2,8}", r"[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+"))


def catalog_aliases(catalog: DataFrame) -> DataFrame:
    """(alias, name, description, category) in lower case, a name being an alias of itself; of a name in the
    catalogue twice the last by description counts."""
    latest = catalog.where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.max(F.struct("description", "category", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).alias("x"))
    each = latest.select("name", "x.description", "x.category", F.explode(F.array_append(F.transform("x.aliases", F.lower), F.col("name"))).alias("alias"))
    return each.where("alias <> ''").groupBy("alias").agg(F.min(F.struct("name", "description", "category")).alias("x")).select("alias", "x.*")


def known_tools(rows: DataFrame, keys: list[str], text: str, catalog: DataFrame) -> DataFrame:
    """(keys, name, n, description, category) of the catalogue's tools in each key's texts.

    A name counts where a whole run of letters, digits, _ . - equals it or an alias: an equi-join
    instead of a pattern per alias.
    """
    runs = rows.select(*keys, F.explode(T.all_matches(F.lower(text), RUN)).alias("alias")).groupBy(*keys, "alias").agg(F.count("*").alias("n"))
    return runs.join(catalog_aliases(catalog), "alias").groupBy(*keys, "name", "description", "category").agg(F.sum("n").alias("n")).select(*keys, "name", "n", "description", "category")


def unknown_tools(rows: DataFrame, keys: list[str], text: str, known: DataFrame | None = None, limit: int = 8, *, order: str | None = None, stopwords: Iterable[str] = L.STOPWORDS, excluded: Iterable[str] = (), least: int = 2) -> DataFrame:
    """(keys, name, n): names of a tool's shape at least `least` times in a key's texts, neither known (name), stopwords, excluded
    nor ignored; the `limit` most frequent, equal counts by shape and first place."""
    found = None
    for k, shape in enumerate(SHAPES):
        place = F.struct(F.lit(k).alias("shape"), (F.col(order) if order else F.lit(0)).alias("row"), F.col("pos"))
        one = rows.select(*keys, *([order] if order else []), F.posexplode(T.all_matches(F.col(text), shape)).alias("pos", "name")).select(*keys, "name", place.alias("at"))
        found = one if found is None else found.unionByName(one)
    counted = found.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min("at").alias("first")).where(F.col("n") >= least)
    plain = F.btrim(F.lower("name"), F.lit(".-"))
    counted = counted.where(~plain.isin(*sorted({*stopwords, *excluded})) & ~F.col("name").isin(*L.IGNORED_CANDIDATES))
    if known is not None:
        counted = counted.withColumn("_plain", plain).join(known.select(F.lower("name").alias("_plain")).distinct(), "_plain", "left_anti").drop("_plain")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first") if keys else W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).select(*keys, "name", "n", "rank")


def tool_mentions(rows: DataFrame, keys: list[str], text: str, catalog: DataFrame, *, order: str | None = None, excluded: Iterable[str] = ()) -> DataFrame:
    """(keys, rank, name, n, description, category, kind): known tools first, then by count and name."""
    known = known_tools(rows, keys, text, catalog).withColumn("kind", F.lit("known"))
    unknown = unknown_tools(rows, keys, text, catalog, order=order, excluded=excluded)
    unknown = unknown.select(*keys, "name", "n", F.lit("Posible herramienta o nombre propio detectado heurísticamente.").alias("description"), F.lit("candidate").alias("category"), F.lit("unknown").alias("kind"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("kind") != "known", F.desc("n"), "name"))
    return known.unionByName(unknown).withColumn("rank", rank).select(*keys, "rank", "name", "n", "description", "category", "kind")
