"""The library index: validated entries, upsert, rebuild, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "title", "channel", "duration", "url", "path", "tools")
ENTRY = "id string, title string, channel string, duration double, url string, path string, tools array<string>, created_at string, updated_at string"


def kind_of(v: Column, path: str) -> Column:
    """The JSON type at path: STRING, BIGINT, DOUBLE, DECIMAL..., BOOLEAN, ARRAY..., OBJECT..., VOID, or null if absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def validated(entries: DataFrame, value: str = "value") -> DataFrame:
    """Adds valid entries' fields and reason, null for a valid one. Types are checked as they stand in the JSON: a number is no text,
    a truth value no number. value holds one entry as JSON text; order and other columns stay."""
    df = entries.withColumn("v", F.try_parse_json(F.col(value)))
    v = F.col("v")
    kind = lambda f: kind_of(v, f"$.{f}")
    none = lambda f: kind(f).isNull() | (kind(f) == "VOID")
    filled = lambda f: F.coalesce((kind(f) == "STRING") & (_text(v, f) != ""), F.lit(False))
    number = F.coalesce(kind("duration").rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(v, "$.duration", "double") >= 0), F.lit(False))
    tools = F.try_variant_get(v, "$.tools", "array<variant>")
    sound = kind("tools").isNull() | F.coalesce(kind("tools").startswith("ARRAY") & F.forall(tools, lambda t: F.coalesce((F.schema_of_variant(t) == "STRING") & (F.try_variant_get(t, "$", "string") != ""), F.lit(False))), F.lit(False))
    checks = [
        (~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "debe ser un objeto"),
        (~filled("id"), "'id' debe ser texto no vacío"), (~filled("path"), "'path' debe ser texto no vacío"), (kind("title").isNotNull() & ~filled("title"), "'title' debe ser texto no vacío"),
        *((~none(f) & (kind(f) != "STRING"), f"'{f}' debe ser texto o null") for f in ("channel", "url")),
        (~none("duration") & ~number, "'duration' debe ser un número no negativo o null"), (~sound, "'tools' debe ser una lista de textos no vacíos"),
        *((kind(f).isNotNull() & ~filled(f), f"'{f}' debe ser texto no vacío") for f in ("created_at", "updated_at")),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks])
    fields = [_text(v, "id").alias("id"), F.coalesce(_text(v, "title"), _text(v, "id")).alias("title"), _text(v, "channel").alias("channel"), F.try_variant_get(v, "$.duration", "double").alias("duration"), _text(v, "url").alias("url"), _text(v, "path").alias("path")]
    fields += [F.coalesce(F.transform(tools, lambda t: F.try_variant_get(t, "$", "string")), F.array().cast("array<string>")).alias("tools"), _text(v, "created_at").alias("created_at"), _text(v, "updated_at").alias("updated_at")]
    rest = [c for c in entries.columns if c not in {value, "reason", *FIELDS, "created_at", "updated_at"}]
    return df.select(*rest, value, reason.alias("reason"), *fields)


def by_update() -> list[Column]:
    """The order of an index: the last updated first, null last, equal ones by id."""
    return [F.desc(F.coalesce("updated_at", F.lit(""))), F.col("id")]


def ordered(entries: DataFrame) -> DataFrame:
    return entries.orderBy(*by_update())


def same_content(a: str, b: str) -> Column:
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return same


def upsert(library: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The library (one row per id) with changes (FIELDS) in place of entries of the same id: created_at is kept, or now; updated_at is now.
    Of an id changed twice the greatest path counts."""
    new = changes.groupBy("id").agg(F.max(F.struct("path", *[f for f in FIELDS if f not in ("id", "path")])).alias("x")).select("id", "x.*")
    joined = library.alias("o").join(new.withColumn("is_new", F.lit(True)).alias("n"), "id", "full_outer")
    changed = F.coalesce("n.is_new", F.lit(False))
    pick = lambda f: F.when(changed, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f)
    return joined.select("id", *[pick(f) for f in FIELDS if f != "id"], F.when(changed, F.coalesce("o.created_at", F.lit(now))).otherwise(F.col("o.created_at")).alias("created_at"), F.when(changed, F.lit(now)).otherwise(F.col("o.updated_at")).alias("updated_at"))


def rebuilt(found: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """Entries of the videos found (FIELDS; tools null where no list of tools could be read): tools then stay as they were, created_at stays,
    and updated_at too unless something changed."""
    old = previous.groupBy("id").agg(F.max_by(F.struct(*[F.col(f) for f in (*FIELDS, "created_at", "updated_at") if f != "id"]), F.coalesce("updated_at", F.lit(""))).alias("p"))
    old = old.select(F.col("id").alias("pid"), "p.*").withColumnRenamed("pid", "id").alias("o")
    new = found.alias("n").join(old, F.col("n.id") == F.col("o.id"), "left")
    tools = F.coalesce("n.tools", "o.tools", F.array().cast("array<string>"))
    same = F.col("o.id").isNotNull()
    for f in FIELDS:
        same = same & (tools if f == "tools" else F.col(f"n.{f}")).eqNullSafe(F.col(f"o.{f}"))
    return new.select(*[F.col(f"n.{f}") for f in FIELDS if f != "tools"], tools.alias("tools"), F.coalesce("o.created_at", F.lit(now)).alias("created_at"), F.when(same, F.coalesce("o.updated_at", F.lit(now))).otherwise(F.lit(now)).alias("updated_at"))


def latest(versions: DataFrame) -> DataFrame:
    """One row per id of many versions: the last updated, as an instant, null being earliest."""
    at = F.coalesce(F.unix_micros(F.col("updated_at").try_cast("timestamp")), F.lit(-(2**62)))
    rest = F.struct(*[F.col(c) for c in ("path", "title", "channel", "duration", "url", "tools", "created_at", "updated_at")])
    return versions.where("id is not null").groupBy("id").agg(F.max(F.struct(at.alias("at"), rest.alias("r"))).alias("x")).select("id", "x.r.*")
