"""The user's own literals as a dimension table (label, value, category), small next to documents; ord keeps their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold

DEFAULT = "custom_identifier"
# Endings of labels of derived literals.
PART, BLOCK = " – Teil", " – Block"
EDGES = r"^[\s\p{P}]+|[\s\p{P}]+$"


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def useful(x: Column) -> Column:
    """At least five characters, or four digits."""
    return (F.length(x) >= 5) | (F.length(F.regexp_replace(x, r"[^\p{N}]", "")) >= 4)


def normalized(rows: DataFrame) -> DataFrame:
    """Trimmed rows; an empty category becomes the default, rows without label or value go."""
    category = _trim(F.coalesce("category", F.lit("")))
    made = rows.withColumns({"label": _trim(F.col("label")), "value": _trim(F.col("value")), "category": F.when(category == "", DEFAULT).otherwise(category)})
    return made.filter("label <> '' and value <> ''")


def expand(rows: DataFrame) -> DataFrame:
    """(ord, at, label, value, category): each literal, its parts between commas, semicolons or line ends, and all runs of two or more neighbouring parts."""
    base = normalized(rows)
    parts = F.filter(F.transform(F.split("value", "[,;\n]"), lambda p: F.regexp_replace(p, EDGES, "")), lambda p: (p != "") & useful(p))
    split = base.withColumn("_p", parts)
    n = F.size("_p")
    item = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    whole = F.array(item(F.col("label"), F.regexp_replace("value", EDGES, "")))
    single = F.transform("_p", lambda p: item(F.concat("label", F.lit(PART)), p))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(2), n - i + 1), lambda k: item(F.concat("label", F.lit(BLOCK)), F.array_join(F.slice("_p", i, k), " ")))))
    items = F.when(n > 1, F.concat(whole, single, runs)).otherwise(whole)
    out = split.select("ord", "category", F.posexplode(items).alias("at", "x")).select("ord", "at", F.col("x.label").alias("label"), F.col("x.value").alias("value"), "category").filter("value <> ''")
    key = W.partitionBy("ord", fold(F.col("label")), fold(F.col("value")), fold(F.col("category"))).orderBy("at")
    return out.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n")


def _key(side: str = "") -> list[Column]:
    return [fold(F.col(side + c)) for c in ("label", "value", "category")]


def preview(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """The expansion without what is there already."""
    there = existing.select(*[c.alias(f"k{i}") for i, c in enumerate(_key())]).distinct()
    made = expand(rows)
    own = _key()
    return made.join(there, (own[0] == there["k0"]) & (own[1] == there["k1"]) & (own[2] == there["k2"]), "left_anti")


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per folded category and value, at the place of the first: a label of the user's own rather than a derived one, without a dash, the shortest."""
    key = W.partitionBy(fold(_trim(F.col("category"))), fold(_trim(F.col("value"))))
    derived = F.contains("label", F.lit(PART)) | F.contains("label", F.lit(BLOCK))
    best = F.row_number().over(key.orderBy(derived, F.contains("label", F.lit(" – ")), F.length("label"), "ord"))
    return rows.withColumns({"_best": best, "_first": F.min("ord").over(key)}).filter("_best = 1").withColumn("ord", F.col("_first")).drop("_best", "_first")


def import_rows(existing: DataFrame, imported: DataFrame, replace_existing: bool = False) -> DataFrame:
    """The table after an import: the imported rows instead, or those that are new behind the others."""
    new = dedupe(normalized(imported))
    if replace_existing:
        return new
    there = existing.select(*[c.alias(f"k{i}") for i, c in enumerate(_key())])
    own = _key()
    fresh = new.join(there, (own[0] == there["k0"]) & (own[1] == there["k1"]) & (own[2] == there["k2"]), "left_anti")
    last = existing.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    return existing.unionByName(fresh.crossJoin(last).withColumn("ord", F.col("ord") + F.col("last") + 1).select(existing.columns))


def migrate(rows: DataFrame) -> DataFrame:
    """Rows of the user's own expanded, derived ones kept, all deduplicated."""
    derived = F.contains("label", F.lit(PART)) | F.contains("label", F.lit(BLOCK))
    wide = lambda df: df.select((F.col("ord") * 100_000 + F.col("at")).alias("ord"), "label", "value", "category")
    return dedupe(wide(expand(rows.filter(~derived))).unionByName(wide(rows.filter(derived).withColumn("at", F.lit(0)))))


def remove(rows: DataFrame, ids: list[int]) -> DataFrame:
    return rows.filter(~F.col("ord").isin(ids))
