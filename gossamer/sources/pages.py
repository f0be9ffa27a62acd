"""Sources and sinks: page texts, recognised lines, rules, literals, redacted copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import choose_text
from ..operators import custom

PAGES = "doc_id string, page_index int, text string"
OCR_LINES = "doc_id string, page_index int, line_no int, text string, box struct<x:double,y:double,w:double,h:double>"
CUSTOM = "id string, label string, value string, category string"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, form feeds dividing pages: (doc_id, page_index, text)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")
    return files.select("doc_id", F.posexplode(F.split("value", "\f")).alias("page_index", "text"))


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(path) if format == "parquet" else spark.read.format(format).schema(PAGES).load(path)


def read_ocr_lines(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Lines that some recognition has written, with boxes."""
    return spark.read.format(format).schema(OCR_LINES).load(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with their kind, for an extraction outside the engine."""
    from ..operators.review import file_kind

    return spark.read.format("binaryFile").load(path).withColumn("kind", file_kind(F.col("path"))).filter("kind is not null")


def page_texts(native: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_index, text, text_source) of pages with any text: the page's own, or the recognised one where that looks better."""
    keys = ["doc_id", "page_index"]
    both = native.select(*keys, F.col("text").alias("_own"))
    both = both.join(recognised.select(*keys, F.col("text").alias("_seen")), keys, "full") if recognised is not None else both.withColumn("_seen", F.lit(None).cast("string"))
    chosen = both.withColumn("_c", choose_text(F.coalesce("_own", F.lit("")), F.coalesce("_seen", F.lit(""))))
    return chosen.filter("_c is not null").select(*keys, F.col("_c.text").alias("text"), F.col("_c.source").alias("text_source"))


def clipboard(texts: DataFrame) -> DataFrame:
    """Trimmed texts with an error for those that hold nothing."""
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    return texts.withColumn("text", trimmed).withColumn("error", F.when(F.col("text") == "", "empty"))


def read_custom(spark: SparkSession, path: str) -> DataFrame:
    """(ord, label, value, category) of a JSON array of literals."""
    rows = spark.read.option("multiLine", True).schema(CUSTOM).json(path)
    return custom.normalized(rows.withColumn("ord", F.monotonically_increasing_id()).select("ord", "label", "value", "category"))


def write_custom(rows: DataFrame, path: str) -> None:
    """Literals as JSON rows in one file; the table is a user's own list."""
    rows.orderBy("ord").select(F.col("ord").cast("string").alias("id"), "label", "value", "category").coalesce(1).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    return P.load_rules(spark, path) if path else P.catalogue(spark)


def write_redacted(anonymized: DataFrame, path: str, remove_metadata: bool = True, keep: tuple[str, ...] = ()) -> None:
    """Anonymised texts; of other columns only ``keep`` stay unless metadata may stay."""
    columns = ("doc_id", *keep) if remove_metadata else tuple(c for c in anonymized.columns if c not in ("text", "anonymized_text", "placeholders"))
    anonymized.select(*columns, F.col("anonymized_text").alias("text")).write.mode("overwrite").parquet(path)
