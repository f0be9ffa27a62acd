"""Algebra of spans: clean, drop, recategorise, deduplicate, merge, contain, select.

Spans are rows (doc_id, ord, category, text, start, end, confidence, source) and
perhaps page_index and pattern; ord is the order of arrival, which ties go by. Where texts
share a page, spans may have a column ``arrival``, their text's place, for those of one ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as is_
from ..functions.text import BLOCK, clean_span, comparable, fold, let

PAGE = ("doc_id",)
#: Characters of a stretch by which spans of one text meet.
CELL = 1024


def drop_reason(category: Column, text: Column, source: Column, run=is_.as_is) -> Column:
    """Why a span is dropped, the first reason that holds; null if it stays. ``run`` makes the expression that runs of a rule's."""
    model = source == "model"
    headed = is_.noise(text) | is_.tax_header(text)
    digits = F.length(F.regexp_replace(text, r"\D+", ""))
    person, address, account = (category == c for c in ("private_person", "private_address", "account_number"))
    return (
        F.when(text == "", "empty")
        .when(person & headed, "noise")
        .when(person & is_.organization(text, run), "organization")
        .when(person & is_.contact_tail(text, run), "contact_tail")
        .when(person & model & (F.length(text) <= 4) & ~is_.nameish(text), "short")
        .when(person & model & text.rlike(r"\p{Nd}") & ~F.contains(text, F.lit(" ")), "digits")
        .when(address & headed, "noise")
        .when(address & is_.company_block(text, run), "company_block")
        .when(address & is_.honorific_street(text, run), "honorific_street")
        .when(address & (is_.postal_city(text, run) | is_.street(text, run) | is_.address_block(text, run)), None)
        .when(address & (source == "pattern"), "no_address_shape")
        .when(address & (F.length(text) < 8), "short")
        .when(account & model & (is_.postal_city(text, run) | is_.street(text, run) | is_.tax_header(text)), "address_shape")
        .when(account & model & ~text.rlike(r"\p{L}") & (digits < 12), "few_digits")
    )


def judged(spans: DataFrame, run=is_.as_is) -> DataFrame:
    """Spans with cleaned text, the reason to drop them and the category they end in."""
    cleaned = spans.withColumn("text", clean_span(F.col("text")))
    # The rules in generated code would be over the compiler's limit and keep the whole stage from being compiled.
    reason = let(F.struct(F.col("category").alias("c"), F.col("text").alias("t"), F.col("source").alias("s")), lambda x: drop_reason(x["c"], x["t"], x["s"], run))
    return cleaned.withColumn("drop_reason", reason).withColumn("category", let(F.struct(F.col("text").alias("t"), F.col("category").alias("c")), lambda x: F.when((x["c"] == "account_number") & is_.postal_city(x["t"], run), "private_address").otherwise(x["c"])))


def sanitize(spans: DataFrame, run=is_.as_is) -> DataFrame:
    return judged(spans, run).filter("drop_reason is null").drop("drop_reason")


def _order(spans: DataFrame) -> list[str]:
    return [c for c in ("ord", "arrival") if c in spans.columns]


def dedupe_exact(spans: DataFrame, page=PAGE) -> DataFrame:
    """Of spans alike in category, source, place and folded text the most confident stays, at the place of the first."""
    key = W.partitionBy(*page, "category", "source", "start", "end", fold(F.col("text")))
    best = F.row_number().over(key.orderBy(F.desc("confidence"), *_order(spans)))
    return spans.withColumns({"_best": best, "_first": F.min("ord").over(key)}).filter("_best = 1").withColumn("ord", F.col("_first")).drop("_best", "_first")


def rank(category: Column, source: Column, confidence: Column) -> Column:
    by_source = F.when(source == "model", 30).when(source == "mixed", 20).otherwise(10)
    return F.when(category != "custom_identifier", 100).otherwise(0) + by_source + F.floor(confidence * 10).cast("int")


def merge_equivalent(spans: DataFrame, page=PAGE) -> DataFrame:
    """Spans of one place and folded text become one: that of the highest rank, with all sources and the highest confidence."""
    extra = [c for c in spans.columns if c not in (*page, "start", "end")]
    best = F.max_by(F.struct(*extra), F.struct(rank(F.col("category"), F.col("source"), F.col("confidence")).alias("r"), (-F.col("ord")).alias("o")))
    mixed = (F.count_distinct("source") > 1) | F.bool_or(F.col("source") == "mixed")
    grouped = spans.groupBy(*page, "start", "end", fold(F.col("text")).alias("_folded")).agg(best.alias("_b"), F.max("confidence").alias("_conf"), mixed.alias("_mixed"), F.min("ord").alias("_ord"))
    out = {"confidence": F.col("_conf"), "source": F.when(F.col("_mixed"), "mixed").otherwise(F.col("_b.source")), "ord": F.col("_ord")}
    return grouped.select(*page, "start", "end", *[out.get(c, F.col(f"_b.{c}")).alias(c) for c in extra]).select(spans.columns)


def suppress_contained(spans: DataFrame, page=PAGE) -> DataFrame:
    """Drop a custom literal's span that a longer one contains, or overlaps by three quarters if that one is of another kind or has its text.

    Either way the longer one covers the shorter one's middle, so the two meet by page
    and the stretch of the text (``CELL`` characters) that holds it. Spans without
    places, empty or inverse ones drop nothing.
    """
    mine = spans.filter("category = 'custom_identifier'").withColumn("_cell", F.floor((F.col("start") + F.col("end")) / (2 * CELL)))
    reach = F.sequence(F.floor(F.col("start") / CELL), F.floor(F.col("end") / CELL))
    other = spans.filter(F.col("end") > F.col("start")).select(*[F.col(p).alias(f"o_{p}") for p in page], *[F.col(c).alias(f"o_{c}") for c in ("start", "end", "category", "text")], F.explode(reach).alias("o_cell"))
    size = lambda p="": F.col(f"{p}end") - F.col(f"{p}start")
    shared = F.least("end", "o_end") - F.greatest("start", "o_start")
    contains = (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end"))
    most = (shared / F.greatest(size(), F.lit(1)) >= 0.75) & ((F.col("o_category") != "custom_identifier") | F.contains(comparable(F.col("o_text")), comparable(F.col("text"))))
    same_page = F.col("_cell") == F.col("o_cell")
    for p in page:
        same_page = same_page & F.col(p).eqNullSafe(F.col(f"o_{p}"))
    kept = mine.join(other, same_page & (size("o_") > size()) & (contains | most), "left_anti").drop("_cell")
    return spans.filter("category <> 'custom_identifier' or category is null").unionByName(kept)


def post_process(spans: DataFrame, page=PAGE) -> DataFrame:
    """Model and pattern spans to findings. ``ord`` of model spans should come first."""
    return suppress_contained(merge_equivalent(dedupe_exact(sanitize(spans), page), page), page)


def select_disjoint(found: Column) -> Column:
    """Of an array of structs (start, end, confidence, ...) those that a pass by start, length and confidence takes without overlap."""
    ordered = F.array_sort(F.filter(F.transform(found, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["confidence"]).alias("c"), s.alias("s"))), lambda x: x["s"]["end"] > x["s"]["start"]))
    none = F.filter(found, lambda s: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        free = x["s"]["start"] >= acc["last"]
        return F.when(free, F.struct(F.concat(acc["taken"], F.array(x["s"])).alias("taken"), x["s"]["end"].alias("last"))).otherwise(acc)

    def block(acc: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(none.alias("taken"), acc["last"].alias("last")), step)
        return let(made, lambda m: F.struct(F.concat(acc["parts"], F.array(m["taken"])).alias("parts"), m["last"].alias("last")))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(F.filter(F.array(none), lambda s: F.lit(False)).alias("parts"), F.lit(-1).alias("last")), block, lambda a: F.flatten(a["parts"]))

    return let(ordered, whole)


def non_overlapping(spans: DataFrame, page=PAGE) -> DataFrame:
    """Rows of the disjoint selection; the spans of one page meet in one row."""
    columns = [c for c in spans.columns if c not in page]
    first = ["start", "end", "confidence", *_order(spans)]
    put = F.struct(*first, *[c for c in columns if c not in first])
    lists = spans.groupBy(*page).agg(F.collect_list(put).alias("_s")).select(*page, F.explode(select_disjoint(F.col("_s"))).alias("_x"))
    return lists.select(*page, *[F.col(f"_x.{c}").alias(c) for c in columns]).select(spans.columns)
