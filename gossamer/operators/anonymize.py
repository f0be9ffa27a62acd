"""Placeholders for spans, and their way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, let, running_sums
from . import extract, layout, spans as algebra

# A category's placeholder name.
BASES = {
    "private_person": "NAME",
    "private_address": "ADRESSE",
    "private_date": "DATUM",
    "private_email": "EMAIL",
    "private_phone": "TELEFON",
    "account_number": "NUMMER",
    "secret": "GEHEIM",
    "custom_identifier": "PLATZHALTER",
}


def placeholder_base(category: Column) -> Column:
    """The name for a category; one that isn't known is made of its letters and digits."""
    made = F.regexp_replace(F.replace(F.upper(fold(category)), F.lit("PRIVATE_"), F.lit("")), "[^A-Z0-9]+", "_")
    made = F.regexp_replace(made, "^_+|_+$", "")
    out = F.when(F.lit(False), "")
    for name, base in BASES.items():
        out = out.when(category == name, base)
    return out.otherwise(F.when(made == "", "PII").otherwise(made))


def number_placeholders(selected: DataFrame, page=("doc_id",)) -> DataFrame:
    """Selected spans with base and placeholder: equal values share one, and numbers count from the end of the text."""
    keyed = selected.withColumn("base", placeholder_base(F.col("category"))).withColumn("_key", fold(F.trim("text")))
    last = W.partitionBy(*page, "base", "_key")
    seen = keyed.withColumn("_last", F.max(F.struct("start", "end")).over(last))
    number = F.dense_rank().over(W.partitionBy(*page, "base").orderBy(F.desc("_last")))
    return seen.withColumn("placeholder", F.concat(F.lit("["), "base", F.lit("_"), number.cast("string"), F.lit("]"))).drop("_key", "_last")


def substitute(text: Column, found: Column) -> Column:
    """The text with each struct (start, end, placeholder) of a disjoint, ordered array put in place; a range beyond the text is left out."""

    def step(acc: Column, s: Column) -> Column:
        inside = (s["start"] >= acc["at"]) & (s["end"] <= F.length(text))
        put = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), s["placeholder"])
        return F.when(inside, F.struct(put.alias("out"), s["end"].alias("at"))).otherwise(acc)

    return F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def placeholder_mapping(selected: DataFrame, page=("doc_id",)) -> DataFrame:
    """(page..., placeholder, original): the text of the last occurrence."""
    numbered = number_placeholders(selected, page)
    return numbered.groupBy(*page, "placeholder").agg(F.max_by("text", F.struct("start", "end")).alias("original"))


def places_after(text: Column, found: Column) -> Column:
    """Where ``substitute`` has put the placeholders: array<struct(start, end, placeholder)> of the new text."""

    def moved(inside: Column) -> Column:
        before = running_sums(F.transform(inside, lambda s: F.length(s["placeholder"]) - (s["end"] - s["start"])))
        return F.zip_with(inside, before, lambda s, n: F.struct((s["start"] + n).alias("start"), (s["start"] + n + F.length(s["placeholder"])).alias("end"), s["placeholder"].alias("placeholder")))

    return let(F.filter(found, lambda s: s["end"] <= F.length(text)), moved)


def anonymize(docs: DataFrame, selected: DataFrame, places: bool = False) -> DataFrame:
    """Rows of docs (doc_id, text) with anonymized_text, replacement_count and the map placeholders, on demand also the ``places`` of these."""
    numbered = number_placeholders(selected)
    lists = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder", "text"))).alias("_s"), F.count("*").alias("replacement_count"))
    joined = docs.join(lists, "doc_id", "left")
    # Of the mentions of one placeholder the last gives the original.
    last = F.filter("_s", lambda x, i: ~F.exists(F.slice("_s", i + 2, F.size("_s")), lambda y: y["placeholder"] == x["placeholder"]))
    originals = F.map_from_entries(F.transform(last, lambda x: F.struct(x["placeholder"].alias("key"), x["text"].alias("value"))))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    put = F.when(F.col("_s").isNull(), F.col("text")).otherwise(substitute(F.col("text"), F.col("_s")))
    out = {"anonymized_text": put, "replacement_count": F.coalesce("replacement_count", F.lit(0)).cast("long"), "placeholders": F.coalesce(originals, nothing)}
    if places:
        out["places"] = F.coalesce(places_after(F.col("text"), F.col("_s")), F.array().cast("array<struct<start:int,end:int,placeholder:string>>"))
    return joined.withColumns(out).drop("_s")


def detect(docs: DataFrame, customs: DataFrame | None = None, model_spans: DataFrame | None = None, rows=None) -> DataFrame:
    """Findings of (doc_id, text): patterns, the user's literals and a model's spans, cleaned and merged.

    ``model_spans`` is what any external model found, in the columns of a span; its ord counts before all patterns.
    """
    found = extract.pattern_spans(docs, rows)
    if customs is not None:
        found = found.unionByName(extract.literal_spans(docs, customs))
    if model_spans is not None:
        found = model_spans.select(*[F.col(c) if c in model_spans.columns else F.lit(None).cast("string").alias(c) for c in extract.SPAN_COLUMNS]).withColumn("ord", F.col("ord") - 1_000_000).unionByName(found)
    # Spans of one pattern keep the order of the text.
    return algebra.post_process(found.withColumn("ord", F.shiftleft(F.col("ord").cast("long"), 32) + F.col("start")))


def detect_documents(docs: DataFrame, customs: DataFrame | None = None, model_spans: DataFrame | None = None, rows=None) -> DataFrame:
    """``detect`` for texts of documents: without what belongs to a page's head or sender."""
    return layout.suppress_headers(detect(docs, customs, model_spans, rows), docs)


def anonymize_text(docs: DataFrame, customs: DataFrame | None = None, model_spans: DataFrame | None = None, rows=None) -> DataFrame:
    """Detection, selection and placeholders in one."""
    return anonymize(docs, algebra.non_overlapping(detect(docs, customs, model_spans, rows)))


def session(anonymized: DataFrame, created_at: Column) -> DataFrame:
    """Sessions to keep: what a response needs to be restored."""
    return anonymized.select(F.col("doc_id").alias("session_id"), F.col("text").alias("original_text"), "anonymized_text", "replacement_count", "placeholders", created_at.alias("created_at"))


def latest_session(sessions: DataFrame, key: str = "user_id") -> DataFrame:
    """The newest session of each key."""
    rest = [c for c in sessions.columns if c != key]
    return sessions.groupBy(key).agg(F.max_by(F.struct(*rest), "created_at").alias("s")).select(key, *[f"s.{c}" for c in rest])


def placeholder_pattern(placeholder: Column) -> Column:
    """A tolerant expression for a placeholder: any case, brackets or none, other separators."""
    inner = F.regexp_replace(placeholder, r"^[\[\]]+|[\[\]]+$", "")
    parts = F.split(F.regexp_replace(inner, "^_+", ""), "_", 2)
    quoted = lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))
    tolerant = F.concat(F.lit(r"(?i)\[?\s*"), quoted(F.get(parts, F.lit(0))), F.lit(r"\s*[-_ ]\s*"), quoted(F.get(parts, F.lit(1))), F.lit(r"\s*\]?"))
    plain = F.concat(F.lit(r"(?i)\[?\s*"), quoted(inner), F.lit(r"\s*\]?"))
    return F.when((F.size(parts) < 2) | (F.get(parts, F.lit(1)) == ""), plain).otherwise(tolerant)


def _ordered(placeholders: Column) -> Column:
    """Entries by length of the placeholder, longest first, then by the placeholder."""
    rows = F.transform(F.map_entries(placeholders), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(rows)


def restore(text: Column, placeholders: Column) -> Column:
    """struct(restored_text, replacement_count, unresolved): originals put back as they are, $ and \\ included."""
    entries = _ordered(placeholders)
    literal = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")

    def step(acc: Column, e: Column) -> Column:
        pattern = placeholder_pattern(e["key"])
        return F.struct(F.regexp_replace(acc["text"], pattern, literal(e["value"])).alias("text"), (acc["n"] + F.regexp_count(acc["text"], pattern)).alias("n"))

    done = F.aggregate(entries, F.struct(text.alias("text"), F.lit(0).alias("n")), step)
    left = lambda t: F.transform(F.filter(entries, lambda e: F.regexp_count(t, placeholder_pattern(e["key"])) > 0), lambda e: e["key"])
    return F.get(F.transform(F.array(done), lambda d: F.struct(d["text"].alias("restored_text"), d["n"].alias("replacement_count"), left(d["text"]).alias("unresolved"))), F.lit(0))


def restore_places(text: Column, places: Column, placeholders: Column) -> Column:
    """struct(restored_text, replacement_count, unresolved) of an anonymised text as it was made: originals are put back at its ``places``.

    A text's own words that look like a placeholder, which ``restore`` would take for one, stay. Unresolved are
    placeholders that no longer stand in their place.
    """
    stands = lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]) == s["placeholder"]
    back = lambda held: F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(placeholders, s["placeholder"]).alias("placeholder")))
    gone = F.array_sort(F.array_distinct(F.transform(F.filter(places, lambda s: ~stands(s)), lambda s: s["placeholder"])))
    return let(F.filter(places, stands), lambda held: F.struct(substitute(text, back(held)).alias("restored_text"), F.size(held).alias("replacement_count"), gone.alias("unresolved")))


#: Fixed value: what looks like a placeholder.
TOKEN = r"(?i)\[?\s*[A-ZÄÖÜa-zäöü]+\s*[-_ ]\s*\d+\s*\]?"


def suspicious_tokens(text: Column, placeholders: Column) -> Column:
    """Tokens, as they stand in the text, that look like one of the expected placeholders; distinct, sorted."""
    canonical = lambda t: F.regexp_replace(F.regexp_replace(F.upper(t), r"[\[\]\s_-]+", "_"), "^_|_$", "")
    expected = F.transform(F.map_keys(placeholders), canonical)
    return let(expected, lambda e: F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.array_contains(e, canonical(t))))))


def restore_status(count: Column, unresolved: Column, suspicious: Column) -> Column:
    """ok, partial, suspicious or nothing."""
    return F.when((count > 0) & (F.size(unresolved) == 0) & (F.size(suspicious) == 0), "ok").when(F.size(unresolved) > 0, "partial").when(F.size(suspicious) > 0, "suspicious").otherwise("nothing")
