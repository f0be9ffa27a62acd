"""Spans of sensitive text: built-in patterns and the user's own literals, with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import NARROW, OWN_CASE, PRIVATE, WIDE, fold, hits, let, quoted, starts_between

SPAN_COLUMNS = ("doc_id", "ord", "pattern", "category", "text", "start", "end", "confidence", "source")


def _able(text: Column, pattern: str) -> Column | None:
    if pattern in P.RUNS:
        return F.col("_run")
    need = P.NEEDS.get(pattern)
    return None if need is None else F.col("_digit") if need == "0" else F.contains(text, F.lit(need))


def found_patterns(text: Column, rows=None, run=P.executed) -> Column:
    """array<struct(ord, id, category, regex, m)> of the patterns that match, m being all matches in order. ``run`` gives the expression to run."""
    parts = []
    for ord_, name, category, regex in rows or P.everything():
        regex = run(regex)
        all_of = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        able = _able(text, name)
        if able is not None:  # a cheap look saves the search
            all_of = F.when(able, all_of).otherwise(F.array().cast("array<string>"))
        parts.append(F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("id"), F.lit(category).alias("category"), F.lit(regex).alias("regex"), all_of.alias("m")))
    return F.filter(F.array(*parts), lambda p: F.size(p["m"]) > 0)


def pattern_spans(docs: DataFrame, rows=None, keep: tuple[str, ...] = (), run=P.executed) -> DataFrame:
    """All matches in (doc_id, text) rows, with offsets; row-local, so it also runs on a stream.

    Texts are split only by patterns that have matches. ``keep`` columns go along. A null
    text has no spans. ``run`` makes the expression that runs of a pattern's.
    """
    seen = docs.select("doc_id", *keep, "text", F.col("text").rlike(r"\p{Nd}").alias("_digit"), F.col("text").rlike(rf"[^ \n]{{{P.RUN}}}").alias("_run")).filter(F.col("text").isNotNull())
    hit = seen.select("doc_id", *keep, "text", F.explode(found_patterns(F.col("text"), rows, run)).alias("p"))
    # One pass over a pattern's matches gives their places; only these go on, a row a match.
    starts = starts_between(F.expr("split(text, p.regex, -1)"), F.transform(F.col("p.m"), lambda m: F.length(m)))
    places = F.zip_with(F.col("p.m"), starts, lambda m, s: F.struct(m.alias("text"), s.alias("start")))
    parts = hit.select("doc_id", *keep, F.col("p.ord").alias("ord"), F.col("p.id").alias("pattern"), F.col("p.category").alias("category"), places.alias("x"))
    each = parts.select("doc_id", *keep, "ord", "pattern", "category", F.explode("x").alias("x"))
    return each.select(
        "doc_id",
        *keep,
        "ord",
        "pattern",
        "category",
        F.col("x.text").alias("text"),
        F.col("x.start").alias("start"),
        (F.col("x.start") + F.length("x.text")).alias("end"),
        F.lit(P.CONFIDENCE).alias("confidence"),
        F.lit("pattern").alias("source"),
    )


#: Up to so many literals are compared with every text; more are joined by their first characters.
FEW_LITERALS = 1_000


def _normal(x: Column) -> Column:
    """Lower case, ss for ß, no diacritics, no full-width forms."""
    return F.translate(F.replace(fold(x), F.lit("ß"), F.lit("ss")), WIDE, NARROW)


def _normal_literal(x: Column) -> Column:
    """``_normal``, and a street's type spelled out."""
    return F.replace(F.replace(_normal(x), F.lit("str."), F.lit("strasse")), F.lit("str "), F.lit("strasse "))


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def distinct_literals(customs: DataFrame) -> DataFrame:
    """Custom patterns (label, value, category) to search for: trimmed, not empty, each once by folded category and compacted value.

    Of equal ones the first by column ``ord`` stays, without such a column the smallest value.
    """
    order = F.col("ord") if "ord" in customs.columns else F.col("value")
    rows = customs.select(collapse_ends(F.col("value")).alias("value"), F.coalesce("category", F.lit("custom_identifier")).alias("category"), order.alias("_o")).filter("value <> ''")
    key = W.partitionBy(fold(collapse_ends(F.col("category"))), _bare(_normal_literal(F.col("value")))).orderBy("_o", "value")
    return rows.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n", "_o")


def collapse_ends(x: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _char_map(text: Column, written) -> Column:
    """struct(text, at): the text rewritten character by character (``written`` of the characters and an index), and for each character written the index it came from."""

    def rewrite(chars: Column) -> Column:
        put = F.transform(chars, lambda c, i: written(chars, c, i))
        return let(put, lambda p: F.struct(F.array_join(p, "").alias("text"), F.flatten(F.transform(p, lambda w, i: F.array_repeat(i, F.length(w)))).alias("at")))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), rewrite)


def _pairs(looked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts (_compact, ...) with the literals (first, second, ...) whose compacted spelling they hold, each pair once."""
    holds, also = F.contains("_compact", "first"), F.contains("_compact", "second")
    if wanted.limit(FEW_LITERALS + 1).count() <= FEW_LITERALS:
        return looked.join(F.broadcast(wanted), holds | also)

    def grams(chars: Column) -> Column:
        of = lambda c, i: F.array(c, F.concat(c, F.coalesce(F.get(chars, i + 1), F.lit(""))), F.concat(c, F.coalesce(F.get(chars, i + 1), F.lit("")), F.coalesce(F.get(chars, i + 2), F.lit(""))))
        return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(chars, of))))

    key = lambda c: F.substr(F.col(c), F.lit(1), F.lit(3))
    by_first = wanted.withColumn("_key", key("first")).withColumn("_turn", F.lit(1))
    by_second = wanted.filter("first <> second").withColumn("_key", key("second")).withColumn("_turn", F.lit(2))
    keyed = looked.withColumn("_key", F.explode(let(F.filter(F.split("_compact", ""), lambda c: c != ""), grams)))
    return keyed.join(by_first.unionByName(by_second), "_key").filter(F.when(F.col("_turn") == 1, holds).otherwise(also & ~holds)).drop("_key", "_turn")


def literal_spans(docs: DataFrame, customs: DataFrame, keep: tuple[str, ...] = (), spellings: bool = True) -> DataFrame:
    """Places of the user's literals: as written but for case; only if there are none, without diacritics, width and spelling of streets; only if still none, letters and digits alone.

    Without ``spellings`` only as written but for case, a letter's case being what lower-casing makes equal.
    Few literals are compared with every text, more meet texts by their first three
    letters or digits; in both cases only texts that hold the compacted literal go on.
    """
    plain = _normal_literal(F.col("value"))
    wanted = distinct_literals(customs).select("category", F.col("value").alias("needle"), plain.alias("plain"), _bare(_normal(F.col("value"))).alias("first"), _bare(plain).alias("second"))
    text = docs.filter(F.col("text").isNotNull()).select("doc_id", *keep, "text")
    pair = _pairs(text.withColumn("_compact", _bare(_normal(F.col("text")))), wanted)
    # Blanks of a run count as one, none at the beginning.
    blank = lambda c: c.rlike(r"(?U)^\s$")
    spaced = _char_map(F.col("text"), lambda chars, c, i: F.when(blank(c), F.when((i == 0) | blank(F.get(chars, F.greatest(i - 1, F.lit(0)))), "").otherwise(" ")).otherwise(_normal(c)))
    bare = _char_map(F.col("text"), lambda chars, c, i: _bare(_normal(c)))

    def mapped(written: Column, needle: Column) -> Column:
        return let(written, lambda w: F.transform(hits(w["text"], quoted(needle)), lambda h: F.struct(F.get(w["at"], h["s"]).alias("s"), (F.get(w["at"], h["e"] - 1) + 1).alias("e"))))

    found = lambda places: F.filter(places, lambda h: h["e"] > h["s"])
    one = found(hits(F.col("text"), F.concat(F.lit("(?iu)"), quoted(F.col("needle")))))
    two, three = found(mapped(spaced, F.col("plain"))), F.when(F.col("second") != "", found(mapped(bare, F.col("second"))))
    lowered = lambda x: F.translate(x, OWN_CASE, PRIVATE)
    alike = found(hits(lowered(F.col("text")), F.concat(F.lit("(?iu)"), quoted(lowered(F.col("needle"))))))
    first = alike if not spellings else let(one, lambda a: F.when(F.size(a) > 0, a).otherwise(let(two, lambda b: F.when(F.size(b) > 0, b).otherwise(three))))
    places = pair.select("doc_id", *keep, "category", "text", F.explode(first).alias("r"))
    return places.select(
        "doc_id",
        *keep,
        F.lit(len(P.PATTERNS)).alias("ord"),
        F.lit("custom").alias("pattern"),
        "category",
        F.substr("text", F.col("r.s") + 1, F.col("r.e") - F.col("r.s")).alias("text"),
        F.col("r.s").alias("start"),
        F.col("r.e").alias("end"),
        F.lit(P.LITERAL_CONFIDENCE).alias("confidence"),
        F.lit("pattern").alias("source"),
    )
