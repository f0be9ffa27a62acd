"""Review state, recent files, diagnostics and the checks of a download's manifest."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold_even, quoted

STATES = ("pending", "accepted", "rejected")


def review_status(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Findings with the status that a log of (finding_id, seq, action) leads to.

    accept and reject change a pending finding, remove (its last redaction) rejects a
    pending one only; a decided finding stays as it is. Actions accept_all of null
    finding_id accept whatever is pending then. Unknown actions do nothing.
    """
    known = actions.filter(F.col("action").isin("accept", "reject", "remove", "accept_all"))
    own = known.filter("finding_id is not null").groupBy("finding_id").agg(F.min_by("action", "seq").alias("_a"), F.min("seq").alias("_s"))
    everyone = known.filter("finding_id is null and action = 'accept_all'").agg(F.min("seq").alias("_all"))
    joined = findings.drop("status").join(own, "finding_id", "left").crossJoin(everyone)
    first_all = F.col("_all").isNotNull() & (F.col("_s").isNull() | (F.col("_all") < F.col("_s")))
    status = F.when(first_all | F.col("_a").isin("accept", "accept_all"), "accepted").when(F.col("_a").isin("reject", "remove"), "rejected").otherwise("pending")
    return joined.withColumn("status", status).drop("_a", "_s", "_all")


def status_counts(findings: DataFrame) -> DataFrame:
    """(status, n) with a row for each status."""
    every = findings.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    return every.join(findings.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def can_save(findings: DataFrame, page=("doc_id",)) -> DataFrame:
    """(doc_id, can_save): nothing may be pending."""
    return findings.groupBy(*page).agg((F.count_if(F.col("status") == "pending") == 0).alias("can_save"))


def recents(opened: DataFrame, keep: int = 8, owner: str | None = None) -> DataFrame:
    """The last ``keep`` different paths of (path, added_at, ...), the newest opening of each, newest first by column rank."""
    by = [owner] if owner else []
    rest = [c for c in opened.columns if c not in (*by, "path", "added_at")]
    newest = opened.groupBy(*by, "path").agg(F.max("added_at").alias("added_at"), *[F.max_by(c, "added_at").alias(c) for c in rest])
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("added_at"), "path"))
    return newest.withColumn("rank", place.cast("long")).filter(F.col("rank") <= keep)


def keyword_in_context(texts: DataFrame, query: str, section: str = "text", around: int = 28, most: int = 6, key: str = "doc_id") -> DataFrame:
    """(key, section, at, snippet): the first places of a query without case and diacritics, with what stands around them."""
    needle = fold_even(F.lit(query.strip()))
    size = F.length(needle)
    # The places are those of the text itself, so each character must fold to one.
    gaps = F.split(fold_even(F.col("text")), quoted(needle), most + 1)
    hits = texts.filter(F.contains(fold_even(F.col("text")), needle) & (size > 0)).select(key, "text", gaps.alias("_g"))
    starts = F.transform(F.sequence(F.lit(1), F.size("_g") - 1), lambda i: F.aggregate(F.slice("_g", F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s)) + (i - 1) * size)
    each = hits.select(key, "text", F.posexplode(starts).alias("at", "s"))
    begin, stop = F.greatest(F.lit(0), F.col("s") - around), F.least(F.length("text"), F.col("s") + size + around)
    snippet = F.concat(F.when(begin > 0, "…").otherwise(""), F.substr("text", begin + 1, stop - begin), F.when(stop < F.length("text"), "…").otherwise(""))
    return each.select(key, F.lit(section).alias("section"), F.col("at").cast("long").alias("at"), snippet.alias("snippet"))


def diagnostics_search(entries: DataFrame, findings: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Hits per entry (doc_id, raw_text, normalized_text) in its raw text, its normalised text if that differs, and its findings; the first ``most`` of an entry."""
    raw = keyword_in_context(entries.select("doc_id", F.col("raw_text").alias("text")), query, "raw").withColumn("part", F.lit(0))
    other = keyword_in_context(entries.filter("normalized_text <> raw_text").select("doc_id", F.col("normalized_text").alias("text")), query, "normalized").withColumn("part", F.lit(1))
    low = query.strip().lower()
    hit = findings.filter(F.contains(F.lower("text"), F.lit(low)) | F.contains(F.lower("category"), F.lit(low))).filter(F.lit(bool(low)))
    told = hit.select("doc_id", F.concat(F.lit("finding · "), "source").alias("section"), F.col("start").cast("long").alias("at"), F.concat_ws(": ", "category", "text").alias("snippet"), F.lit(2).alias("part"))
    every = raw.unionByName(other).unionByName(told)
    return every.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("part", "at", "snippet"))).filter(F.col("n") <= most).drop("part")


def report(findings: DataFrame) -> DataFrame:
    """(doc_id, report): one line per finding by place, those of one place by source, category and text."""
    head = F.format_string("[%s] %s · %s", "source", "category", "text")
    line = F.format_string("%s · %d-%d · %d%%", head, "start", "end", F.floor(F.col("confidence") * 100).cast("int"))
    rows = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", head.alias("h"), line.alias("l")))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["l"]), "\n").alias("report"))


def manifest_path(path: Column) -> Column:
    """struct(path, error) of a manifest's relative path: slashes straightened, dots and empty steps left out; absolute and climbing paths are errors."""
    straight = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    steps = F.split(straight, "/")
    kept = F.filter(steps, lambda s: (s != "") & (s != "."))
    error = F.when(path.isNull() | (straight == ""), "empty").when(F.startswith(straight, F.lit("/")), "absolute").when(F.array_contains(steps, ".."), "climbs")
    clean = F.when(error.isNull(), F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/")))
    return F.struct(clean.alias("path"), error.alias("error"))


#: Stretches that a model's parts are cut into by ``download_progress``.
CELLS = 4096


def download_progress(parts: DataFrame, page=("model",), cells: int = CELLS) -> DataFrame:
    """Parts (model, at, bytes) with the bytes done so far and their share of all.

    ``at`` is a number or a time. Its range is cut into equal stretches whose sums run
    first, so that no task sorts all parts of a model; parts without ``at`` come first.
    """
    at = F.col("at").cast("double")
    same = lambda a, b, *keys: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys])
    whole = parts.groupBy(*page).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.sum("bytes").alias("_all")).alias("w")
    wide = F.col("_hi") > F.col("_lo")
    cell = F.when(wide, F.floor((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells)).otherwise(F.lit(0))
    placed = parts.alias("p").join(whole, same("p", "w", *page)).select("p.*", "_all", F.when(F.col("at").isNull(), -1).otherwise(cell).cast("int").alias("_cell"))
    sums = placed.groupBy(*page, "_cell").agg(F.sum("bytes").alias("_sum"))
    before = sums.select(*page, "_cell", F.sum("_sum").over(W.partitionBy(*page).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)).alias("_before")).alias("b")
    own = F.sum("bytes").over(W.partitionBy(*page, "_cell").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    run = placed.withColumn("_own", own).alias("p").join(before, same("p", "b", *page, "_cell"))
    done = F.when(F.col("_before").isNull(), F.col("_own")).otherwise(F.col("_before") + F.coalesce("_own", F.lit(0)))
    return run.select("p.*", done.alias("done")).withColumn("share", F.col("done") / F.greatest("_all", F.lit(1))).drop("_all", "_cell", "_own")


def file_kind(path: Column) -> Column:
    """pdf, image or null by a path's ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending == "pdf", "pdf").when(ending.isin("png", "jpg", "jpeg", "heic", "tif", "tiff", "gif", "bmp", "webp"), "image")
