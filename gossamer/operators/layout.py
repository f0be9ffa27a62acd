"""Lines, boxes and what stands around a finding on its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as is_
from ..functions.text import collapse, comparable, fold, hits, let, quoted, running_sums

CHAR_WIDTH, LINE_STEP, LINE_HEIGHT = 6.0, 14.0, 12.0
#: Characters of a stretch by which spans and lines of one text meet.
CELL = 1024


def join_lines(ocr_lines: DataFrame, page=("doc_id", "page_index")) -> DataFrame:
    """(page..., text, starts): recognised lines by line_no joined with line feeds, and where each begins."""
    lists = ocr_lines.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    texts = F.transform("l", lambda x: x["text"])
    starts = running_sums(F.transform(texts, lambda t: F.length(t) + 1))
    return lists.select(*page, F.array_join(texts, "\n").alias("text"), starts.alias("starts"))


def text_lines(docs: DataFrame, page=("doc_id",)) -> DataFrame:
    """(page..., line_no, line, line_start, line_end): a row per line of a text."""
    row = lambda t, begin: F.struct(t.alias("line"), begin.alias("line_start"), (begin + F.length(t)).alias("line_end"))
    lines = let(F.split("text", "\n", -1), lambda v: F.zip_with(v, running_sums(F.transform(v, lambda t: F.length(t) + 1)), row))
    return docs.select(*page, F.posexplode(lines).alias("line_no", "x")).select(*page, "line_no", "x.*")


def grid_box(line_no: Column, n_lines: Column, column: Column, width: Column) -> Column:
    """A rectangle on a grid of equal characters, origin at the bottom left."""
    return F.struct((column * CHAR_WIDTH).alias("x"), ((n_lines - 1 - line_no) * LINE_STEP).alias("y"), (width * CHAR_WIDTH).alias("w"), F.lit(LINE_HEIGHT).alias("h"))


def span_boxes(spans: DataFrame, lines: DataFrame, page=("doc_id",), box: Column | None = None) -> DataFrame:
    """One row per span and line that it touches, with the part of the line and its box.

    Spans and lines meet by page and stretch of the text (``CELL`` characters), so a
    page's spans are not compared with all its lines. Lines may bring boxes of their
    own (``box``); else the grid gives them. Empty spans and lines touch nothing.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)))
    if box is None:
        lines = lines.join(lines.groupBy(*page).agg(F.count("*").cast("int").alias("n_lines")), list(page))
    begin, stop = F.greatest("start", "line_start"), F.least("end", "line_end")
    some, each = spans.filter(F.col("end") > F.col("start")), lines.filter(F.col("line_end") > F.col("line_start"))
    pairs = some.withColumn("_cell", cells("start", "end")).join(each.withColumn("_cell", cells("line_start", "line_end")), [*page, "_cell"])
    # A pair may share several stretches; that where the common part begins counts.
    touched = pairs.filter((begin < stop) & (F.col("_cell") == F.floor(begin / CELL)))
    rect = box if box is not None else grid_box(F.col("line_no"), F.col("n_lines"), begin - F.col("line_start"), stop - begin)
    return touched.select(*spans.columns, "line_no", begin.alias("part_start"), stop.alias("part_end"), rect.alias("rect"))


def recover_boxes(unplaced: DataFrame, recognised: DataFrame, lines: DataFrame, page=("doc_id", "page_index")) -> DataFrame:
    """Spans without a box looked up in the recognised text: all places but for case, with the boxes of the lines there."""
    text = recognised.select(*page, F.col("text").alias("_page"))
    found = unplaced.filter("text <> ''").join(text, list(page))
    places = hits(F.col("_page"), F.concat(F.lit("(?iu)"), quoted(F.col("text"))))
    placed = found.withColumn("_at", F.explode(places)).withColumns({"start": F.col("_at.s"), "end": F.col("_at.e")}).select(unplaced.columns)
    return span_boxes(placed, lines, page, box=F.col("box"))


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box of the unit square, origin bottom left, in pixels with the origin top left."""
    return F.struct((box["x"] * width).alias("x"), ((1 - box["y"] - box["h"]) * height).alias("y"), (box["w"] * width).alias("w"), (box["h"] * height).alias("h"))


def to_page(box: Column, media: Column) -> Column:
    """A box of the unit square on a page's media box."""
    return F.struct((media["x"] + box["x"] * media["w"]).alias("x"), (media["y"] + box["y"] * media["h"]).alias("y"), (box["w"] * media["w"]).alias("w"), (box["h"] * media["h"]).alias("h"))


def clip(rect: Column, media: Column) -> Column:
    x, y = F.greatest(rect["x"], media["x"]), F.greatest(rect["y"], media["y"])
    right, top = F.least(rect["x"] + rect["w"], media["x"] + media["w"]), F.least(rect["y"] + rect["h"], media["y"] + media["h"])
    return F.when((right > x) & (top > y), F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (top - y).alias("h")))


def display_rect(rect: Column, media: Column, style: str = "black") -> Column:
    """The rectangle that is drawn: a bar of even height about the line, or the blur's margin; null outside the page."""
    if style == "blur":
        return clip(F.struct((rect["x"] - 1).alias("x"), (rect["y"] - 1).alias("y"), (rect["w"] + 2).alias("w"), (rect["h"] + 2).alias("h")), media)
    height = F.greatest(F.lit(12.0), F.round(rect["h"] + 4))
    return clip(F.struct((rect["x"] - 1).alias("x"), (rect["y"] + rect["h"] / 2 - height / 2).alias("y"), (rect["w"] + 2).alias("w"), height.alias("h")), media)


# Words that mark a page's head, its sender and where the recipient begins.
HEADER_WORDS = ("finanzamt", "finanzkasse", "moltkestr", "moltkestra", "tel", "zi.nr", "steuernummer", "idnr", "deutsche post")
SENDER_WORDS = ("gmbh", "mbh", "ag", "ug", "kg", "ohg", "gbr", "kundin", "kunde")
RECIPIENT_WORDS = ("kundin", "kunde", "lieferadresse", "schriftverkehr", "kontoinhaber", "abweichender ansprechpartner")
DATE_NEAR, PHONE_NEAR = r"\b\d{2}\.\d{2}\.\d{4}\b", r"\(?\d{3,5}\)?[ /-]?\d{2,5}[-/]\d{2,5}"


def header_reason(category: Column, snippet: Column, page_text: Column) -> Column:
    """Why a finding belongs to a page's head or sender rather than to a person; null if it doesn't.

    Looked at are the lines that hold the snippet, each with one line before and two after.
    """
    cleaned = collapse(snippet)
    compact = comparable(cleaned)
    postal = cleaned.rlike(is_.POSTAL_CITY)
    street = (category == "private_address") & cleaned.rlike("(?i)" + is_.STREET)
    city = (category == "private_person") & compact.rlike("^[a-zäöüß]{4,}$")
    folded = F.transform(F.split(page_text, "\n", -1), lambda line: fold(line))
    n = F.size(folded)
    marked = F.filter(F.sequence(F.lit(0), n - 1), lambda i: is_.contains_any(F.get(folded, i), RECIPIENT_WORDS))
    first = F.get(marked, F.lit(0))

    def why(i: Column) -> Column:
        line = F.get(folded, i)
        holds = F.contains(line, fold(cleaned)) | ((compact != "") & F.contains(F.regexp_replace(line, r"[^\p{L}\p{N}]", ""), compact))
        begin = F.greatest(F.lit(0), i - 1)
        around = F.array_join(F.slice(folded, begin + 1, F.least(n - 1, i + 2) - begin + 1), "\n")
        reason = (
            F.when(is_.contains_any(around, HEADER_WORDS), "header")
            .when(first.isNotNull() & (i < first) & is_.contains_any(around, SENDER_WORDS), "sender")
            .when(postal & around.rlike(DATE_NEAR), "date")
            .when(postal & around.rlike(PHONE_NEAR), "phone")
        )
        return F.when(holds, reason)

    reasons = F.filter(F.transform(F.sequence(F.lit(0), n - 1), why), lambda r: r.isNotNull())
    return F.when((cleaned != "") & (postal | city | street), F.get(reasons, F.lit(0)))


def suppress_headers(spans: DataFrame, pages: DataFrame, page=("doc_id",)) -> DataFrame:
    """Spans without those of a page's head or sender; for texts of documents, not for clipboard text."""
    text = pages.select(*page, F.col("text").alias("_page"))
    return spans.join(text, list(page), "left").filter(header_reason(F.col("category"), F.col("text"), F.col("_page")).isNull()).drop("_page")
