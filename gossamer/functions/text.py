"""Text normalisation as column expressions. Offsets count code points from 0; ends are exclusive."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case letters that are a plain letter with marks, and that letter, from Unicode's decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        c = chr(code)
        plain = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(plain) > 1 and plain[0].isascii() and all(unicodedata.combining(m) for m in plain[1:]):
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Full-width forms and the characters they stand for.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "
#: Letters in lower case that Java takes for another one's (ı for i, ſ for s), and private characters to tell them apart by.
OWN_CASE = "".join(c for c in map(chr, range(0x80, 0xD800)) if len(c.upper()) == 1 and c == c.lower() != c.upper().lower())
PRIVATE = "".join(map(chr, range(0x10F000, 0x10F000 + len(OWN_CASE))))
#: Elements that a fold appends to one array, before it begins another: appending copies the array.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once. Java code is not generated for it, which keeps long expressions below the compiler's limit."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_blocks(values: Column, kind: str, state: Column, step) -> Column:
    """All that ``step`` (state, value) -> struct(put: array of ``kind``, state) puts, in order; time in proportion to the values."""
    empty = lambda k: F.array().cast(f"array<{k}>")

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda r: F.struct(F.concat(acc["put"], r["put"]).alias("put"), r["state"].alias("state")))

    def block(acc: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(empty(kind).alias("put"), acc["state"].alias("state")), one)
        return let(made, lambda m: F.struct(F.concat(acc["puts"], F.array(m["put"])).alias("puts"), m["state"].alias("state")))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(empty(f"array<{kind}>").alias("puts"), state.alias("state"))
        return F.flatten(F.aggregate(blocks, start, block, lambda a: a["puts"]))

    return let(values, whole)


def running_sums(sizes: Column) -> Column:
    """For each of an array of ints the sum of those before it."""
    return fold_blocks(sizes, "int", F.lit(0), lambda at, n: F.struct(F.array(at).alias("put"), (at + n).alias("state")))


def starts_between(gaps: Column, sizes: Column) -> Column:
    """Where each match begins, of the texts between matches and the matches' lengths."""
    between = lambda g: running_sums(F.zip_with(F.transform(F.slice(g, F.lit(1), F.size(g) - 1), lambda x: F.length(x)), sizes, lambda a, b: a + b))
    return let(gaps, lambda g: F.zip_with(between(g), F.slice(g, F.lit(1), F.size(g) - 1), lambda at, x: at + F.length(x)))


def quoted(needle: Column) -> Column:
    """An expression for a literal, which may hold the end of a quotation."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def hits(haystack: Column, pattern: Column) -> Column:
    """array<struct(s, e)>: the places of an expression's matches, left to right, not overlapping."""
    sizes = lambda m: F.transform(m, lambda x: F.length(x))
    return let(F.regexp_extract_all(haystack, pattern, F.lit(0)), lambda m: F.zip_with(starts_between(F.split(haystack, pattern, -1), sizes(m)), sizes(m), lambda s, n: F.struct(s.alias("s"), (s + n).alias("e"))))


def fold(x: Column) -> Column:
    """Without case and diacritics; ß stays."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def fold_even(x: Column) -> Column:
    """Folded character by character, so that places are those of ``x``; one that folds to several gives its first."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    return F.when(F.length(F.lower(x)) == F.length(x), fold(x)).otherwise(F.array_join(F.transform(chars, lambda c: F.substr(fold(c), F.lit(1), F.lit(1))), ""))


def comparable(x: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(x), r"[^\p{L}\p{N}]", "")


def compact_ascii(x: Column) -> Column:
    """Folded a-z and digits only; a text of other scripts becomes empty."""
    return F.regexp_replace(fold(x), "[^a-z0-9]+", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_native(x: Column) -> Column:
    """A slash between blanks is a line break."""
    return F.replace(x, F.lit(" / "), F.lit("\n"))


def clean_span(x: Column) -> Column:
    """A span's text for display; its offsets stay those of the raw text."""
    return collapse(normalize_native(x))


#: Slash between blanks; three or more single letters or digits with blanks between; a blank inside a number.
#: The looks around see the text as it was.
OCR_TOKEN = r" / |[\p{L}\p{N}](?: [\p{L}\p{N}]){2,}|(?<=\p{N}) (?=\p{N})|(?<=\p{N}) (?=[.,:/\-]\p{N})|(?<=\p{N}[.,:/\-]) (?=\p{N})"


def _ocr_pieces(x: Column) -> tuple[Column, Column]:
    """Gaps and tokens; there is one gap more."""
    return F.split(x, OCR_TOKEN, -1), F.regexp_extract_all(x, F.lit(OCR_TOKEN), F.lit(0))


def normalize_ocr(x: Column) -> Column:
    """Joins what character recognition has spaced out."""
    gaps, tokens = _ocr_pieces(x)
    put = F.transform(tokens, lambda t: F.when(t == " / ", "\n").otherwise(F.replace(t, F.lit(" "), F.lit(""))))
    return F.array_join(F.zip_with(gaps, put, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def offset_map(x: Column, ocr: bool = False) -> Column:
    """For each character of the normalised text its index in ``x``; a line break has that of the slash."""
    if ocr:
        gaps, tokens = _ocr_pieces(x)
    else:
        gaps, tokens = F.split(x, " / ", -1), F.regexp_extract_all(x, F.lit(" / "), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        at, gap, token = state["at"], piece["g"], F.coalesce(piece["t"], F.lit(""))
        after = at + F.length(gap)
        span = lambda lo, n: F.when(n > 0, F.sequence(lo, lo + n - 1)).otherwise(F.array().cast("array<int>"))
        kept = F.when(token == " / ", F.array(after + 1)).otherwise(F.filter(span(after, F.length(token)), lambda i: F.substr(token, i - after + 1, F.lit(1)) != " "))
        return F.struct(F.concat(state["map"], span(at, F.length(gap)), kept).alias("map"), (after + F.length(token)).alias("at"))

    start = F.struct(F.array().cast("array<int>").alias("map"), F.lit(0).alias("at"))
    return F.aggregate(F.arrays_zip(gaps.alias("g"), tokens.alias("t")), start, step, lambda s: s["map"])


def translate_range(start: Column, end: Column, where: Column, size: Column) -> Column:
    """A range of the normalised text in the original one, as struct(start, end). An empty map changes nothing."""
    n = F.size(where)
    begin = F.when((start >= 0) & (start < n), F.get(where, start)).otherwise(size)
    stop = F.when((end > 0) & (end <= n), F.get(where, end - 1) + 1).otherwise(size)
    return F.when(n == 0, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.struct(begin.alias("start"), stop.alias("end")))


#: Fixed value in what it matches: four or more single letters or digits with white space between. Possessive, so that
#: a long run needs no stack.
SPACED_RUN = r"(?u)(?:\b[\p{L}\p{N}]\s++(?=[\p{L}\p{N}]\b)){3,}+[\p{L}\p{N}]"


def needs_ocr(x: Column) -> Column:
    """Whether a page's own text looks broken, so that recognising its picture is better; an empty one is."""
    saved = F.greatest(F.lit(0), F.length(normalize_native(x)) - F.length(normalize_ocr(x)))
    ratio = saved / F.greatest(F.length(x), F.lit(1))
    runs = F.regexp_count(x, F.lit(SPACED_RUN))
    odd = F.length(x) - F.length(F.translate(x, "^�", ""))
    return (x == "") | (runs >= 3) | ((runs >= 2) & (ratio > 0.05)) | (ratio > 0.12) | ((odd >= 2) & (ratio > 0.04))


def choose_text(native: Column, ocr: Column) -> Column:
    """struct(text, source) of a page, or null to skip it."""
    own, seen = F.trim(F.coalesce(native, F.lit(""))), F.trim(F.coalesce(ocr, F.lit("")))
    of = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
    return F.when(needs_ocr(own) & (seen != ""), of(ocr, "ocr")).when(own != "", of(native, "native"))


def save_name(name: Column, fallback: str, extension: Column) -> Column:
    """Suggested name of a redacted copy."""
    base = F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("")), F.lit(fallback))
    return F.concat(base, F.lit("-geschwaerzt."), extension)
