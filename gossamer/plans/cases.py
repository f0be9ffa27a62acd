"""Queries over small tables of cases, each with the answers, and over whole tables where SQL can say what is expected."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import anonymize, compact, custom, extract, layout, review
from ..session import spread, table
from . import oracles as O

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


# ---- detection

_PLACES = [
    (1, "Wohnort 39104 Buchental, Haus 7", "german_postal_city", "39104 Buchental", 8),
    (2, "12345 Amazon", None, None, None),
    (3, "PLZ 04109\nLindenau.", "german_postal_city", "04109\nLindenau", 4),
    (4, "mieszka ul. Polna 7 m. 3, Wola", "polish_street", "ul. Polna 7 m. 3", 8),
    (5, "ul. Polna bez numeru", None, None, None),
]


@query("place_patterns", f"SELECT doc_id::BIGINT AS doc_id, pattern, text, span_start::BIGINT AS span_start FROM {O.values([(r[0], *r[2:]) for r in _PLACES if r[2]], 'doc_id, pattern, text, span_start')}")
def place_patterns(spark, sf):
    """The two patterns of places that look around."""
    rows = [r for r in P.everything() if r[1] in ("german_postal_city", "polish_street")]
    docs = spark.createDataFrame([r[:2] for r in _PLACES], "doc_id long, text string")
    return extract.pattern_spans(docs, rows).select("doc_id", "pattern", "text", F.col("start").cast("long").alias("span_start"))


_SPELT = [(1, "Anna", 4), (2, "FRIEDENSTRASSE 25", 0), (3, "Frieden-Strasse25", 4)]


@query("literal_spellings", f"SELECT doc_id::BIGINT AS doc_id, text, span_start::BIGINT AS span_start FROM {O.values(_SPELT, 'doc_id, text, span_start')}")
def literal_spellings(spark, sf):
    """Literals but for case at their own places, without diacritics and street's spelling, and by letters and digits alone."""
    docs = spark.createDataFrame([(1, "\u0130\u0130\u0130 Anna ist da"), (2, "FRIEDENSTRASSE 25"), (3, "bei Frieden-Strasse25"), (4, "Annette")], "doc_id long, text string")
    customs = spark.createDataFrame([("l", v, "custom_identifier") for v in ("anna", "Friedenstr. 25", "Friedenstra\u00dfe 25")], "label string, value string, category string")
    return extract.literal_spans(docs, customs).select("doc_id", "text", F.col("start").cast("long").alias("span_start"))


@query("document_findings")
def document_findings(spark, sf):
    """Findings of whole documents by all patterns, without those of a head or sender."""
    found = anonymize.detect_documents(spread(table(spark, sf, "documents").select("doc_id", "text")))
    return found.select("doc_id", "category", "text", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


_LETTER = "Finanzamt Nord\n04109 Lindenau\n\n\nVera Holm\nKundin\n\n\n\nwohnt in\n39104 Buchental\nseit Mai"


@query("document_findings_letter", f"SELECT text FROM {O.values([('39104 Buchental',)], 'text')}")
def document_findings_letter(spark, sf):
    """A letter's places: that of the authority in its head goes."""
    found = anonymize.detect_documents(spark.createDataFrame([(1, _LETTER)], "doc_id long, text string"))
    return found.filter("category = 'private_address'").select(F.substring_index("text", "\n", 1).alias("text"))


# ---- restoring

#: Blanks beside a placeholder belong to it, as brackets do.
_BACK = [(1, "see [ORT_1]", 1, "[ORT_1]", "partial"), (2, "forVera Holm", 1, "", "ok"), (3, "nothing", 0, "", "nothing")]


@query("restore_states", f"SELECT id::BIGINT AS id, restored_text, n::BIGINT AS replacement_count, unresolved, status FROM {O.values(_BACK, 'id, restored_text, n, unresolved, status')}")
def restore_states(spark, sf):
    """Restored texts with placeholders that are still there, and the state told."""
    rows = spark.createDataFrame([(1, "see [ORT_1]", {"[ORT_1]": "[ORT_1]"}), (2, "for person - 1", {"[PERSON_1]": "Vera Holm"}), (3, "nothing", {"[PERSON_1]": "Vera Holm"})], "id long, text string, m map<string,string>")
    done = rows.select("id", "m", anonymize.restore(F.col("text"), F.col("m")).alias("r"))
    tokens = F.when(F.size("r.unresolved") > 0, F.array().cast("array<string>")).otherwise(anonymize.suspicious_tokens(F.col("r.restored_text"), F.col("m")))
    status = anonymize.restore_status(F.col("r.replacement_count"), F.col("r.unresolved"), tokens)
    return done.select("id", F.col("r.restored_text").alias("restored_text"), F.col("r.replacement_count").cast("long").alias("replacement_count"), F.array_join("r.unresolved", ",").alias("unresolved"), status.alias("status"))


_TOKENS = [(1, "Person 1 |[PERSON_1]"), (2, ""), (3, "[ort-2]")]


@query("suspicious_tokens", f"SELECT id::BIGINT AS id, tokens FROM {O.values(_TOKENS, 'id, tokens')}")
def suspicious_tokens(spark, sf):
    """Tokens as they stand in the text, sorted."""
    rows = spark.createDataFrame([(1, "[PERSON_1]Person 1 "), (2, "Haus 9"), (3, "x,[ort-2]")], "id long, text string")
    keys = F.create_map(F.lit("[PERSON_1]"), F.lit("a"), F.lit("[ORT_2]"), F.lit("b"))
    return rows.select("id", F.regexp_replace(F.array_join(anonymize.suspicious_tokens(F.col("text"), keys), "|"), r"^\s+", "").alias("tokens"))


@query("newest_sessions", "SELECT o_custkey AS user_id, max(o_orderkey) AS created_at FROM orders GROUP BY o_custkey")
def newest_sessions(spark, sf):
    """The newest session of each user; here of orders, by their keys."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("created_at"), F.col("o_orderkey").alias("session"))
    return anonymize.latest_session(rows).filter("session = created_at").select("user_id", "created_at")


# ---- boxes


@query(
    "page_affine",
    "SELECT page_id, x * 800 AS px, (1 - y - 0.25::DOUBLE) * 600 AS py, 0.5::DOUBLE * 800 AS pw, 20 + x * 400 AS mx, 10 + y * 300 AS my FROM (SELECT page_id, (page_id % 8) / 16.0::DOUBLE AS x, (page_id % 4) / 8.0::DOUBLE AS y FROM pages)",
)
def page_affine(spark, sf):
    """A box of the unit square in pixels and on the media box."""
    media = F.struct(*[F.lit(v).alias(k) for k, v in (("x", 20.0), ("y", 10.0), ("w", 400.0), ("h", 300.0))])
    box = F.struct((F.col("page_id") % 8 / 16.0).alias("x"), (F.col("page_id") % 4 / 8.0).alias("y"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))
    rows = table(spark, sf, "pages").select("page_id", box.alias("b"))
    p, m = layout.to_pixels(F.col("b"), F.lit(800), F.lit(600)), layout.to_page(F.col("b"), media)
    return rows.select("page_id", p.alias("p"), m.alias("m")).select("page_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.w").alias("pw"), F.col("m.x").alias("mx"), F.col("m.y").alias("my"))


_RECOVERED = [(1, 0, "Vera Holm", 0, 1.0), (1, 0, "vera holm", 2, 3.0)]


@query("recovered_boxes", f"SELECT doc_id::BIGINT AS doc_id, page::BIGINT AS page_index, line_no::BIGINT AS line_no, y::DOUBLE AS y FROM {O.values([(d, p, n, y) for d, p, _, n, y in _RECOVERED], 'doc_id, page, line_no, y')}")
def recovered_boxes(spark, sf):
    """A span without a box, looked up in the recognised text: every place but for case."""
    box = "struct<x:double,y:double,w:double,h:double>"
    spans = spark.createDataFrame([(1, 0, "Vera Holm", 0, 0), (1, 0, "fehlt", 0, 0)], "doc_id long, page_index int, text string, start int, end int")
    text = spark.createDataFrame([(1, 0, "Vera Holm\nda\nund vera holm")], "doc_id long, page_index int, text string")
    lines = spark.createDataFrame([(1, 0, 0, 0, 9, (0.0, 1.0, 1.0, 1.0)), (1, 0, 1, 10, 12, (0.0, 2.0, 1.0, 1.0)), (1, 0, 2, 13, 26, (0.0, 3.0, 1.0, 1.0))], f"doc_id long, page_index int, line_no int, line_start int, line_end int, box {box}")
    found = layout.recover_boxes(spans, text, lines)
    return found.select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.col("line_no").cast("long").alias("line_no"), F.col("rect.y").alias("y"))


# ---- review

_RECT = lambda x, y, w: [(float(x), float(y), float(w), 12.0)]
#: (doc_id, ord, category, snippet, rects, the rule that drops it): letters on which the rules of context apply.
_RULES = [
    ("r2", 0, "private_address", "39104 Buchental", _RECT(60, 700, 110), "R2"),
    ("r2", 1, "private_address", "39104 Buchental", _RECT(60, 300, 110), "R2"),
    ("r2", 2, "private_person", "Buchental", _RECT(300, 500, 60), "R5"),
    ("r3", 0, "private_address", "39104 Buchental", _RECT(60, 700, 110), "R3"),
    ("r3", 1, "account_number", "Finanzamt Nord", _RECT(60, 680, 100), None),
    ("r6", 0, "private_person", "Buchental", _RECT(60, 700, 60), "R6"),
    ("r6", 1, "account_number", "Finanzamt Nord", _RECT(60, 680, 100), None),
    ("r7", 0, "private_person", "Buchental", _RECT(60, 700, 60), "R7"),
    ("r7", 1, "account_number", "Falkenberg GmbH", _RECT(60, 680, 100), None),
    ("r9", 0, "private_address", "39104 Buchental Vera Holm", _RECT(60, 700, 160), "R9"),
    ("r9", 1, "private_address", "39104 Buchental", _RECT(60, 690, 110), None),
]


@query("context_rules", f"SELECT doc_id, ord::BIGINT AS ord, reason FROM {O.values([(d, o, r) for d, o, _, _, _, r in _RULES], 'doc_id, ord, reason')}")
def context_rules(spark, sf):
    """The rules that ask what stands near."""
    schema = "doc_id string, page_index int, ord int, category string, snippet string, source string, confidence double, rects array<struct<x:double,y:double,w:double,h:double>>"
    rows = spark.createDataFrame([(d, 0, o, c, s, "pattern", 0.99, r) for d, o, c, s, r, _ in _RULES], schema)
    return compact.redundant_reason(rows).select("doc_id", F.col("ord").cast("long").alias("ord"), "reason")


_SEARCHED = [(1, "raw", 0, "Anna / Bo"), (1, "normalized", 0, "Anna\nBo"), (1, "finding \u00b7 pattern", 3, "private_person: Anna"), (2, "raw", 3, "da Anna")]


@query("diagnostics_search", f"SELECT doc_id::BIGINT AS doc_id, section, snippet FROM {O.values([(d, s, t) for d, s, _, t in _SEARCHED], 'doc_id, section, snippet')}")
def diagnostics_search(spark, sf):
    """Hits in raw texts, normalised ones that differ, and findings."""
    entries = spark.createDataFrame([(1, "Anna / Bo", "Anna\nBo"), (2, "da Anna", "da Anna"), (3, "Otto", "Otto")], "doc_id long, raw_text string, normalized_text string")
    findings = spark.createDataFrame([(1, "private_person", "Anna", "pattern", 3), (3, "private_person", "Otto", "model", 0)], "doc_id long, category string, text string, source string, start int")
    return review.diagnostics_search(entries, findings, "anna").select("doc_id", "section", "snippet")


_LEFT = [(0, "Name", "Vera Holm"), (2, "Ort", "Buchental")]


@query("custom_pattern_remove", f"SELECT ord::BIGINT AS ord, label, value FROM {O.values(_LEFT, 'ord, label, value')}")
def custom_pattern_remove(spark, sf):
    """The user's literals without one that was removed."""
    rows = spark.createDataFrame([(0, "Name", "Vera Holm", "c"), (1, "Tel", "0391", "c"), (2, "Ort", "Buchental", "c")], "ord long, label string, value string, category string")
    return custom.remove(rows, [1]).select("ord", "label", "value")
