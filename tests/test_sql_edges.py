"""Queries against their SQL on texts whose letters, blanks and word edges the two engines read in different ways."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gossamer import session
from gossamer.functions import patterns as P
from gossamer.functions import predicates as is_
from gossamer.operators import anonymize, extract
from gossamer.plans import catalog

#: Accents, other digits, blanks that don't break, vertical tabs, long s, Kelvin's sign and capital ß beside what is found.
TEXTS = [
    "ÉTIONANOUCHTIONELLE!! ÉVI!! ÉTIONANOUCHTIONELLE!!",
    "SCHBERBERERKEITERÖ!! x 4111 1111 1111 1111é y 4111\u00a01111 1111 1111 z",
    "IBAN DE89\u00a03704 0044 0532 0130 00, DE89 3704 0044 0532 0130 00ö",
    "1.2.3.4ä und ٣٤-٥٦٧ oder 12-345ß, é10.0.0.1 10.0.0.1",
    "Ährenweg 5. Alte Straſſe 7. Kurſtraße 9. Müag Weg 5. Hauptstraße 7ä. GROSSE STRAẞE 8. Kurze Gasse 4. Öug Kg Ring 3",
    "frau ömer Müller Weg 3. HERR Übel Kern 5. Frau ſabine Öst. Herr Jan Äag Falk. Frau Vera Holm-é",
    "NIP:\u000b123-456-78-90 NIP: 1234567890 PESEL 12345678901é KRS\u00a01234567890 KRS 1234567890 Krs: 1234567891",
    "ä@x.de éa.b@c.deé x@y.zz-q@r.st mÿ@ab.cd +49 30 1234567\u00a08",
    "e\u0301ABCDEFGHIJKLMNOPQ ABCDEFGHIJKLMNOPQ\u0301",
    "1. 2. 2021é ’3/4/99ö 5.6.2020 + ٣.4.2020",
    "BTC: 1BoatSLRHtKNngkdXEeobR76b53LETtpyTé uſdt: 1BoatSLRHtKNngkdXEeobR76b53LETtpyT é1BoatSLRHtKNngkdXEeobR76b53LETtpyT",
    "plain words",
    "",
    None,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "de" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, "u", t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert expected and sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(
    "name",
    [
        "pii_spans",
        "page_secrets",
        "hits_by_category",
        "hits_by_pattern",
        "pii_density_by_lang_source",
        "pii_vs_quality_labels",
        "sanitized_spans",
        "merged_spans",
        "nonoverlap_selection",
        "placeholder_mapping",
        "anonymized_text",
        "restore_roundtrip",
        "diagnostics_report",
        "span_line_boxes",
    ],
)
def test_query(spark, odd, name):
    against_sql(spark, odd, name)


@pytest.mark.parametrize("regex", [*dict.fromkeys(p[3] for p in P.portable() if p[3].startswith("(?i)")), "(?i)" + is_.STREET, r"(?i)x[A-ZÄÖÜ]\s\d\w\b", r"[^\s]é"])
def test_letters_of_an_expression(spark, regex):
    """Every letter, blank and digit of Unicode, one at a time, in the expression's first class or letter."""
    every = [c for c in map(chr, range(1, 0x3000)) if c.isprintable() or c.isspace()]
    shapes = ["{}", "a{}", "{}a", "Stra{}e 5", "{}trasse 5", "x{}\t1a", "xü{}1a{}", "Frau {}ab Cd", "nip{}1234567890", "{}rs 1234567890", "{}é"]
    texts = [s.replace("{}", c) for c in every for s in shapes]
    con = duckdb.connect()
    expected = con.execute("SELECT list_transform($1::VARCHAR[], lambda x: regexp_extract_all(x, $2))", [texts, regex]).fetchone()[0]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", "t").repartition(8)
    got = got.select("i", extract.F.regexp_extract_all("t", extract.F.lit(P.as_sql(regex)), extract.F.lit(0)).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == expected


def test_the_operator_keeps_unicode(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    assert extract.pattern_spans(docs).filter("pattern = 'mrz'").isEmpty()


SPELT = ["mit.\nLicense", "MIT  License", "Mit License, MIT LICENSE", "M\u0130T License", "M\u0131T License", "MIT Licen\u017fe", "cc bync", "CC BY-NC cc by-nc", "general\u00a0public", "GENERAL PUBLIC GeneralPublic", "", None]


def test_literals_as_written(spark, tmp_path):
    spark.createDataFrame(list(enumerate(SPELT)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    run = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    expected = con.execute(f"SELECT doc_id, text, span_start, span_end FROM ({catalog.ORACLES['custom_literal_spans']})").fetchall()
    assert run("custom_literal_spans") == sorted(expected) and len(expected) == 6
    assert {0, 1, 6, 8} <= {r[0] for r in run("custom_literal_spans_everything")}


def given(spark, folder, rows):
    """Documents of these (doc_id, text), and beside them no other table."""
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return lambda name, columns: (sorted(map(tuple, catalog.QUERIES[name](spark, folder).select(*columns).collect()), key=str), sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall(), key=str))


def test_findings_of_one_place(spark, tmp_path):
    """Two texts of one id have findings at the same place, and one's text begins with the other's."""
    run = given(spark, str(tmp_path), [(1, "+49301234  x"), (1, "+49301234 5x"), (2, "+49301234  x")])
    got, expected = run("diagnostics_report", ["doc_id", "report"])
    assert got == expected and len(got) == 2 and got[0][1].count("\n") == 1


def test_texts_without_id(spark, tmp_path):
    run = given(spark, str(tmp_path), [(1, "Frau Vera Holm, a@b.de"), (None, "c@d.de 10.0.0.1"), (None, "x")])
    for name, columns in (("nonoverlap_selection", ["doc_id", "category", "text", "span_start", "span_end"]), ("placeholder_mapping", ["doc_id", "placeholder", "original"])):
        got, expected = run(name, columns)
        assert got == expected and len(got) == 2, name


#: Words that look like placeholders which the text has too: before, after and beside these, and where one is put back.
ALIKE = [
    "NUMMER 1 and 4111 1111 1111 1111 and geheim-1, 10.0.0.1",
    "Telefon 11 2222 3333 4444 5555 6666 7777, +49 30 1234567; Telefon",
    "[EMAIL_1] a@b.de [email_1]2 and [EMAIL_2] c@d.de, a@b.de",
    "Frau Vera Holm, name 1. Frau Vera Holm \U0001f600 $1 \\1 a@b.de email_1",
]


def test_words_like_placeholders(spark, tmp_path):
    run = given(spark, str(tmp_path), [*enumerate(ALIKE), (9, "plain"), (10, None)])
    got, expected = run("restore_roundtrip", ["doc_id", "restored_text", "replacement_count", "unresolved"])
    assert got == expected and [r[1] for r in got] == ALIKE


def test_restored_by_place(spark):
    row = spark.createDataFrame([("x [NAME_1] [NAME_1", [(2, 10, "[NAME_1]"), (11, 19, "[NAME_1]")], {"[NAME_1]": "Vera $1"})], "t string, p array<struct<start:int,end:int,placeholder:string>>, m map<string,string>")
    assert tuple(row.select(anonymize.restore_places(F.col("t"), F.col("p"), F.col("m")).alias("r")).first().r) == ("x Vera $1 [NAME_1", 1, ["[NAME_1]"])


def test_texts_of_one_id_that_differ_in_case(spark, tmp_path, monkeypatch):
    """Of findings alike but for case SQL takes that of the first text, however Spark deals the rows out."""
    monkeypatch.setattr(session, "PIECE", 1 << 10)
    texts = [f"m{i}.x@b.de, 00:1a:2b:3c:4d:{i % 90 + 10}" for i in range(300)]
    rows = [(i, t.upper() if (i + turn) % 2 else t) for turn in range(2) for i, t in enumerate(texts)]
    run = given(spark, str(tmp_path), rows)
    got, expected = run("placeholder_mapping", ["doc_id", "placeholder", "original"])
    first = dict(reversed(rows))
    assert got == expected and len(got) == 600 and all(original in first[i] for i, _, original in got)
