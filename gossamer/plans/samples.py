"""Invented texts for what the tables don't hold: German letters, forms and recognised pages."""

from __future__ import annotations

INVOICE = (
    "Falkenberg Werkzeuge GmbH\nAm Anger 14\n04109 Lindenau\nKundin:\nFrau Vera Holm\nEichenweg 7\n39104 Buchental\n"
    "Kundennummer: 440017\nVertragsnummer: VX-2031-77\nZählernummer: 5520098\nVorgangsnummer: 9900121\n"
    "Telefon: +49 391 555 0199\nE-Mail: vera.holm@example.org\nIBAN: DE02 1203 0000 0000 2020 51\nBIC: BYLADEM1001\nRechnungsdatum: 03.02.2021\n"
)
NOTICE = (
    "Finanzamt Lindenau\nPostfach 3, 04109 Lindenau\nSteuernummer 231/444/5555\nDatum 17.05.2019\n\nHerr\nJan Falk\nUlmenallee 22\n39104 Buchental\n\nTel 0341 12/345-678\nFortsetzung nächste Seite\n"
)
LETTER = "Herr Jan Falk wohnt in der Ulmenallee 22, 39104 Buchental. Schreiben Sie an jan.falk@example.org oder jan.falk@example.org.\n"
TEXTS = [("invoice", INVOICE), ("notice", NOTICE), ("letter", LETTER)]

#: (id, category, text, source) for the predicates and the rules that drop spans.
SNIPPETS = [
    (1, "private_address", "39104 Buchental", "pattern"),
    (2, "private_address", "Eichenweg 7", "pattern"),
    (3, "private_address", "Falkenberg GmbH Eichenweg 7", "pattern"),
    (4, "private_address", "Frau Vera Holm Eichenweg 7", "pattern"),
    (5, "private_address", "12-345", "pattern"),
    (6, "private_address", "Dorf", "model"),
    (7, "private_address", "Hinterm Dorf", "model"),
    (8, "private_person", "Frau Vera Holm", "pattern"),
    (9, "private_person", "Herr Jan Falk E-Mail", "pattern"),
    (10, "private_person", "Holm AG", "model"),
    (11, "private_person", "xy", "model"),
    (12, "private_person", "Ana", "model"),
    (13, "private_person", "Falk7", "model"),
    (14, "private_person", "Fortsetzung folgt", "model"),
    (15, "account_number", "12345", "model"),
    (16, "account_number", "123456789012", "model"),
    (17, "account_number", "39104 Buchental", "pattern"),
    (18, "account_number", "Steuernummer 231", "model"),
    (19, "secret", "", "pattern"),
    (20, "private_person", "Steinkamp Finanzamt", "pattern"),
]

OCR = [
    (1, "M a x Holm"),
    (2, "Tel 0 3 4 1 / 55 12"),
    (3, "1 2 . 0 3 . 2021 und 4 , 50"),
    (4, "nothing to do"),
    (5, "a / b / c"),
    (6, "Ort: 3 9104"),
]

#: (ord, label, value, category)
LITERALS = [
    (0, "Adresse", "Eichenweg 7, 39104 Buchental", ""),
    (1, "Name", "Vera Holm", "private_person"),
    (2, "NAME", "vera holm", "private_person"),
    (3, "Adresse – Teil", "eichenweg 7", "custom_identifier"),
    (4, "", "ignored", ""),
]

_RECT = lambda x, y, w: [(float(x), float(y), float(w), 12.0)]
#: (doc_id, page_index, ord, category, snippet, source, confidence, rects): one letter's candidates on one page.
CANDIDATES = [
    ("a", 0, 0, "private_person", "Vera Holm", "model", 0.8, _RECT(60, 700, 80)),
    ("a", 0, 1, "private_address", "Eichenweg 7", "pattern", 0.99, _RECT(60, 686, 90)),
    ("a", 0, 2, "private_address", "39104 Buchental", "pattern", 0.99, _RECT(60, 672, 110)),
    ("a", 0, 3, "private_email", "vera.holm@example.org", "pattern", 0.99, _RECT(300, 100, 150)),
    ("a", 0, 4, "private_phone", "+49 391 555 0199", "pattern", 0.99, _RECT(300, 86, 120)),
    ("a", 0, 5, "account_number", "DE02120300000000202051", "pattern", 0.99, _RECT(60, 60, 160)),
    ("a", 0, 6, "account_number", "0212030000", "pattern", 0.99, _RECT(80, 60, 60)),
    ("a", 0, 7, "private_address", "Falkenberg GmbH Am Anger 14", "pattern", 0.99, _RECT(400, 20, 160)),
    ("a", 0, 8, "private_address", "04109 Lindenau", "pattern", 0.99, _RECT(400, 6, 100)),
    ("a", 0, 9, "private_person", "!!!", "model", 0.5, _RECT(10, 400, 10)),
    ("b", None, 0, "private_person", "Jan Falk", "model", 0.7, _RECT(10, 10, 60)),
    ("b", None, 1, "private_person", "Jan Falk", "pattern", 0.99, _RECT(10, 300, 60)),
    ("b", 1, 0, "private_person", "Jan Falk", "model", 0.7, _RECT(10, 10, 60)),
]
