"""Entities of the catalogue's kinds are replaced whole, in their layout."""

import re
import time

import pytest

from gossamer.llm import surrogates

IBANS = ["GB29NWBK60161331926819", "FR1420041010050500013M02606", "FR14 2004 1010 0505 0001 3M02 606", "NL91ABNA0417164300", "MT84MALT011000012345MTLCAST001S"]
WHOLE = [
    *IBANS,
    *("2001:db8:0:1:2:3:4:5", "2001:db8::1", "00:1B:44:11:3A:B7", "AB 12 34 56 C", "0x52908400098527886E0F7030069857D2E4169EE7", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    *("bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "0123456789abcdef" * 5, "aB" * 20 + "1", "03.04.2024", "12345 Berlin", "00-950", "ABC nr 123456", "61 1090 1014 0000 0712 1981 2874"),
    *("P<UTOERIKSSON<<ANNA", "+49 30 12 34 56 78 90"),
]
#: (what stays, what goes)
AFTER = [
    *(("Dr. ", "Anna Schmidt"), ("Frau Dr. ", "Anna Schmidt"), ("PESEL: ", "44051401359"), ("NIP: ", "123-456-32-18"), ("KRS: ", "0000123456"), ("BTC: ", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")),
    *(("BIC: ", "DEUTDEFF500"), ("Kundennummer: ", "AB-123456"), ("Vertragsnummer: ", "V123-456"), ("Zählernummer: ", "1234567"), ("Vorgangsnummer: ", "998877"), ("ul. ", "Długa 5")),
]


def layout(text):
    return re.sub(r"[^\W_]", "x", text)


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [("", e) for e in WHOLE] + AFTER
    docs = spark.createDataFrame([(i, f"See ({before}{e}); it is so.") for i, (before, e) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace(docs).collect()}
    return [(before, e, got[i]) for i, (before, e) in enumerate(rows)]


def test_whole_entities(replaced):
    for before, e, row in replaced:
        m = re.fullmatch(re.escape(f"See ({before}") + r"(.*)\); it is so\.", row.text, re.S)
        assert row.n_entities == 1 and m, (e, row)
        new = m[1]
        # No run of six characters is left, but at the beginning.
        assert new != e and not any(e[i : i + 6] in new for i in range(5, len(e) - 5)), (e, new)
        if not row.entity_kinds.startswith("name"):
            assert layout(new) == layout(e), (e, new)


def test_check_digits(replaced):
    by = {e: re.search(r"\((?:PESEL: )?(.*)\)", row.text)[1] for _, e, row in replaced}
    for e in IBANS:
        packed = by[e].replace(" ", "")
        assert packed[:2] == e[:2] and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
    nrb = by["61 1090 1014 0000 0712 1981 2874"].replace(" ", "")
    assert int(nrb[2:] + "2521" + nrb[:2]) % 97 == 1
    pesel = by["44051401359"]
    assert sum(int(c) * w for c, w in zip(pesel, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), strict=True)) % 10 == 0
    assert by["FR14 2004 1010 0505 0001 3M02 606"].replace(" ", "") == by["FR1420041010050500013M02606"]


def test_neighbours_stay_whole(spark):
    """An address ends before a card, an IP address or a mail address, and a label does not change a value's surrogate."""
    texts = ["zum ring 8646308210557563", "am weg 12.10.20.30", "am ring 12.ab@x.org", "VONENSTKEITLICH", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa BTC: 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "a-" * 50_000, "a." * 50_000]
    began = time.time()
    out = [r for r in sorted(surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())]
    assert [r.entity_kinds for r in out] == ["card", "ip", "email", "", "wallet", "", ""] and time.time() - began < 120
    one, two = out[4].text.split(" BTC: ")
    assert one == two
