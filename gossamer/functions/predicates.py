"""What a snippet looks like, as Boolean column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, compact_ascii, comparable

# These expressions and words decide which findings are kept.
POSTAL_CITY = r"^(?:D\s*-\s*)?\d{5}\s+[A-ZÄÖÜa-zäöüß][A-Za-zÄÖÜäöüß]+(?:[ -][A-Za-zÄÖÜäöüß]+){0,2}$"
STREET = r"\b(?:[A-ZÄÖÜa-zäöüß][A-Za-zÄÖÜäöüß.\-]*\s+){0,3}[A-ZÄÖÜa-zäöüß][A-Za-zÄÖÜäöüß.\-]*(?:straße|str\.|strasse|weg|allee|platz|gasse|ring|ufer)\s*\d+[A-Za-z]?\b"
STREET_APART = r"\b(?:[A-ZÄÖÜa-zäöüß][A-Za-zÄÖÜäöüß.\-]*\s+){0,3}(?:[A-ZÄÖÜa-zäöüß][A-Za-zÄÖÜäöüß.\-]*(?:straße|str\.|strasse)|weg|allee|platz|gasse|ring|ufer)\s*\d+[A-Za-z]?\b"
HONORIFIC = r"(?:frau|herr)\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]+(?:\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]+){1,2}\s+"
ORGANIZATION = r"\b(?:gmbh|mbh|ag|ug|kg|ohg|gbr|llc|ltd|inc)\b"
NUMBER = r"\b\d+[A-Za-z]?\b"
NAME = r"^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]+(?:\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]+){0,2}$"
BARE_CITY = r"^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]{3,}$"
PERSON_TAIL = r"^(?:D\s*-\s*)?\d{5}\s+[A-ZÄÖÜa-zäöüß]+(?:\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+){2,}$"
POSTAL_PREFIX = r"^(?:D\s*-\s*)?\d{5}\s+"
CONTACT_FRAGMENTS = ("email", "telefon", "mobil", "kontakt", "ansprechpartner", "strasse", "straße", "str", "weg", "allee", "platz", "gasse", "ring", "ufer")
NOISE_FRAGMENTS = ("eink", "einkommensteuer", "kirchensteuer", "solidaritatszuschlag", "fortsotzung", "fortsetzung", "nachsteseite", "nachsteselte", "selto", "luszetch", "reste", "ruckfragen", "angeben")
TAX_WORDS = ("finanzamt", "finanzkasse", "steuernummer", "idnr", "bescheid")
AUTHORITY_WORDS = ("finanzamt", "finanzkasse", "steuernummer", "idnr")


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def as_is(regex: str) -> str:
    """What the predicates run of an expression, if not told otherwise."""
    return regex


def postal_city(x: Column, run=as_is) -> Column:
    return collapse(x).rlike(run("(?i)" + POSTAL_CITY))


def street(x: Column, run=as_is) -> Column:
    return collapse(x).rlike(run("(?i)" + STREET))


def street_apart(x: Column) -> Column:
    """The stricter form used in review: a bare ending must stand alone."""
    return collapse(x).rlike("(?i)" + STREET_APART)


def _block(x: Column, run=as_is) -> Column:
    return collapse(x).rlike(run(r"(?i)\b" + HONORIFIC + r".+\d{5}\s+[A-ZÄÖÜa-zäöüß]"))


def address_block(x: Column, run=as_is) -> Column:
    return postal_city(x, run) | street(x, run) | _block(x, run)


def address_block_apart(x: Column) -> Column:
    return postal_city(x) | street_apart(x) | _block(x)


def organization(x: Column, run=as_is) -> Column:
    return F.trim(x).rlike(run("(?i)" + ORGANIZATION))


def company_block(x: Column, run=as_is) -> Column:
    return organization(collapse(x), run) & (street(x, run) | postal_city(x, run) | collapse(x).rlike(run(NUMBER)))


def company_block_apart(x: Column) -> Column:
    return organization(collapse(x)) & (street_apart(x) | postal_city(x) | collapse(x).rlike(NUMBER))


def contact_tail(x: Column, run=as_is) -> Column:
    """A titled person whose span runs into an address or contact word."""
    cleaned, folded = collapse(x), comparable(collapse(x))
    return (F.contains(folded, F.lit("frau")) | F.contains(folded, F.lit("herr"))) & (street(x, run) | contains_any(F.lower(cleaned), CONTACT_FRAGMENTS) | contains_any(folded, CONTACT_FRAGMENTS))


def honorific_street(x: Column, run=as_is) -> Column:
    return ~postal_city(x, run) & street(x, run) & collapse(x).rlike(run("(?i)^" + HONORIFIC))


def nameish(x: Column) -> Column:
    cleaned = F.trim(x)
    return (F.length(cleaned) >= 3) & ~cleaned.rlike(r"\p{Nd}") & cleaned.rlike(NAME)


def tax_header(x: Column) -> Column:
    return contains_any(comparable(x), TAX_WORDS)


def authority(x: Column) -> Column:
    return contains_any(compact_ascii(x), AUTHORITY_WORDS)


def noise(x: Column) -> Column:
    return contains_any(comparable(x), NOISE_FRAGMENTS)


def bare_city(x: Column) -> Column:
    return F.trim(x).rlike(BARE_CITY)


def person_tail(x: Column) -> Column:
    return collapse(x).rlike("(?i)" + PERSON_TAIL)


def city_name(x: Column) -> Column:
    """What follows the postal code, or null."""
    cleaned = collapse(x)
    return F.when(cleaned.rlike(POSTAL_PREFIX + ".+$"), F.nullif(F.trim(F.regexp_replace(cleaned, POSTAL_PREFIX, "")), F.lit("")))
