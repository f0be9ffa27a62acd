"""Surrogates for personal data, in DataFrame operations only.

Detected entities get replacements of their own kind: the same layout, script,
letter case and gender of title, valid check digits for cards, IBANs, NRBs and PESELs. A
replacement is drawn by a keyed hash of the entity's canonical form, so the same
entity gets the same one in every document and run (coreference); replacements
that two entities of a kind would share, or that are themselves an entity of the
corpus, are drawn again, and after a few draws assigned by rank (distinctness).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import PATTERNS
from .common import cut, unused

KEY = "gossamer"
#: Draws of an entity before the rest is assigned by rank.
MAX_DRAWS = 6

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
MALE_TITLES = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "г-жа", "госпожа")
#: Titles that tell no gender; they may also follow another title.
OTHER_TITLES = ("Dr", "Prof")
_TITLES = sorted({x for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES for x in (t, t.upper(), t[0].upper() + t[1:])}, key=lambda t: (-len(t), t))
_ALSO = r"(?:(?:Dr|DR|Prof|PROF)\.?[  ])*+"
_TITLE = rf"(?=[{''.join(sorted({t[0] for t in _TITLES}))}]){_EDGE}(?:{'|'.join(_TITLES)})\.?[  ]{_ALSO}\p{{Lu}}"
_MARKERS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "eyJ")
_HEX = "[0-9A-Fa-f]{1,4}"

def _built_in(guard: str, *ids: str) -> str:
    """Expressions of the catalogue behind a look at the first character."""
    return rf"(?={guard})(?:" + "|".join(f"(?:{_scoped(_BUILT_IN[i])})" for i in ids) + ")"


def _narrowed(p: str) -> str:
    """Street or city that ends before the next entity: no part of an address or of a longer number, and of words of bounded length."""
    return p.replace(r"\-]*", r"\-]{0,60}").replace(r"\d+[A-Za-z]?\b", r"\d{1,5}[A-Za-z]?\b(?![.,:/-]\d)(?![ -]\d{4}[ -]?\d)") + r"(?![\w.%+-]*@)"


def _scoped(p: str) -> str:
    return f"(?i:{p[4:]})" if p.startswith("(?i)") else p


_BUILT_IN = {i: _narrowed(p) if i in ("german_postal_city", "german_street_house_number", "polish_street") else p for i, _, p in PATTERNS}


#: Kinds of search in order: of matches that begin at the same place, the first wins. They cover the
#: catalogue's 43 patterns, but for runs of 15 capitals without a digit or "<", house numbers over 5 digits, and four numbers of a longer dotted run. Own runs are possessive; a look at the first characters comes first, as most places fail there.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"),
    (
        "secret",
        r"(?=[0-9A-Fa-f]{8}|AKIA|gh[pousr]_|sk_live_|eyJ)" + _EDGE + r"(?:(?=\p{L}*\d)[0-9A-Fa-f]{32,}+"
        r"|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk_live_[A-Za-z0-9]{16,}+|eyJ[\w-]++\.[\w-]++\.[\w-]++)" + _END,
    ),
    (
        "iban",
        r"(?=[A-Z]{2}\d)" + _EDGE + r"(?:[A-Z]{2}\d{2}(?:[A-Z0-9]{10,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _END + "|" + _BUILT_IN["iban"] + ")",
    ),
    ("mac", _built_in("[0-9A-Fa-f]{2}[:-]", "mac_address")),
    (
        "ipv6",
        rf"(?=[0-9A-Fa-f:]{{2}})(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}(?::{_HEX}){{0,6}})?::{_HEX}(?::{_HEX}){{0,6}}|{_HEX}(?::{_HEX}){{1,6}}::)(?![\p{{L}}\p{{N}}:])"
        "|" + _built_in("[0-9A-Fa-f]{1,4}:", "ipv6"),
    ),
    ("ton", _built_in("0:|[EU]Q", "crypto_ton")),
    ("ip", rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    (
        "phone",
        r"(?=\+)(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?![ .-]?\d)"
        r"|\+(?:\d[\s.()-]*){6,14}\d(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d))|"
        + _built_in(r"\+", "phone_international"),
    ),
    ("ssn", r"(?=\d{3}-)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|" + _built_in(r"\d{3}-", "us_ssn")),
    ("nrb", _built_in(r"\d{2}", "polish_nrb")),
    (
        "card",
        r"(?=\d{4})(?:(?<![\d.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)|"
        + _BUILT_IN["credit_card_16"] + "|" + _BUILT_IN["credit_card_amex"] + ")",
    ),
    ("date", _built_in("[\"'`´’‚\\d]", "date_eu_dotted")),
    ("name", _TITLE + r"[\p{L}'’-]++(?: \p{Lu}[\p{L}'’-]++){0,2}|" + _built_in("[FfHh]", "german_honorific_name")),
    ("digits", _built_in(r"\d", "polish_zip", "german_postal_city", "zaehlernummer_labeled", "vorgangsnummer_labeled")),
    ("crypto_labeled", _built_in(r"[DdEeBbXxUuTtSsLlAa]", "crypto_labeled")),
    ("national", _built_in("[NnKkPpA-Z]", "polish_id_card", "polish_nip", "polish_krs", "polish_pesel", "uk_nino")),
    (
        "wallet",
        _built_in("[0-9A-Zabs]", "crypto_btc", "crypto_eth", "crypto_dash", "crypto_xmr", "crypto_ltc", "crypto_bch", "crypto_doge", "crypto_trx", "crypto_ada")
        + "|" + _built_in("[rl]", "crypto_xrp", "crypto_ltc"),
    ),
    ("labelled", _built_in("[A-Z0-9]", "bic_labeled", "kundennummer_labeled", "vertragsnummer_labeled")),
    ("mrz", r"\b(?=[A-Z]*+[0-9<])" + _BUILT_IN["mrz"]),
    ("street", _built_in(r"\p{L}", "polish_street", "german_street_house_number")),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: What stands before a value in its mention and stays.
LABEL = r"^(?i:(?:Digital\s+Currency\s+Address:?\s*)?(?:ETH|BTC|XBT|BNB|USDT|USDC|TRX|SOL|XRP|LTC|DASH|XMR|BCH|DOGE|ADA|TON)[:\s]+(?=[A-Za-z0-9]{26})|(?:NIP|KRS|PESEL)[:.\s\-]+(?=\d))"
_NAME_LABEL = r"^(?:[\p{L}-]+\.?[\s ]+)" + r"(?:(?:Dr|DR|Prof|PROF)\.?[\s ]+)*"
#: Streets' types, which stay.
_STREET = r"(?:straße|strasse|str|weg|allee|platz|gasse|ring|ufer)(?=\d+[a-z]?$)|^(?:ul|al|pl|os)(?=\p{L})"
_BECH = r"^(?:bc1|ltc1|addr1|stake1|bitcoincash:)"

#: First names for surrogates by gender and script; surnames are made of syllables.
FIRST = {
    ("male", "latin"): "Adam Bruno Carl Dario Emil Felix Gustav Hugo Ivo Jonas Leo Marco Nils Oscar Paul Rafael",
    ("female", "latin"): "Ada Berta Clara Diana Elisa Flora Greta Helena Ida Julia Lena Maria Nora Olga Paula Rosa",
    ("male", "cyrillic"): "Антон Борис Глеб Денис Егор Иван Кирилл Лев",
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия",
}
FIRST |= {("other", script): f"{FIRST['male', script]} {FIRST['female', script]}" for script in ("latin", "cyrillic")}
GENDERS = ("male", "female", "other")
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke la le lo ma me mi na ne no ra re ri sa se ta te ti va ve zo",
    "cyrillic": "ба бе бо ва ве да де до га ка ки ла ле ло ма ме ми на не но ра ре ри са се та те ти ту ру зо зе",
}


#: The values that a place of a template may take, by the private-use character that stands for it there.
_VALUES = {
    "digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789abcdef", "hex letter": "abcdef",
    "digit 58": "123456789", "upper 58": "ABCDEFGHJKLMNPQRSTUVWXYZ", "lower 58": "abcdefghijkmnopqrstuvwxyz", "bech": "qpzry9x8gf2tvdw0s3jn54khce6mua7l",
    "consonant": "bcdfghjklmnprstvwz", "vowel": "aeiou", "nino": "ABCEGHJKLMNPRSTWXYZ", "nino end": "ABCD",
    "octet": [str(i) for i in range(1, 255)], "day": [f"{i:02d}" for i in range(1, 29)], "month": [f"{i:02d}" for i in range(1, 13)], "one to nine": "123456789", "century": ["18", "19", "20"],
    **{f"first {g} {script}": names.split() for (g, script), names in FIRST.items()},
    **{f"begin {script}": x.title().split() for script, x in SYLLABLES.items()},
    **{f"syllable {script}": x.split() for script, x in SYLLABLES.items()},
}
MARK = {name: chr(0xE000 + i) for i, name in enumerate(_VALUES)}
#: Where check digits go: Luhn's and PESEL's at the end, those of an IBAN or NRB within or before it.
LUHN, PESEL, IBAN, NRB = (chr(0xE100 + i) for i in range(4))


def may_match(text: Column) -> Column:
    """What every text with an entity has: a digit, an @, a token's marker, a title or label, or a long run. Much cheaper than the search."""
    out = F.contains(text, F.lit("@")) | text.rlike("[0-9]")
    for marker in (*_MARKERS, "BIC:", "nummer:"):
        out = out | F.contains(text, F.lit(marker))
    runs = r"[A-Z<]{15}|[A-Za-z]{25}|[EU]Q[A-Za-z_-]{46}|(?:[A-Fa-f]{1,4}:){2}|::[A-Fa-f]|[A-Fa-f]::|(?:[A-Fa-f]{2}-){5}|\b(?i:frau|herr)\s"
    return out | text.rlike(_TITLE) | text.rlike(runs)


def matches(text: Column) -> Column:
    """All entities as written, in order; none for a null text."""
    return F.when(may_match(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(m: Column) -> Column:
    """The kind of a whole match. It goes by the match alone, so a value has one kind with and without a label before it."""
    whole = dict(KINDS)
    v, digits = F.regexp_replace(m, LABEL, ""), F.length(F.regexp_replace(m, r"\D", ""))
    title = F.lower(F.regexp_extract(m, r"^([\p{L}-]+)\.?[\s ]", 1))
    lowered = lambda names: [n.lower() for n in names]
    out = F.when(F.contains(m, F.lit("@")), "email").when(F.startswith(m, F.lit("+")), "phone")
    for kind in ("pesel", "nip", "krs"):
        out = out.when(m.rlike(rf"^(?i:{kind})[:.\s\-]+\d"), kind)
    for kind in ("ssn", "ip", "mac"):
        out = out.when(m.rlike(f"^(?:{whole[kind]})$"), kind)
    out = out.when(v.rlike("^0:[a-f0-9]{64}$|^0x[a-fA-F0-9]{40}$"), "wallet_hex").when(m.rlike(f"^(?:{whole['ipv6']})$"), "ipv6").when(m.rlike(f"^(?:{whole['date']})$"), "date")
    out = out.when(m.rlike(r"^\d{2}-\d{3}$"), "postcode").when(m.rlike(r"^[\d\s-]+$") & (digits == 26), "nrb").when(m.rlike(r"^[\d\s-]+$") & digits.between(13, 19), "card")
    out = out.when(v.rlike("^(?:AKIA|gh[pousr]_|sk_live_|eyJ)"), "token").when(v.rlike("^[0-9A-Fa-f]{32,}$") & v.rlike("[0-9]"), "hex")
    for kind, titles in (("male", MALE_TITLES), ("female", FEMALE_TITLES), ("other", OTHER_TITLES)):
        out = out.when(title.isin(lowered(titles)) & ~m.rlike(r"\d"), f"name_{kind}")
    out = out.when(m.rlike(r"^[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]$"), "nino").when(m.rlike(r"^[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){10,30}$"), "iban")
    out = out.when(m.rlike(r"^[A-Z]{3}\s+(?:nr\s+)?\d{6}$"), "id_card").when(v.rlike(_BECH), "wallet_bech").when(v.rlike("[a-z]") & v.rlike(r"^[\w-]{25,}$"), "wallet")
    return out.when(m.rlike(r"(?i)^(?:ul|al|pl|os)\.\s|^\d{5}\s*\p{L}|^\p{L}.*(?:straße|str\.|strasse|weg|allee|platz|gasse|ring|ufer)\s*\d+[A-Za-z]?$"), "address").otherwise("other")


def canonical(kind: Column, m: Column) -> Column:
    """What all mentions of an entity share: without layout, case (where it says nothing), label or title."""
    v = F.regexp_replace(m, LABEL, "")
    return (
        F.when(kind.isin("phone", "ssn", "card", "nrb", "postcode", "pesel", "nip", "krs"), F.regexp_replace(m, r"\D", ""))
        .when(kind.isin("iban", "nino"), F.regexp_replace(m, r"\s", ""))
        .when(kind == "id_card", F.regexp_replace(m, "[^A-Z0-9]", ""))
        .when(kind == "date", F.regexp_replace(F.regexp_replace(m, r"[^\d.,/]", ""), "[,/]", "."))
        .when(kind == "mac", F.lower(F.regexp_replace(m, "[:-]", "")))
        .when(kind == "address", F.lower(F.regexp_replace(m, r"[^\p{L}\p{N}]", "")))
        .when(kind.isin("email", "ipv6"), F.lower(m))
        .when(kind.startswith("name"), F.lower(F.regexp_replace(F.regexp_replace(m, _NAME_LABEL, ""), r"\s+", " ")))
        .when(kind.isin("hex", "wallet_hex", "wallet_bech"), F.lower(v))
        .otherwise(v)
    )


def _pad(key: str, *parts: Column) -> Column:
    """Keyed hexadecimal digits, 1024 of them, for one draw of one entity."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 512) for i in range(8)])


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _marks(text: Column, keep: Column | int = 0, digit: str = "digit", upper: str = "upper", lower: str = "lower") -> Column:
    """A template: letters and digits from the ``keep``-th on become marks of their class, all else stays."""

    def mark(c: Column, i: Column) -> Column:
        return F.when(i < keep, c).when(c.rlike(r"\p{N}"), MARK[digit]).when(c.rlike(r"\p{Lu}"), MARK[upper]).when(c.rlike(r"\p{L}"), MARK[lower]).otherwise(c)

    return F.transform(_chars(text), mark)


def _values() -> Column:
    return F.create_map(*[x for name, of in _VALUES.items() for x in (F.lit(MARK[name]), F.array(*[F.lit(v) for v in of]))])


def luhn(digits: Column, shift: int = 0) -> Column:
    """Luhn sum modulo 10; with shift 1, of digits that still lack their check digit."""

    def add(acc: Column, d: Column) -> Column:
        twice = d * 2
        part = F.when(acc["i"] % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
        return F.struct((acc["s"] + part).alias("s"), (acc["i"] + 1).alias("i"))

    start = F.struct(F.lit(0).alias("s"), F.lit(shift).alias("i"))
    return F.aggregate(F.transform(F.reverse(_chars(digits)), lambda c: c.cast("int")), start, add, lambda a: F.pmod(a["s"], F.lit(10)))


def mod97(text: Column) -> Column:
    """Remainder of letters (A is 10) and digits read as a number."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + c.try_cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(_chars(text), F.lit(0), add)


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canon, number, ...) with surrogate set to the ``number``-th replacement."""
    padded = entities.withColumns({"pad": _pad(key, F.col("kind"), F.col("canon"), F.col("number").cast("string")), "places": template(F.col("kind"), F.col("canon"), key)})

    def put(c: Column, i: Column) -> Column:
        word = F.conv(F.substr("pad", (F.pmod(i, F.lit(256)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
        of = F.try_element_at(_values(), c)
        return F.when(of.isNull(), c).otherwise(F.element_at(of, word % F.size(of) + 1))

    filled = padded.withColumn("filled", F.array_join(F.transform("places", put), ""))
    return filled.withColumn("surrogate", checked(F.col("filled"))).drop("pad", "places", "filled")


def nth(places: Column, n: Column) -> Column:
    """The ``n``-th filling of a template, counted from 0; all are different."""

    def put(acc: Column, c: Column) -> Column:
        of = F.try_element_at(_values(), c)
        size = F.coalesce(F.size(of), F.lit(1)).cast("long")
        value = F.when(of.isNull(), c).otherwise(F.element_at(of, (acc["rest"] % size + 1).cast("int")))
        return F.struct(F.concat(acc["out"], value).alias("out"), F.floor(acc["rest"] / size).cast("long").alias("rest"))

    return F.aggregate(places, F.struct(F.lit("").alias("out"), n.cast("long").alias("rest")), put, lambda a: a["out"])


def room(places: Column) -> Column:
    """How many fillings a template has."""
    return F.aggregate(places, F.lit(1.0), lambda a, c: a * F.when(F.try_element_at(_values(), c).isNull(), 1.0).otherwise(F.size(F.try_element_at(_values(), c)).cast("double")))


def wider(kind: Column, places: Column) -> Column:
    """A template with one more place: a letter before a mail address, a syllable, a hexadecimal or decimal digit after others."""
    more = F.when(kind == "email", MARK["lower"]).when(kind.isin("hex", "mac", "wallet_hex"), MARK["hex"])
    more = F.array(more.when(kind.startswith("name"), MARK["syllable latin"]).otherwise(MARK["digit"]))
    last = F.element_at(places, -1)
    at_end = F.when(last.isin(LUHN, PESEL), F.concat(F.slice(places, F.lit(1), F.size(places) - 1), more, F.array(last))).otherwise(F.concat(places, more))
    return F.when(kind == "email", F.concat(more, places)).otherwise(at_end)


def template(kind: Column, canon: Column, key: str) -> Column:
    """What a surrogate of a canonical form looks like: characters that stay, marks of values and of check digits."""
    size = F.length(canon)
    some = lambda name, n: F.array_repeat(F.lit(MARK[name]), n)
    fixed = lambda x: F.array(F.lit(x))
    # The same mail domain stays the same; it moves to a name reserved for examples.
    at, domain = F.instr(canon, "@"), F.substr(canon, F.instr(canon, "@") + 1)
    email = F.concat(_marks(F.substr(canon, F.lit(1), at - 1)), _chars(F.concat(F.lit("@m"), F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), F.lit(1), F.lit(10)), F.lit(".example.com"))))
    card = F.when(luhn(canon) == 0, F.concat(_marks(F.substr(canon, F.lit(1), size - 1), 1), fixed(LUHN))).otherwise(_marks(canon, 1))
    iban = F.concat(_chars(F.substr(canon, F.lit(1), F.lit(2))), fixed(IBAN), _marks(F.substr(canon, F.lit(5))))
    octet = some("octet", 1)
    ip = F.concat(octet, *[x for _ in range(3) for x in (fixed("."), octet)])
    part = lambda i: F.length(F.split_part(canon, F.lit("."), F.lit(i)))
    day_month = [x for i, two in ((1, "day"), (2, "month")) for x in (F.when(part(i) == 2, some(two, 1)).otherwise(some("one to nine", 1)), fixed("."))]
    date = F.concat(*day_month, F.when(part(3) == 4, some("century", 1)).otherwise(F.array().cast("array<string>")), some("digit", 2))
    # Words of an address are spelled anew by consonants and vowels in turn; the street's type stays.
    kept = F.regexp_extract(canon, _STREET, 0)
    at_kept = F.when(kept != "", F.regexp_instr(canon, F.lit(_STREET)) - 1).otherwise(-1)

    def spell(c: Column, i: Column) -> Column:
        letter = F.when(i % 2 == 0, MARK["consonant"]).otherwise(MARK["vowel"])
        return F.when((at_kept >= 0) & (i >= at_kept) & (i < at_kept + F.length(kept)), c).when(c.rlike(r"\p{N}"), MARK["digit"]).otherwise(letter)

    head = F.when(canon.rlike("^(?:Ae2|Ddz)"), 5).otherwise(2)
    token = F.when(F.startswith(canon, F.lit("sk_live_")), 8).when(canon.rlike("^(?:AKIA|gh)"), 4).otherwise(3)

    def name(gender: str, script: str) -> Column:
        surname = F.concat(some(f"begin {script}", 1), some(f"syllable {script}", 3))
        words = F.split(canon, " ")
        # A single word is a surname; of several the first is a first name.
        return F.flatten(F.transform(words, lambda w, i: F.when(i == 0, F.when(F.size(words) > 1, some(f"first {gender} {script}", 1)).otherwise(surname)).otherwise(F.concat(fixed(" "), surname))))

    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", ip).when(kind == "date", date)
    out = out.when(kind == "phone", _marks(canon, F.when(canon.rlike("^[17]"), 1).otherwise(2))).when(kind == "nrb", F.concat(fixed(NRB), some("digit", 24)))
    out = out.when(kind == "pesel", F.concat(some("digit", 10), fixed(PESEL))).when(kind == "nino", F.concat(some("nino", 2), some("digit", 6), some("nino end", 1)))
    out = out.when(kind.isin("hex", "mac"), F.array_repeat(F.lit(MARK["hex"]), size)).when(kind == "ipv6", _marks(canon, 0, lower="hex letter"))
    out = out.when(kind == "wallet_hex", F.concat(_chars(F.substr(canon, F.lit(1), F.lit(2))), F.array_repeat(F.lit(MARK["hex"]), size - 2)))
    bech = F.length(F.regexp_extract(canon, _BECH, 0))
    out = out.when(kind == "wallet_bech", F.concat(_chars(F.substr(canon, F.lit(1), bech)), F.array_repeat(F.lit(MARK["bech"]), size - bech)))
    out = out.when(kind == "wallet", _marks(canon, head, "digit 58", "upper 58", "lower 58")).when(kind == "address", F.transform(_chars(canon), spell)).when(kind == "token", _marks(canon, token))
    for gender in GENDERS:
        out = out.when(kind == f"name_{gender}", F.when(canon.rlike(r"\p{IsCyrillic}"), name(gender, "cyrillic")).otherwise(name(gender, "latin")))
    return out.otherwise(_marks(canon))


def checked(text: Column) -> Column:
    """A filled template with the check digits that it has marks for."""
    body = F.regexp_replace(text, f"[{LUHN}{PESEL}{IBAN}{NRB}]", "")
    land, account = F.substr(body, F.lit(1), F.lit(2)), F.substr(body, F.lit(3))
    two = lambda rest: F.lpad((98 - mod97(F.concat(rest, F.lit("00")))).cast("string"), 2, "0")
    weights = F.array(*[F.lit(w) for w in (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)])
    weighed = F.aggregate(F.transform(_chars(body), lambda c, i: c.try_cast("int") * F.element_at(weights, i % 10 + 1)), F.lit(0), lambda a, x: a + x)
    return (
        F.when(F.contains(text, F.lit(LUHN)), F.concat(body, F.pmod(F.lit(10) - luhn(body, 1), F.lit(10)).cast("string")))
        .when(F.contains(text, F.lit(PESEL)), F.concat(body, F.pmod(10 - weighed % 10, F.lit(10)).cast("string")))
        .when(F.contains(text, F.lit(IBAN)), F.concat(land, two(F.concat(account, land)), account))
        .when(F.contains(text, F.lit(NRB)), F.concat(two(F.concat(body, F.lit("PL"))), body))
        .otherwise(body)
    )


def render(kind: Column, m: Column, surrogate: Column) -> Column:
    """A surrogate in the layout of the mention it stands for."""
    label = F.regexp_extract(m, LABEL, 0)
    v = F.substr(m, F.length(label) + 1)
    filled = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")

    def fill(acc: Column, c: Column) -> Column:
        takes = F.when(kind == "id_card", c.rlike("[A-Z0-9]")).otherwise(c.rlike(r"[\p{L}\p{N}]"))
        new = F.substr(filled, acc["at"], F.lit(1))
        # An address has the mention's capitals.
        new = F.when((kind == "address") & c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        return F.struct(F.concat(acc["out"], F.when(takes, new).otherwise(c)).alias("out"), F.when(takes, acc["at"] + 1).otherwise(acc["at"]).alias("at"))

    laid = F.concat(label, F.aggregate(_chars(v), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), fill, lambda a: F.concat(a["out"], F.substr(filled, a["at"]))))
    upper = (v == F.upper(v)) & (v != F.lower(v))
    title = F.regexp_extract(m, _NAME_LABEL, 0)
    return (
        F.when(kind.isin("mac", "ipv6"), F.when(upper, F.upper(laid)).otherwise(laid))
        .when(kind.isin("phone", "ssn", "card", "iban", "nrb", "postcode", "pesel", "nip", "krs", "nino", "id_card", "date", "address"), laid)
        .when(kind.startswith("name"), F.concat(title, F.when(F.substr(m, F.length(title) + 1) == F.upper(F.substr(m, F.length(title) + 1)), F.upper(surrogate)).otherwise(surrogate)))
        .when(kind.isin("email", "hex") & upper, F.concat(label, F.upper(surrogate)))
        .otherwise(F.concat(label, surrogate))
    )


def _known_as(kind: Column, surrogate: Column) -> Column:
    """A surrogate as the canonical form that it would be found as."""
    return F.when(kind.startswith("name"), F.lower(surrogate)).otherwise(surrogate)


def assign(entities: DataFrame, key: str = KEY, widen: bool = False) -> DataFrame:
    """(kind, canon, surrogate) of distinct (kind, canon): surrogates differ from each other and from all entities of their kind.

    A surrogate that more than one entity drew stays with the least of them; the
    others, and those that drew an entity of the corpus, draw again. What is left
    after MAX_DRAWS draws gets the unused values of its template by rank. Where all
    values of a template are used, the rest gets one of a longer form if ``widen``
    is set, and else it is an error.
    """
    taken = entities.select(F.col("kind").alias("t_kind"), F.col("canon").alias("t_canon"))
    now = cut(drawn(entities.select("kind", "canon", F.lit(0).alias("number")), key), "surrogates-0")
    for number in range(1, MAX_DRAWS + 1):
        first = F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("number", "canon"))
        judged = now.withColumn("turn", first).join(taken, (F.col("kind") == F.col("t_kind")) & (_known_as(F.col("kind"), F.col("surrogate")) == F.col("t_canon")), "left")
        judged = judged.withColumn("again", (F.col("turn") > 1) | F.col("t_canon").isNotNull()).select("kind", "canon", "number", "surrogate", "again").distinct()
        judged = cut(judged, f"surrogates-judged-{number}")
        if judged.filter("again").isEmpty():
            return judged.select("kind", "canon", "surrogate")
        kept = judged.filter(~F.col("again")).select("kind", "canon", "number", "surrogate")
        if number < MAX_DRAWS:
            again = drawn(judged.filter("again").select("kind", "canon", (F.col("number") + 1).alias("number")), key)
            now = cut(kept.unionByName(again), f"surrogates-{number}")
    left = judged.filter("again").select("kind", "canon", template(F.col("kind"), F.col("canon"), key).alias("places"))
    return _by_rank(kept.select("kind", "canon", "surrogate"), left, taken, key, widen)


def _by_rank(kept: DataFrame, left: DataFrame, taken: DataFrame, key: str, widen: bool) -> DataFrame:
    """``kept`` and for each row of ``left`` (kind, canon, places) a value of its template that is not in use.

    Of a kind with n entities, less than 2 n values are in use or wanted, so of each
    template so many are tried. Only templates that draws have all but filled come here.
    """
    members = taken.groupBy(F.col("t_kind").alias("kind")).agg((2 * F.count("*")).alias("most"))
    keyed = lambda c: F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", c), 256)
    step = 0
    while True:
        step += 1
        left = cut(left.withColumn("space", F.array_join("places", "")), f"surrogates-left-{step}")
        if left.isEmpty():
            return kept
        spaces = left.select("kind", "space", "places").distinct().join(F.broadcast(members), "kind")
        n = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("most").cast("double"), room(F.col("places"))).cast("long") - 1)).alias("n")
        filled = spaces.select("kind", "space", "places", n).withColumn("filled", nth(F.col("places"), F.col("n")))
        values = filled.withColumn("surrogate", checked(F.col("filled"))).groupBy("kind", "surrogate").agg(F.min("space").alias("space"))
        used = kept.select(F.col("kind").alias("u_kind"), F.col("surrogate").alias("u_surrogate"))
        free = values.join(used, (F.col("kind") == F.col("u_kind")) & (F.col("surrogate") == F.col("u_surrogate")), "left_anti")
        free = free.join(taken, (F.col("kind") == F.col("t_kind")) & (_known_as(F.col("kind"), F.col("surrogate")) == F.col("t_canon")), "left_anti")
        rank = lambda c: F.row_number().over(W.partitionBy("kind", "space").orderBy(keyed(c), c))
        free = free.withColumn("turn", rank("surrogate"))
        matched = cut(left.withColumn("turn", rank("canon")).join(free, ["kind", "space", "turn"], "left"), f"surrogates-ranked-{step}")
        got = matched.filter("surrogate is not null").select("kind", "canon", "surrogate")
        left = matched.filter("surrogate is null").select("kind", "canon", "places", "space")
        # Values that a lesser template also has went to that one; a template that got none now is full.
        full = left.join(matched.filter("surrogate is not null").select("kind", "space").distinct(), ["kind", "space"], "left_anti")
        if not widen and not full.isEmpty():
            raise ValueError("a kind of entity has more members than surrogates")
        part = left.join(full.select("kind", "space").distinct(), ["kind", "space"], "left_anti").select("kind", "canon", "places")
        left = part.unionByName(full.select("kind", "canon", wider(F.col("kind"), F.col("places")).alias("places")))
        kept = cut(kept.unionByName(got), f"surrogates-kept-{step}")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...) with surrogates in the texts, and n_entities and entity_kinds.

    Texts without entities stay as they are, null ones too. Rows that repeat are
    kept. Columns named n_entities or entity_kinds are replaced, all others stay,
    whatever their names.
    """
    docs = docs.drop("n_entities", "entity_kinds")
    columns = docs.columns
    at, row, size, table, kinds = unused(docs, "pii_found", "pii_row", "pii_size", "pii_map", "pii_kinds")
    found = docs.withColumn(at, matches(F.col("text")))
    hits = found.filter(F.size(at) > 0).withColumn(row, F.xxhash64("text")).withColumn(size, F.length("text"))
    hits = cut(hits, "pii-texts")
    mention = F.explode(F.array_distinct(at)).alias("m")
    mentions = hits.select(F.col(row).alias("pii_row"), F.col(size).alias("pii_size"), mention).withColumn("kind", kind_of(F.col("m"))).withColumn("canon", canonical(F.col("kind"), F.col("m")))
    mentions = cut(mentions, "pii-mentions")
    surrogates = assign(mentions.select("kind", "canon").distinct(), key, widen=True)
    # A text's mentions and what stands for them; the same text needs it once.
    known = mentions.distinct().join(surrogates, ["kind", "canon"]).withColumn("put", render(F.col("kind"), F.col("m"), F.col("surrogate")))
    of_text = known.groupBy(F.col("pii_row").alias(row), F.col("pii_size").alias(size)).agg(F.map_from_entries(F.collect_list(F.struct("m", "put"))).alias(table), F.collect_set("kind").alias(kinds))
    gaps = F.split("text", PATTERN, -1)
    put = F.transform(F.concat(at, F.array(F.lit(None).cast("string"))), lambda m: F.when(m.isNull(), "").otherwise(F.element_at(F.col(table), m)))
    changed = hits.join(of_text, [row, size], "left").select(
        *[F.array_join(F.zip_with(gaps, put, lambda a, b: F.concat(a, b)), "").alias("text") if c == "text" else F.col(c) for c in columns],
        F.size(at).cast("long").alias("n_entities"),
        F.array_join(F.array_sort(kinds), ",").alias("entity_kinds"),
    )
    same = found.filter(F.size(at) == 0).select(*columns, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))
    return same.unionByName(changed)
