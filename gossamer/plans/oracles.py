"""DuckDB SQL for the checking engine, written apart from the DataFrame plans."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import predicates as is_
from ..functions.text import ACCENTED, PLAIN


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows, columns: str) -> str:
    """Rows as a table expression."""
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS v({columns})"


def fold(x: str) -> str:
    return f"translate(lower({x}), {lit(ACCENTED)}, {lit(PLAIN)})"


def comparable(x: str) -> str:
    return rf"regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}]', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(f"replace({x}, ' / ', chr(10))")


LENGTHS = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"


def spans(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs ending in spans(doc_id, ord, pattern, category, text, a, b): all matches of the portable patterns."""
    each = " UNION ALL ".join(
        f"SELECT {key} AS doc_id, {o} AS ord, {lit(i)} AS pattern, {lit(c)} AS category, regexp_extract_all(text, {lit(r)}) AS m, string_split_regex(text, {lit(r)}) AS g FROM {table} WHERE regexp_matches(text, {lit(r)})"
        for o, i, c, r in P.portable()
    )
    return f"""raw AS ({each}),
numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
spans AS (SELECT doc_id, ord, pattern, category, m[i] AS text, ({LENGTHS.format('g[1:i]')} + {LENGTHS.format('m[1:i-1]')})::BIGINT AS a,
  ({LENGTHS.format('g[1:i]')} + {LENGTHS.format('m[1:i]')})::BIGINT AS b FROM numbered)"""


def matches(x: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({x}, {lit(flags + pattern)})"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def predicate(name: str, x: str) -> str:
    c = collapse(x)
    postal, street = matches(c, is_.POSTAL_CITY), matches(c, is_.STREET)
    block = matches(c, r"\b" + is_.HONORIFIC + r".+\d{5}\s+[A-ZÄÖÜa-zäöüß]")
    organization = matches(f"trim({x})", is_.ORGANIZATION)
    return {
        "postal": postal,
        "street": street,
        "block": f"({postal} OR {street} OR {block})",
        "organization": organization,
        "company": f"({matches(c, is_.ORGANIZATION)} AND ({street} OR {postal} OR {matches(c, is_.NUMBER, '')}))",
        "tail": f"((contains({comparable(c)}, 'frau') OR contains({comparable(c)}, 'herr')) AND ({street} OR {any_of(f'lower({c})', is_.CONTACT_FRAGMENTS)} OR {any_of(comparable(c), is_.CONTACT_FRAGMENTS)}))",
        "honorific": f"(NOT {postal} AND {street} AND {matches(c, '^' + is_.HONORIFIC)})",
        "nameish": rf"(length(trim({x})) >= 3 AND NOT regexp_matches({x}, '\p{{Nd}}') AND {matches(f'trim({x})', is_.NAME, '')})",
        "tax": any_of(comparable(x), is_.TAX_WORDS),
        "noise": any_of(comparable(x), is_.NOISE_FRAGMENTS),
        "city": matches(f"trim({x})", is_.BARE_CITY, ""),
        "person_tail": matches(c, is_.PERSON_TAIL),
    }[name]


def drop_reason(category: str, x: str, source: str) -> str:
    p = lambda name: predicate(name, x)
    person, address, account = (f"{category} = '{c}'" for c in ("private_person", "private_address", "account_number"))
    model = f"{source} = 'model'"
    return rf"""CASE WHEN {x} = '' THEN 'empty'
 WHEN {person} AND ({p('noise')} OR {p('tax')}) THEN 'noise'
 WHEN {person} AND {p('organization')} THEN 'organization'
 WHEN {person} AND {p('tail')} THEN 'contact_tail'
 WHEN {person} AND {model} AND length({x}) <= 4 AND NOT {p('nameish')} THEN 'short'
 WHEN {person} AND {model} AND regexp_matches({x}, '\p{{Nd}}') AND NOT contains({x}, ' ') THEN 'digits'
 WHEN {address} AND ({p('noise')} OR {p('tax')}) THEN 'noise'
 WHEN {address} AND {p('company')} THEN 'company_block'
 WHEN {address} AND {p('honorific')} THEN 'honorific_street'
 WHEN {address} AND ({p('postal')} OR {p('street')} OR {p('block')}) THEN NULL
 WHEN {address} AND {source} = 'pattern' THEN 'no_address_shape'
 WHEN {address} AND length({x}) < 8 THEN 'short'
 WHEN {account} AND {model} AND ({p('postal')} OR {p('street')} OR {p('tax')}) THEN 'address_shape'
 WHEN {account} AND {model} AND NOT regexp_matches({x}, '\p{{L}}') AND length(regexp_replace({x}, '\D+', '', 'g')) < 12 THEN 'few_digits' END"""


def judged() -> str:
    """After spans: judged(doc_id, o, pattern, category, text, a, b, reason)."""
    return f"""cleaned AS (SELECT doc_id, ord * 10000000::BIGINT + a AS o, pattern, category, {clean('text')} AS text, a, b FROM spans),
judged AS (SELECT doc_id, o, pattern, CASE WHEN category = 'account_number' AND {predicate('postal', 'text')} THEN 'private_address' ELSE category END AS category, text, a, b,
  {drop_reason('category', 'text', "'pattern'")} AS reason FROM cleaned)"""


def merged() -> str:
    """After judged: merged, one row per place and folded text."""
    return f"""kept AS (SELECT *, {fold('text')} AS f FROM judged WHERE reason IS NULL),
once AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, category, a, b, f ORDER BY o) = 1),
merged AS (SELECT doc_id, a, b, f, arg_min(category, o) AS category, arg_min(text, o) AS text, arg_min(pattern, o) AS pattern, min(o) AS o FROM once GROUP BY doc_id, a, b, f)"""


def selected() -> str:
    """After merged: selected, the disjoint spans, by going from the left."""
    return """ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC, o) AS r FROM merged WHERE b > a),
walk AS (SELECT doc_id, r, b AS last, true AS taken FROM ranked WHERE r = 1
  UNION ALL SELECT n.doc_id, n.r, CASE WHEN n.a >= w.last THEN n.b ELSE w.last END, n.a >= w.last FROM walk w JOIN ranked n ON n.doc_id = w.doc_id AND n.r = w.r + 1),
selected AS (SELECT ranked.* FROM ranked JOIN walk USING (doc_id, r) WHERE taken)"""


def placed() -> str:
    """After selected: placed, with base, placeholder and original."""
    base = "CASE category WHEN 'private_person' THEN 'NAME' WHEN 'private_address' THEN 'ADRESSE' WHEN 'private_date' THEN 'DATUM' WHEN 'private_email' THEN 'EMAIL' WHEN 'private_phone' THEN 'TELEFON' WHEN 'account_number' THEN 'NUMMER' ELSE 'GEHEIM' END"
    return f"""based AS (SELECT *, {base} AS base, trim(f) AS k FROM selected),
lasts AS (SELECT *, max(a) OVER (PARTITION BY doc_id, base, k) AS last_a FROM based),
placed AS (SELECT *, '[' || base || '_' || dense_rank() OVER (PARTITION BY doc_id, base ORDER BY last_a DESC) || ']' AS placeholder,
  last_value(text) OVER (PARTITION BY doc_id, base, k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS original FROM lasts)"""


def rebuilt(what: str) -> str:
    """After placed: rebuilt(doc_id, made, n), the text with ``what`` in the place of each span."""
    return f"""gapped AS (SELECT p.*, substr(d.text, coalesce(lag(p.b) OVER w, 0) + 1, p.a - coalesce(lag(p.b) OVER w, 0)) AS gap FROM placed p JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.a)),
rebuilt AS (SELECT g.doc_id, string_agg(gap || {what}, '' ORDER BY a) || substr(any_value(d.text), max(b) + 1) AS made, count(*) AS n FROM gapped g JOIN documents d USING (doc_id) GROUP BY g.doc_id)"""
