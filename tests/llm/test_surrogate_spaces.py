"""Value spaces that are nearly or truly full."""

import string

from gossamer.llm import surrogates


def test_nearly_full_spaces(spark):
    """All 26 one-letter local parts of a domain, 50 of the 100 numbers +20xx."""
    rows = [("email", f"{c}@d.org") for c in string.ascii_lowercase] + [("phone", f"20{i:02d}") for i in range(50)]
    frame = spark.createDataFrame(rows, "kind string, canon string")
    out = surrogates.assign(frame).collect()
    assert {(r.kind, r.canon) for r in out} == set(rows)
    assert len({(r.kind, r.surrogate) for r in out}) == len(rows) and not {(r.kind, r.surrogate) for r in out} & set(rows)
    assert all(len(r.surrogate) == 4 and r.surrogate.startswith("20") for r in out if r.kind == "phone")
    assert sorted({r.surrogate[0] for r in out if r.kind == "email"}) == list(string.ascii_lowercase)
    assert sorted(surrogates.assign(frame.repartition(5)).collect()) == sorted(out)


def test_full_spaces_get_longer_forms(spark):
    """Of 100 numbers +20xx 60 are entities: 40 get the values that are left, 20 one more digit."""
    rows = [(i, f"call +20{i:02d}!") for i in range(60)]
    got = sorted(surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    new = [r.text.removeprefix("call ").removesuffix("!") for r in got]
    assert len(set(new)) == 60 and all(n.startswith("+20") for n in new) and not set(new) & {f"+20{i:02d}" for i in range(60)}
    assert sorted(len(n) for n in new) == [5] * 40 + [6] * 20
