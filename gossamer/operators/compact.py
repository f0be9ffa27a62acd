"""Review findings: which candidates say nothing new, and which belong together.

Candidates are rows (doc_id, page_index, ord, category, snippet, source,
confidence, rects). A null page_index is one page like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as is_
from ..functions.text import collapse, compact_ascii

KEY = ("doc_id", "page_index")


def family(category: Column) -> Column:
    return F.when(category.isin("private_person", "private_address", "custom_identifier"), "address_block").when(category.isin("private_phone", "private_email"), "contact").otherwise("standalone")


def union_rect(rects: Column) -> Column:
    """struct(x0, y0, x1, y1) about all rectangles, null for none."""
    lo = lambda k: F.array_min(F.transform(rects, lambda r: r[k]))
    hi = lambda k, s: F.array_max(F.transform(rects, lambda r: r[k] + r[s]))
    return F.when(F.size(rects) > 0, F.struct(lo("x").alias("x0"), lo("y").alias("y0"), hi("x", "w").alias("x1"), hi("y", "h").alias("y1")))


def meets(a: Column, b: Column, dx: float, dy: float) -> Column:
    """Whether a, grown by dx and dy on all sides, and b have an area in common."""
    return (a["x0"] - dx < b["x1"]) & (b["x0"] < a["x1"] + dx) & (a["y0"] - dy < b["y1"]) & (b["y0"] < a["y1"] + dy)


def gaps(a: Column, b: Column) -> tuple[Column, Column]:
    """Vertical and horizontal gap; 0 where they overlap."""
    of = lambda lo, hi: F.greatest(F.lit(0.0), b[lo] - a[hi], a[lo] - b[hi])
    return of("y0", "y1"), of("x0", "x1")


def near(a: Column, b: Column, dx: float, dy: float, v: float, h: float) -> Column:
    vertical, horizontal = gaps(a, b)
    return meets(a, b, dx, dy) | ((vertical <= v) & (horizontal <= h))


def overlap(a: Column, b: Column) -> Column:
    """Whether some rectangle of one group, grown by 10, meets one of the other."""
    box = lambda r: F.struct(r["x"].alias("x0"), r["y"].alias("y0"), (r["x"] + r["w"]).alias("x1"), (r["y"] + r["h"]).alias("y1"))
    return F.exists(a, lambda p: F.exists(b, lambda q: meets(box(p), box(q), 10.0, 10.0)))


def described(candidates: DataFrame) -> DataFrame:
    """Candidates with what the rules ask about each."""
    s = F.col("snippet")
    return candidates.withColumns(
        {
            "norm": compact_ascii(s),
            "box": union_rect(F.col("rects")),
            "family": family(F.col("category")),
            "is_postal": is_.postal_city(s),
            "is_street": is_.street_apart(s),
            "is_block": is_.address_block_apart(s),
            "is_company": is_.company_block_apart(s),
            "is_tail": is_.person_tail(s),
            "is_org": is_.organization(s),
            "is_authority": is_.authority(s),
            "is_city": is_.bare_city(s),
            "city": is_.city_name(s),
        }
    )


def context_flags(rows: DataFrame) -> DataFrame:
    """Rows with near_recipient, near_authority and near_sender, from one join of a page's candidates with each other.

    Authority words anywhere on the page also count for what stands clearly below the topmost other candidate.
    """
    others = rows.select(
        *[F.col(k).alias(f"o_{k}") for k in KEY], *[F.col(c).alias(f"o_{c}") for c in ("ord", "category", "snippet", "rects", "source", "confidence", "box", "is_postal", "is_street", "is_block", "is_tail", "is_org", "is_authority")]
    )
    same_page = F.lit(True)
    for k in KEY:
        same_page = same_page & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    alike = F.lit(True)  # the same candidate, or an exact double of it
    for c in ("category", "snippet", "rects", "source", "confidence"):
        alike = alike & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    a, b, o = F.col("box"), F.col("o_box"), (lambda c: F.col(f"o_{c}"))
    recipient = (o("category") == "private_person") | ((o("category") == "private_address") & (o("is_street") | o("is_block") | o("is_tail")))
    middle = lambda r: (r["y0"] + r["y1"]) / 2
    pairs = rows.join(others, same_page & ~alike, "left")
    found = pairs.groupBy(*KEY, "ord").agg(
        F.bool_or(recipient & near(a, b, 24.0, 28.0, 44.0, 160.0)).alias("near_recipient"),
        F.bool_or(o("is_authority") & near(a, b, 28.0, 30.0, 36.0, 220.0)).alias("_auth"),
        F.bool_or(o("is_authority")).alias("_auth_page"),
        F.max(F.when(recipient, middle(b))).alias("_top"),
        F.bool_or(o("is_org") & near(a, b, 28.0, 30.0, 42.0, 240.0)).alias("near_sender_box"),
        F.bool_or(o("is_org")).alias("_org_page"),
    )
    keys = [rows[k].eqNullSafe(found[k]) for k in (*KEY, "ord")]
    joined = rows.join(found, keys[0] & keys[1] & keys[2]).select(rows["*"], *[found[c] for c in ("near_recipient", "_auth", "_auth_page", "_top", "near_sender_box", "_org_page")])
    below = middle(F.col("box")) + 120 < F.col("_top")
    flag = lambda x: F.coalesce(x, F.lit(False))
    return joined.withColumns(
        {
            "near_recipient": flag(F.col("near_recipient")),
            "near_authority": flag(F.col("_auth")) | flag((flag(F.col("_auth_page")) | F.col("is_authority")) & below),
            "near_sender": flag(F.col("near_sender_box")) | flag((flag(F.col("_org_page")) | F.col("is_org")) & below),
        }
    ).drop("_auth", "_auth_page", "_top", "near_sender_box", "_org_page")


def suppress_redundant(candidates: DataFrame) -> DataFrame:
    """Candidates that no rule drops; ``reason`` of the others by ``redundant_reason``."""
    return redundant_reason(candidates).filter("reason is null").select(candidates.columns)


def redundant_reason(candidates: DataFrame) -> DataFrame:
    """Candidates with the first rule that drops them; every rule looks at all candidates, dropped or not."""
    rows = context_flags(described(candidates))
    # A city is repeated if two different candidates of the page name it, neither beside a recipient.
    named = F.col("is_postal") & F.col("city").isNotNull() & ~F.col("near_recipient")
    different = F.collect_set(F.when(named, F.struct("category", "snippet", F.to_json("rects"), "source", "confidence"))).over(W.partitionBy(*KEY, "city"))
    rows = rows.withColumn("repeated", named & (F.size(different) > 1))
    others = rows.select(
        *[F.col(k).alias(f"o_{k}") for k in KEY], *[F.col(c).alias(f"o_{c}") for c in ("ord", "category", "snippet", "rects", "source", "confidence", "norm", "family", "is_postal", "is_tail", "city", "repeated")]
    )
    same_page = F.lit(True)
    for k in KEY:
        same_page = same_page & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    alike = F.lit(True)
    for c in ("category", "snippet", "rects", "source", "confidence"):
        alike = alike & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    o = lambda c: F.col(f"o_{c}")
    pairs = rows.join(others, same_page & ~alike, "left")
    both_meet = overlap(F.col("rects"), o("rects"))
    longer = (o("norm") != "") & (F.length(o("norm")) > F.length("norm")) & F.contains(o("norm"), F.col("norm"))
    exempt = ((F.col("category") == "private_address") & (o("category") == "private_address") & F.col("is_postal") & o("is_tail")) | (
        (F.col("family") == "standalone") & (o("family") == "standalone") & (F.col("category") != o("category"))
    )
    seen = pairs.groupBy(*KEY, "ord").agg(
        F.bool_or(o("repeated") & (compact_ascii(o("city")) == F.col("norm"))).alias("_named"),
        F.bool_or((o("category") == "private_address") & o("is_postal") & both_meet).alias("_beside_postal"),
        F.bool_or(longer & ~exempt & both_meet).alias("_within"),
    )
    keys = [rows[k].eqNullSafe(seen[k]) for k in (*KEY, "ord")]
    joined = rows.join(seen, keys[0] & keys[1] & keys[2]).select(rows["*"], *[seen[c] for c in ("_named", "_beside_postal", "_within")])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    address, person = F.col("category") == "private_address", F.col("category") == "private_person"
    reason = (
        F.when(F.col("norm") == "", "R1")
        .when(address & F.col("is_postal") & F.col("repeated"), "R2")
        .when(address & F.col("is_postal") & F.col("near_authority") & ~F.col("near_recipient"), "R3")
        .when(address & (F.col("is_postal") | F.col("is_street")) & F.col("near_sender") & ~F.col("near_recipient"), "R4")
        .when(person & F.col("is_city") & flag("_named"), "R5")
        .when(person & F.col("is_city") & F.col("near_authority"), "R6")
        .when(person & F.col("is_city") & F.col("near_sender"), "R7")
        .when(address & F.col("is_company"), "R8")
        .when(address & F.col("is_tail") & flag("_beside_postal"), "R9")
        .when(flag("_within"), "R10")
    )
    return joined.withColumn("reason", reason).select(*candidates.columns, "reason")


def cluster(candidates: DataFrame) -> DataFrame:
    """Candidates with the number of their group on the page: first fit, in order of arrival.

    A finding of its own kind stands alone; contacts of a page are one group; of
    persons and addresses, those that stand near the box so far. Order decides, so a
    page's candidates are gone through one after the other.
    """
    rows = candidates.withColumn("_f", family(F.col("category"))).withColumn("_b", union_rect(F.col("rects")))
    lists = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("_f").alias("f"), F.col("_b").alias("b")))).alias("l"))
    group = "struct<f:string,b:struct<x0:double,y0:double,x1:double,y1:double>>"
    start = F.struct(F.array().cast(f"array<{group}>").alias("groups"), F.array().cast("array<struct<ord:bigint,g:int>>").alias("out"))

    def fits(g: Column, c: Column) -> Column:
        vertical, horizontal = gaps(g["b"], c["b"])
        stands_near = meets(g["b"], c["b"], 18.0, 26.0) | ((vertical <= 20) & (horizontal <= 80))
        return (g["f"] == c["f"]) & (c["f"] != "standalone") & ((c["f"] == "contact") | (c["b"].isNotNull() & F.coalesce(stands_near, F.lit(False))))

    def grown(a: Column, b: Column) -> Column:
        both = F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)

    def step(acc: Column, c: Column) -> Column:
        indexed = F.transform(acc["groups"], lambda g, i: F.when(fits(g, c), i))
        at = F.coalesce(F.array_min(F.filter(indexed, lambda i: i.isNotNull())), F.size(acc["groups"]))
        new = F.array(F.struct(c["f"].alias("f"), c["b"].alias("b")))
        groups = F.when(at == F.size(acc["groups"]), F.concat(acc["groups"], new)).otherwise(F.transform(acc["groups"], lambda g, i: F.when(i == at, F.struct(g["f"].alias("f"), grown(g["b"], c["b"]).alias("b"))).otherwise(g)))
        return F.struct(groups.alias("groups"), F.concat(acc["out"], F.array(F.struct(c["ord"].cast("bigint").alias("ord"), at.cast("int").alias("g")))).alias("out"))

    placed = lists.select(*KEY, F.explode(F.aggregate("l", start, step, lambda a: a["out"])).alias("x")).select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("x.ord").alias("_ord"), F.col("x.g").alias("cluster"))
    same = candidates["doc_id"].eqNullSafe(placed["_doc_id"]) & candidates["page_index"].eqNullSafe(placed["_page_index"]) & (candidates["ord"] == placed["_ord"])
    return candidates.join(placed, same).select(*candidates.columns, "cluster")


def compact(candidates: DataFrame) -> DataFrame:
    """Review findings: one row per group with its category, text, source, confidence and rectangles.

    Texts go from top to bottom in steps of 8, then from the left, longer first; up to
    four different ones are shown, of a finding of its own kind one.
    """
    rows = cluster(suppress_redundant(candidates)).withColumn("_b", union_rect(F.col("rects"))).withColumn("_f", family(F.col("category")))
    key = F.struct((-F.floor(F.coalesce(F.col("_b.y0"), F.lit(0.0)) / 8)).alias("y"), F.coalesce(F.col("_b.x0"), F.lit(0.0)).alias("x"), (-F.length("snippet")).alias("n"), F.col("ord").alias("o"))
    grouped = rows.groupBy(*KEY, "cluster").agg(
        F.first("_f").alias("family"),
        F.collect_set("category").alias("kinds"),
        F.max("confidence").alias("confidence"),
        F.collect_set("source").alias("sources"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rects"))), lambda x: x["rects"])).alias("rects"),
        F.array_sort(F.collect_list(F.struct(key.alias("k"), collapse(F.col("snippet")).alias("s"), compact_ascii(F.col("snippet")).alias("n")))).alias("l"),
        F.min("ord").alias("ord"),
    )
    has = lambda c: F.array_contains("kinds", c)
    # Names of summarised kinds.
    category = (
        F.when(F.col("family") == "address_block", F.when(has("private_person") & has("private_address"), "Adressblock").otherwise("Adresse"))
        .when(F.col("family") == "contact", F.when(F.size("kinds") > 1, "Kontakt").otherwise(F.get("kinds", F.lit(0))))
        .otherwise(F.get("kinds", F.lit(0)))
    )
    first = F.filter("l", lambda x, i: ~F.exists(F.slice("l", F.lit(1), i), lambda y: y["n"] == x["n"]))
    shown = F.slice(F.filter(F.transform(first, lambda x: x["s"]), lambda x: x != ""), F.lit(1), F.when(F.col("family") == "standalone", 1).otherwise(4))
    source = F.when((F.size("sources") > 1) | F.array_contains("sources", "mixed"), "mixed").otherwise(F.get("sources", F.lit(0)))
    return grouped.select(*KEY, "cluster", category.alias("category"), F.array_join(shown, "\n").alias("snippet"), source.alias("source"), "confidence", "rects", F.lit("pending").alias("status"))
