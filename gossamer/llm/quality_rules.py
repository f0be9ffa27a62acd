"""Quality rules as weak supervision, in DataFrame operations only.

Each rule looks at a text's statistics and votes good, votes bad or abstains.
Expectation-maximisation over the table of vote patterns (at most 3^rules rows,
whatever the corpus) estimates how often each rule votes each way on good and
on bad texts; a text's posterior then replaces "every rule must pass".
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, cut

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more.

    Windows are sorted with their places, so equal ones are neighbours; the
    places found are put in order and their overlapping triples counted once.
    n log n in the words of one text.
    """
    n = F.size(words)
    triples = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(ordered: Column) -> Column:
        here = lambda j: F.get(ordered, j).getField("h")
        places = F.array_sort(
            F.transform(
                F.filter(ordered, lambda x, j: x.getField("h").eqNullSafe(here(j - 1)) | x.getField("h").eqNullSafe(here(j + 1))),
                lambda x: x.getField("i"),
            )
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, i: F.struct((a.getField("n") + F.least(F.lit(3), i - a.getField("last"))).cast("long").alias("n"), i.alias("last")), lambda a: a.getField("n"))

    bound = F.get(F.transform(F.array(F.array_sort(triples)), covered), F.lit(0))  # sorts once: a lambda's variable is a value
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(bound)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the rules use) of each row of (doc_id, text).

    A null text has no words. Rows are kept as they are, repeated or not.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    base = docs.select("doc_id", text.alias("text"), word_array(F.col("text")).alias("words"), lines.alias("lines"))
    letters = F.regexp_replace("text", r"[^\p{L}]+", "")
    plain = F.translate("text", SYMBOLS, "")
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(plain)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains. ``trust``: the first guess of how often a vote cast is right."""

    name: str
    good: Column
    bad: Column
    trust: float = 0.9


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def default_rules() -> list[Rule]:
    """Rules that each know one fault mostly vote bad or abstain; two look at the whole and may vote good."""
    never = F.lit(False)
    enough = F.col("n_words") >= 20
    length = share("word_chars", "n_words")
    symbols, caps, repeats, dups = share("n_symbols", "n_words"), share("n_upper", "n_letters"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")
    lettered = share("n_letters", "word_chars")
    prose = enough & (symbols < 0.05) & (caps < 0.25) & (repeats < 0.25) & (lettered > 0.75) & length.between(2, 15)
    return [
        Rule("prose", prose, never, 0.95),
        Rule("length", F.col("n_words") >= 50, F.col("n_words") < 20, 0.6),
        Rule("word_length", never, enough & ((length < 2) | (length > 15))),
        Rule("symbols", never, (F.col("n_symbols") >= 5) & (symbols > 0.05), 0.95),
        Rule("capitals", never, enough & (caps > 0.25), 0.95),
        Rule("repeats", never, enough & (repeats > 0.25), 0.95),
        Rule("dup_lines", never, (F.col("n_lines") >= 4) & (dups > 0.3)),
        Rule("letters", never, enough & (lettered < 0.75), 0.95),
    ]


def vote(rule: Rule) -> Column:
    """1 good, 0 abstains, -1 bad."""
    return F.when(rule.bad, -1).when(rule.good, 1).otherwise(0)


@dataclass(frozen=True)
class Fit:
    """prior: share of good texts; rates[r][v]: (P(vote v | good), P(vote v | bad))."""

    prior: float
    rates: list[dict[int, tuple[float, float]]]

    def log_odds(self, r: int, v: int) -> float:
        good, bad = self.rates[r][v]
        return math.log(good) - math.log(bad)


def fit(patterns: list[tuple[tuple[int, ...], float]], rules: list[Rule], rounds: int = 200, anchor: float = 0.02, prior: float = 0.85) -> Fit:
    """EM over (votes, count) patterns: for each rule and class the chances of good, bad and no vote.

    The first guess is that a rule votes on half the texts and is right ``trust``
    of the time; it stays in as pseudo-counts of ``anchor`` of all texts, so the
    classes keep their meaning. Without patterns the first guess stands.
    """
    guess = [{1: (r.trust / 2, (1 - r.trust) / 2), 0: (0.5, 0.5), -1: ((1 - r.trust) / 2, r.trust / 2)} for r in rules]
    now, total = Fit(prior, guess), sum(n for _, n in patterns)
    weight = max(1.0, anchor * total)
    for _ in range(rounds if total else 0):
        good_n, sums = 0.0, [{v: [0.0, 0.0] for v in (1, 0, -1)} for _ in rules]
        for votes, n in patterns:
            odds = math.log(now.prior / (1 - now.prior)) + sum(now.log_odds(r, v) for r, v in enumerate(votes))
            p = 1 / (1 + math.exp(-min(500, max(-500, odds))))
            good_n += p * n
            for r, v in enumerate(votes):
                sums[r][v][0] += p * n
                sums[r][v][1] += (1 - p) * n
        good, bad = good_n + weight, total - good_n + weight * (1 - prior) / prior
        rates = [{v: ((sums[r][v][0] + weight * guess[r][v][0]) / good, (sums[r][v][1] + weight * (1 - prior) / prior * guess[r][v][1]) / bad) for v in (1, 0, -1)} for r in range(len(rules))]
        was, now = now, Fit(min(0.99, max(0.01, good_n / total)), rates)
        if abs(was.prior - now.prior) < 1e-9:
            break
    return now


def score(stats: DataFrame, rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """Add votes (array), quality (posterior that the text is good), base_failed and kept to rows of ``statistics``.

    ``stats`` is read twice; pass a stored table.
    """
    rules = rules or default_rules()
    voted = stats.withColumn("votes", F.array(*[vote(r) for r in rules]))
    counted = voted.groupBy("votes").agg(F.count("*").alias("n"))  # at most 3^rules rows
    fitted = fit(sorted((tuple(x["votes"]), float(x["n"])) for x in counted.collect()), rules)
    odds = F.lit(math.log(fitted.prior / (1 - fitted.prior)))
    for r in range(len(rules)):
        v = F.get("votes", F.lit(r))
        odds = odds + F.when(v == 1, fitted.log_odds(r, 1)).when(v == -1, fitted.log_odds(r, -1)).otherwise(fitted.log_odds(r, 0))
    quality = 1 / (1 + F.exp(-odds))
    return voted.withColumn("quality", quality).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def apply(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Statistics, votes and verdict of each row of (doc_id, text); the statistics are stored once in the shared folder."""
    return score(cut(statistics(docs), "rule-statistics"), rules)
