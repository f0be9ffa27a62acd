"""The fit of the quality rules: against expectation-maximisation text by text, and against known accuracies."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gossamer.llm import quality_rules as Q


def simulated(n=6_000, seed=3):
    """Votes of four rules on texts of known classes, a third of them bad; rule r votes on 0.8 and is right by ``right[r]``."""
    rng, right = np.random.default_rng(seed), np.array([0.95, 0.9, 0.8, 0.7])
    good = rng.random(n) > 1 / 3
    votes = np.where(rng.random((n, 4)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random((n, 4)) > 0.8] = 0
    return votes, good, right


def rules():
    return [Q.Rule(f"r{i}", F.lit(False), F.lit(False), 0.8) for i in range(4)]


def by_text(votes, trust=0.8, prior=0.85, anchor=0.02, rounds=200):
    """The same model, a row a text."""
    guess = np.array([[trust / 2, 0.5, (1 - trust) / 2], [(1 - trust) / 2, 0.5, trust / 2]])  # class, vote 1, 0, -1
    rates, share = np.tile(guess[:, None], (1, votes.shape[1], 1)), prior
    weight = max(1.0, anchor * len(votes)) * np.array([1.0, (1 - prior) / prior])
    at = 1 - votes
    for _ in range(rounds):
        like = np.array([np.prod([rates[c, r, at[:, r]] for r in range(votes.shape[1])], axis=0) for c in (0, 1)])
        p = share * like[0] / (share * like[0] + (1 - share) * like[1])
        mass = np.stack([p, 1 - p])
        seen = np.array([[[mass[c][at[:, r] == v].sum() for v in range(3)] for r in range(votes.shape[1])] for c in (0, 1)])
        rates = (seen + weight[:, None, None] * guess[:, None]) / (mass.sum(1) + weight)[:, None, None]
        was, share = share, min(0.99, max(0.01, p.mean()))
        if abs(was - share) < 1e-9:
            break
    return share, rates


def test_patterns_give_what_texts_give(spark):
    votes, _, _ = simulated(1_500)
    fitted = Q.fit(sorted((v, float(n)) for v, n in Counter(map(tuple, votes.tolist())).items()), rules())
    share, rates = by_text(votes)
    assert abs(fitted.prior - share) < 1e-6
    for r in range(4):
        for k, v in enumerate((1, 0, -1)):
            np.testing.assert_allclose(fitted.rates[r][v], rates[:, r, k], atol=1e-6)


def test_accuracies_are_recovered(spark):
    votes, good, right = simulated()
    fitted = Q.fit(sorted((v, float(n)) for v, n in Counter(map(tuple, votes.tolist())).items()), rules())
    assert abs(fitted.prior - good.mean()) < 0.05
    for r in range(4):
        told = fitted.rates[r][1][0] / (fitted.rates[r][1][0] + fitted.rates[r][-1][0])
        assert abs(told - right[r]) < 0.05
    odds = np.log(fitted.prior / (1 - fitted.prior)) + np.array([sum(fitted.log_odds(r, v) for r, v in enumerate(x)) for x in votes.tolist()])
    assert ((odds >= 0) == good).mean() > 0.93
