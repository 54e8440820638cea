"""Weak supervision with two classes: votes, expectation maximisation, posteriors.

Rules vote 1 (positive), -1 (negative) or 0 (abstain). For each rule and class
the model has the probability of each vote; given the class, rules are taken
as independent. The votes of all rows are first counted by pattern, a partial
aggregation to at most 3 ** rules rows whatever the corpus, and all rows of
the corpus count. That table of bounded size goes to the driver, which takes a
fixed number of steps over it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class VoteModel:
    """Share of the positive class, and for each rule P(vote | positive), P(vote | negative)."""

    rules: tuple[str, ...]
    share: float
    given: dict[str, dict[int, tuple[float, float]]]
    #: Whether an abstention speaks for a class too. Where rules abstain for want of evidence, it must not.
    telling: bool = True

    def log_odds(self, votes: dict[str, Column]) -> Column:
        """Log-odds of the positive class as a column over the votes."""
        total = F.lit(math.log(self.share / (1 - self.share)))
        for r in self.rules:
            a, b, c = (math.log(p / q) for p, q in (self.given[r][v] for v in VOTES))
            if not self.telling:
                voting = math.log((1 - self.given[r][0][0]) / (1 - self.given[r][0][1]))
                a, b, c = a - voting, 0.0, c - voting
            total = total + F.when(votes[r] == -1, a).when(votes[r] == 1, c).otherwise(b)
        return total

    def posterior(self, votes: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))

    def accuracy(self, rule: str) -> float:
        """Probability that the rule's vote is right, where it votes."""
        g = self.given[rule]
        right = self.share * g[1][0] + (1 - self.share) * g[-1][1]
        wrong = self.share * g[-1][0] + (1 - self.share) * g[1][1]
        return right / (right + wrong)


def first_guess(rules: tuple[str, ...], share: float = 0.5, accuracy: float = 0.8, voting: float = 0.5, telling: bool = True) -> VoteModel:
    """All rules vote half the time and are right in four of five votes."""
    right, wrong = voting * accuracy, voting * (1 - accuracy)
    return VoteModel(rules, share, {r: {-1: (wrong, right), 0: (1 - voting, 1 - voting), 1: (right, wrong)} for r in rules}, telling)


#: Patterns are counted for at most so many rules: 3 ** 10 rows.
MOST_RULES = 10
STEPS, SMOOTHING = 25, 0.01


def estimate(patterns: DataFrame, rules: tuple[str, ...], start: VoteModel | None = None, steps: int = STEPS, smoothing: float = SMOOTHING) -> VoteModel:
    """Maximise the likelihood of ``patterns``: a column for each rule's vote, and the count ``n``, each pattern once.

    ``smoothing`` is the share of imagined rows with each vote; it keeps any
    one rule from deciding alone. Without rows the start stays.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules make too many patterns")
    model = start or first_guess(rules)
    rows = patterns.select(*rules, "n").collect()  # at most 3 ** len(rules)
    if not rows:
        return model
    rows.sort()  # sums in one order, whatever the order of arrival
    votes, n = np.array([[r[x] for x in rules] for r in rows]), np.array([r["n"] for r in rows], float)
    cast = np.stack([votes == v for v in VOTES], 2).astype(float)  # pattern, rule, vote
    share, telling = model.share, model.telling
    given = np.array([[model.given[r][v] for v in VOTES] for r in rules])  # rule, vote, class
    for _ in range(steps):
        weight = np.log(given[..., 0] / given[..., 1])
        if not telling:
            weight = weight - np.log((1 - given[:, 1:2, 0]) / (1 - given[:, 1:2, 1]))
            weight[:, 1] = 0.0
        odds = math.log(share / (1 - share)) + (cast * weight).sum((1, 2))
        p = n / (1 + np.exp(-odds))
        positive, total = p.sum(), n.sum()
        yes, all_ = np.tensordot(p, cast, 1), np.tensordot(n, cast, 1)
        more = 1 + smoothing * positive, 1 + smoothing * (total - positive)
        given = np.stack([(yes + more[0]) / (positive + 3 * more[0]), (all_ - yes + more[1]) / (total - positive + 3 * more[1])], 2)
        share = (positive + 1) / (total + 2)
    found = {r: {v: (float(given[i, k, 0]), float(given[i, k, 1])) for k, v in enumerate(VOTES)} for i, r in enumerate(rules)}
    return VoteModel(rules, float(share), found, telling)


def estimate_sql(patterns: str, rules: tuple[str, ...], steps: int = STEPS, smoothing: float = SMOOTHING) -> str:
    """CTEs in DuckDB's SQL that do the same from ``first_guess`` over the table ``patterns`` (a column per rule, ``n``).

    They end in ``posteriors``: the columns of ``patterns`` and ``p``.
    """
    first = first_guess(rules)
    listed = ", ".join(f"('{r}', {v}, {first.given[r][v][0]!r}::DOUBLE, {first.given[r][v][1]!r}::DOUBLE)" for r in rules for v in VOTES)
    votes = " UNION ALL ".join(f"SELECT pattern, n, '{r}' AS rule, {r} AS vote FROM numbered" for r in rules)
    grid = f"SELECT * FROM (VALUES {', '.join(f"('{r}', {v})" for r in rules for v in VOTES)}) t(rule, vote)"
    out = [
        f"numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {', '.join(rules)}) AS pattern FROM {patterns})",
        f"cast_votes AS MATERIALIZED ({votes})",
        f"given0 AS MATERIALIZED (SELECT * FROM (VALUES {listed}) t(rule, vote, yes, no))",
        f"share0 AS MATERIALIZED (SELECT {first.share!r}::DOUBLE AS share)",
    ]
    for k in range(steps + 1):
        out.append(f"p{k} AS MATERIALIZED (SELECT pattern, any_value(n) AS n, 1 / (1 + exp(-(any_value(ln(share / (1 - share))) + sum(ln(yes / no))))) AS p FROM cast_votes JOIN given{k} USING (rule, vote), share{k} GROUP BY pattern)")
        if k < steps:
            out.append(f"sums{k} AS MATERIALIZED (SELECT sum(n * p)::DOUBLE AS positive, sum(n)::DOUBLE AS total FROM p{k})")
            out.append(f"votes{k} AS MATERIALIZED (SELECT rule, vote, sum(v.n * p)::DOUBLE AS yes, sum(v.n)::DOUBLE AS every FROM cast_votes v JOIN p{k} USING (pattern) GROUP BY rule, vote)")
            yes, no = f"(1 + {smoothing!r}::DOUBLE * positive)", f"(1 + {smoothing!r}::DOUBLE * (total - positive))"
            out.append(
                f"given{k + 1} AS MATERIALIZED (SELECT rule, vote, (coalesce(yes, 0) + {yes}) / (positive + 3 * {yes}) AS yes, (coalesce(every, 0) - coalesce(yes, 0) + {no}) / (total - positive + 3 * {no}) AS no "
                f"FROM ({grid}) LEFT JOIN votes{k} USING (rule, vote), sums{k})"
            )
            out.append(f"share{k + 1} AS MATERIALIZED (SELECT (positive + 1) / (total + 2) AS share FROM sums{k})")
    out.append(f"posteriors AS MATERIALIZED (SELECT {', '.join(rules)}, p FROM numbered JOIN p{steps} USING (pattern))")
    return ",\n".join(out)
