"""Weak supervision: estimate, from their votes alone, how well rules tell good texts from bad.

Each rule votes good (+), bad (-) or abstains (0). Bad texts are bad in different ways, and a text
that one group of rules rightly rejects may please all others; so the model is a mixture: a class of
good texts and a class for each family of rules, which look for one defect from several sides. Given
the class, votes are independent, with chances for each rule and vote. Expectation-maximisation fits
shares and chances to counted vote patterns. Nothing bounds them but a prior of PRIOR texts a class,
which tells EM where to begin and keeps chances off 0 and 1; on any larger table the votes decide.

A fitted class counts as a defect if the rules of its family vote bad on it more often than good. A
class that the votes do not bear out (no text has the defect, and EM has used the class for
something else) counts as good. A text's quality is the posterior probability of the good classes.
A rule that is a family of its own has no other to check it, so on good texts and on its defect its
chances stay the prior's.

So one rule's bad vote is outvoted where the rules that see the same defect vote good, and how much
it weighs depends on how often that rule has been found wrong.
"""

from __future__ import annotations

import numpy as np

BAD, ABSTAIN, GOOD = "-", "0", "+"
VOTES = {BAD: 0, ABSTAIN: 1, GOOD: 2}
#: Votes that the prior's texts of a class give: on good texts, on a defect by the rules that look for it, and by others. Their number.
ON_GOOD, ON_DEFECT, ON_OTHER = (0.005, 0.195, 0.80), (0.80, 0.10, 0.10), (0.02, 0.20, 0.78)
PRIOR = 2.0


class LabelModel:
    def __init__(self, shares: np.ndarray, chances: np.ndarray, families: np.ndarray):
        """shares[class]; chances[class, rule, vote]; families[rule]. Class 0 is good, class 1 + f began as the defect of family f."""
        self.shares, self.chances, self.families = shares, chances, families
        own = [chances[1 + f, families == f].sum(0) for f in range(len(shares) - 1)]
        self.defect = np.array([False, *(c[0] > c[2] for c in own)])

    @property
    def good(self) -> float:
        return float(self.shares[~self.defect].sum())

    def responsibilities(self, votes: np.ndarray) -> np.ndarray:
        """[pattern, class] from votes[pattern, rule]."""
        rules = np.arange(votes.shape[1])
        logs = np.log(self.chances)[:, rules, votes].sum(2).T + np.log(self.shares)
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability that a text with each vote pattern is good."""
        return self.responsibilities(as_votes(patterns))[:, ~self.defect].sum(1) if len(patterns) else np.zeros(0)

    def accuracies(self) -> np.ndarray:
        """By rule: the share of its votes, abstentions aside, that the model holds to be right. On a defect of another family a good vote is no error."""
        good = np.tensordot(self.shares[~self.defect], self.chances[~self.defect], (0, 0))
        seen = self.defect[1 + self.families]
        own = (self.shares[1 + self.families] * seen)[:, None] * self.chances[1 + self.families, np.arange(len(self.families))]
        right, wrong = good[:, 2] + own[:, 0], good[:, 0] + own[:, 2]
        return right / np.maximum(right + wrong, 1e-12)


def as_votes(patterns: list[str]) -> np.ndarray:
    letters = np.frombuffer("".join(patterns).encode(), np.uint8)
    at = np.zeros(256, int)
    for v, i in VOTES.items():
        at[ord(v)] = i
    return at[letters].reshape(len(patterns), -1)


def fit(patterns: list[str], counts: list[float], families: list[int] | None = None, rounds: int = 500) -> LabelModel:
    """EM over vote patterns with their counts. families: by rule the number of its family, each rule's own by default.
    Without patterns, the prior is returned."""
    rules = len(patterns[0]) if patterns else len(families or [])
    families = np.arange(rules) if families is None else np.asarray(families, int)
    classes = 1 + (int(families.max()) + 1 if rules else 0)
    shares = np.full(classes, 0.15 / max(classes - 1, 1))
    shares[0] = 0.85 if rules else 1.0
    prior = np.tile(ON_OTHER, (classes, rules, 1)).astype(float)
    prior[0] = ON_GOOD
    prior[1 + families, np.arange(rules)] = ON_DEFECT
    chances = prior.copy()
    if not patterns:
        return LabelModel(shares, chances, families)
    votes, n, before = as_votes(patterns), np.asarray(counts, float), None
    hot = np.eye(3)[votes]
    began = shares.copy()
    alone = np.flatnonzero(np.bincount(families)[families] == 1)
    for _ in range(rounds):
        r = LabelModel(shares, chances, families).responsibilities(votes)
        if before is not None and np.abs(r - before).max() < 1e-7:
            break
        before = r
        weight = r * n[:, None]
        shares = weight.sum(0) + PRIOR * began
        shares /= shares.sum()
        chances = np.einsum("pc,prv->crv", weight, hot) + PRIOR * prior
        chances /= chances.sum(2, keepdims=True)
        chances[0, alone], chances[1 + families[alone], alone] = ON_GOOD, ON_DEFECT
    return LabelModel(shares, chances, families)
