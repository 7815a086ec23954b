"""Quality rules by weak supervision.

Rules vote on each text or abstain; expectation-maximisation over the vote patterns of all texts
estimates their accuracies, and a text is kept by its posterior probability of being good instead
of having to pass every rule: a bad vote that the other rules of its family do not share, or by a
rule that errs often, is outvoted. The patterns are counted in one aggregation; their number is
3 ** len(RULES) at most, whatever the size of the table, so the model is fitted on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import labelmodel, textstats
from .common import cut, map_text, table

KEEP_FROM = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _vote(value: float, good_to: float, bad_from: float) -> str:
    """Good up to one bound, bad from another, no vote between."""
    return labelmodel.GOOD if value <= good_to else labelmodel.BAD if value >= bad_from else labelmodel.ABSTAIN


#: What rules look for. Rules of a family see one defect from different sides, so that they check one another.
FAMILIES = ("noise", "repetition", "shouting", "words")
#: Family, name and vote of each rule, from a text's counts c (n_words over 0) and its shares of character classes s.
RULES = (
    ("noise", "symbols", lambda c, s: _vote(c["n_symbols"] / c["n_words"], 0.02, 0.15)),
    ("noise", "odd_characters", lambda c, s: _vote(s["odd"], 0.03, 0.08)),
    ("noise", "marked_words", lambda c, s: _vote(s["marked"] / c["n_words"], 0.03, 0.15)),
    ("repetition", "repeated_lines", lambda c, s: labelmodel.ABSTAIN if 0 < c["n_dup_lines"] < 3 else _vote(c["n_dup_lines"] / c["n_lines"], 0.1, 0.3)),
    ("repetition", "repeated_windows", lambda c, s: _vote(c["n_repeat_words"] / c["n_words"], 0.05, 0.3)),
    ("repetition", "stutter", lambda c, s: _vote(c["n_stutter"] / c["n_words"], 0.03, 0.12)),
    ("repetition", "vocabulary", lambda c, s: _vote(1 - c["distinct"], 0.4, 0.55)),
    ("shouting", "capitals", lambda c, s: _vote(s["upper"], 0.1, 0.3)),
    ("shouting", "capital_runs", lambda c, s: _vote(s["runs"], 0.05, 0.25)),
    ("shouting", "shouts", lambda c, s: _vote(s["shouts"] / c["n_words"], 0.1, 0.4)),
    ("words", "word_length", lambda c, s: _vote(abs(c["word_chars"] / c["n_words"] - 6.0), 3.0, 6.0)),
    ("words", "letters", lambda c, s: _vote(1 - s["letters"], 0.15, 0.35)),
)


def votes(c: dict, text: str | None) -> str:
    """The vote pattern of a text; a text without a word gets no votes."""
    if not c["n_words"]:
        return labelmodel.ABSTAIN * len(RULES)
    s = textstats.shares(textstats.classes(text))
    return "".join(rule(c, s) for _, _, rule in RULES)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with the base counts and `votes`, a letter for each rule."""

    def work(texts: list) -> dict:
        own = [textstats.counts(t) for t in texts]
        return {k: [c[k] for c in own] for k in BASE} | {"votes": [votes(c, t) for c, t in zip(own, texts, strict=True)]}

    return map_text(df, lambda: work, ", ".join(f"{k} long" for k in BASE) + ", votes string", text, keep)


def fit(measured: DataFrame) -> labelmodel.LabelModel:
    rows = measured.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded: 3 ** len(RULES) patterns
    rows.sort(key=lambda r: r["votes"])
    return labelmodel.fit([r["votes"] for r in rows], [r["n"] for r in rows], [FAMILIES.index(f) for f, _, _ in RULES])


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, base counts, base_failed, quality (posterior of good) and kept.

    Null and empty texts have no words, so base_failed. The measures are written to the checkpoint
    folder, as they are read twice: for the model and for the verdicts.
    """
    measured = cut(measure(df, text, keep))
    model = fit(measured)

    @F.pandas_udf("double")
    def posterior(patterns):
        import pandas as pd

        seen, back = np.unique(patterns.to_numpy(str), return_inverse=True)
        return pd.Series(model.posterior(seen.tolist())[back])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured.withColumn("quality", posterior("votes"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
        .select(*keep, *BASE, "base_failed", "kept", "quality")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
