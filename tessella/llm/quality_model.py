"""Quality classifier: a hashed linear scorer taught by a weak-label model.

Heuristic labellers that overlap vote on every text; expectation-maximisation over the vote patterns
of all texts, counted in one aggregation, estimates how accurate they are. The posterior labels of a
bounded sample, in which every pattern has a place, teach a logistic scorer over hashed features,
which then scores every text. No hand-made label is used.

The scorer does not see the labellers' measures. Its features are 4-grams of character classes and
pairs of neighbouring words' gaps (how far back the same word stood last), hashed into BUCKETS, each
valued by the square root of its share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import labelmodel, textstats
from .common import cut, free_name, map_text, table, unit_hash

GRAMS, GAPS = 1 << 12, 1 << 10
BUCKETS = GRAMS + GAPS
#: Texts that the scorer learns from, about half of them likely bad; all where there are fewer. Every vote pattern has up to LEAST of them.
SAMPLE = 10_000
LEAST = 20
KEEP_FROM = 0.5


def _over(value: float, good_to: float, bad_from: float) -> str:
    return labelmodel.GOOD if value <= good_to else labelmodel.BAD if value >= bad_from else labelmodel.ABSTAIN


FAMILIES = ("noise", "shouting", "repetition", "words")
#: Family, name and vote of each labeller over the measures m of a text with words. Those of a family see the same defect from different sides.
LABELLERS = (
    ("noise", "symbol_words", lambda m: _over(m["symbols"], 0.02, 0.15)),
    ("noise", "odd_characters", lambda m: _over(m["odd"], 0.03, 0.08)),
    ("noise", "marked_words", lambda m: _over(m["marked"], 0.03, 0.15)),
    ("shouting", "shouted_letters", lambda m: _over(m["upper"], 0.1, 0.35)),
    ("shouting", "shouted_runs", lambda m: _over(m["runs"], 0.05, 0.3)),
    ("shouting", "shouted_marks", lambda m: _over(m["shouts"], 0.1, 0.4)),
    ("repetition", "repeated_windows", lambda m: _over(m["windows"], 0.05, 0.3)),
    ("repetition", "repeated_lines", lambda m: labelmodel.ABSTAIN if 0 < m["dups"] < 3 else _over(m["dup"], 0.1, 0.3)),
    ("repetition", "stutter", lambda m: _over(m["stutter"], 0.03, 0.12)),
    ("repetition", "few_words", lambda m: _over(1 - m["distinct"], 0.4, 0.55)),
    ("words", "word_length", lambda m: _over(abs(m["length"] - 6.0), 3.0, 6.0)),
    ("words", "letters", lambda m: _over(1 - m["letters"], 0.15, 0.35)),
)


def measures(text: str | None, own: np.ndarray) -> dict | None:
    """Shares of a text; None where it has no word."""
    c = textstats.counts(text)
    if not c["n_words"]:
        return None
    n, s = c["n_words"], textstats.shares(own)
    return {
        "dups": c["n_dup_lines"],
        "symbols": c["n_symbols"] / n,
        "odd": s["odd"],
        "marked": s["marked"] / n,
        "upper": s["upper"],
        "runs": s["runs"],
        "shouts": s["shouts"] / n,
        "windows": c["n_repeat_words"] / n,
        "dup": c["n_dup_lines"] / max(c["n_lines"], 1),
        "stutter": c["n_stutter"] / n,
        "distinct": c["distinct"],
        "length": c["word_chars"] / n,
        "letters": s["letters"],
    }


def votes(text: str | None) -> str | None:
    """The vote pattern of a text; None where it has no word."""
    m = measures(text, textstats.classes(text))
    return "".join(f(m) for _, _, f in LABELLERS) if m else None


def features(own: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text, from its character classes and its words' hashes."""
    wide = own.astype(np.int64)
    grams = ((wide[:-3] * 8 + wide[1:-2]) * 8 + wide[2:-1]) * 8 + wide[3:]
    gap = textstats.gaps(hashes)
    pairs = ((gap[:-1] * 12 + gap[1:]) * 0x9E3779B1 >> 7) % GAPS
    at, value = [], []
    for first, size, kinds in ((0, GRAMS, grams), (GRAMS, GAPS, pairs)):
        n = np.bincount(kinds, minlength=size)
        held = np.flatnonzero(n)
        at.append(first + held)
        value.append(np.sqrt(n[held] / max(len(kinds), 1)))
    return np.concatenate(at), np.concatenate(value)


def features_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return features(textstats.classes(text), textstats.word_hashes((text or "").encode("utf-8", "replace").split()))


class Scorer:
    def __init__(self, w0: float, w: np.ndarray, labels: labelmodel.LabelModel):
        self.w0, self.w, self.labels = w0, w, labels

    def score(self, text: str | None) -> float:
        """The probability that a text is good; 0 for one without a word."""
        if not text or not text.encode("utf-8", "replace").split():
            return 0.0
        at, value = features_of(text)
        return float(1 / (1 + np.exp(-np.clip(self.w0 + self.w[at] @ value, -30, 30))))


def label(df: DataFrame) -> tuple[labelmodel.LabelModel, dict[str, float], DataFrame]:
    """The label model of all texts, the rate at which each vote pattern is drawn for the sample (at most 1), and (doc_id, votes)."""
    voted = cut(map_text(df, lambda: lambda texts: {"votes": [votes(t) for t in texts]}, "votes string").filter("votes IS NOT NULL"))
    rows = sorted(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())  # bounded: 3 ** len(LABELLERS) patterns
    names, counts = [r["votes"] for r in rows], np.array([r["n"] for r in rows], float)
    model = labelmodel.fit(names, counts.tolist(), [FAMILIES.index(f) for f, _, _ in LABELLERS])
    likely = model.posterior(names) >= 0.5
    rates = {}
    for side in (True, False):
        whole = max(counts[likely == side].sum(), 1)
        for name, n in zip(np.array(names, object)[likely == side], counts[likely == side], strict=True):
            rates[name] = float(min(1.0, max(SAMPLE / 2 / whole, min(LEAST, SAMPLE / len(names)) / n)))
    return model, rates, voted


def sample_rows(df: DataFrame, rates: dict[str, float], voted: DataFrame) -> list:
    """Votes and packed features of the sample's texts, in the order of their ids."""
    if not rates:
        return []
    spark = df.sparkSession
    told = F.broadcast(spark.createDataFrame(list(rates.items()), "votes string, rate double"))  # bounded: 3 ** len(LABELLERS) patterns
    ids = voted.filter("doc_id IS NOT NULL").join(told, "votes").filter(unit_hash(F.col("doc_id"), "quality") < F.col("rate")).select("doc_id", "votes").distinct()
    # An id with several texts has several rows; the limit is far above the rates' sum and only keeps a table of one id bounded.
    ids = F.broadcast(ids.limit(4 * SAMPLE))

    def work(texts: list) -> dict:
        out: dict = {"at": [], "value": []}
        for t in texts:
            at, value = features_of(t)
            out["at"].append(at.astype(np.int16).tobytes())
            out["value"].append(value.astype(np.float32).tobytes())
        return out

    got = map_text(df.join(ids, "doc_id"), lambda: work, "at binary, value binary", keep=("doc_id", "votes")).limit(4 * SAMPLE).collect()
    return sorted(got, key=lambda r: (str(r["doc_id"]), r["votes"], r["at"], r["value"]))


def fit(df: DataFrame, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5, seed: int = 5) -> Scorer:
    """Fit on df(doc_id, text): accuracies on all texts, weights on about SAMPLE of them. Without texts every text with a word scores
    about the model's prior."""
    df = df.select("doc_id", "text").filter("text IS NOT NULL")
    labels, rates, voted = label(df)
    rows = sample_rows(df, rates, voted)
    names = sorted(rates)
    target = dict(zip(names, labels.posterior(names), strict=True))
    y = np.array([target[r["votes"]] for r in rows])
    at = [np.frombuffer(r["at"], np.int16).astype(np.int64) for r in rows]
    value = [np.frombuffer(r["value"], np.float32).astype(float) for r in rows]
    w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    prior = min(labels.good, 1 - 1e-3)
    w0, g0 = float(np.log(prior / (1 - prior))), 1e-6
    rng = np.random.default_rng(seed)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), 128):
            batch = order[lo : lo + 128]
            i, x = np.concatenate([at[b] for b in batch]), np.concatenate([value[b] for b in batch])
            owner = np.repeat(np.arange(len(batch)), [len(at[b]) for b in batch])
            z = w0 + np.bincount(owner, w[i] * x, len(batch))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            s = np.bincount(i, d[owner] * x, BUCKETS) + l2 * w
            g += s**2
            w -= rate * s / np.sqrt(g)
            g0 += d.sum() ** 2
            w0 -= rate * d.sum() / np.sqrt(g0)
    return Scorer(w0, w, labels)


def score(df: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with score, the probability that a text is good (0 for null, empty and wordless texts)."""
    sent = df.sparkSession.sparkContext.broadcast(scorer)

    def make():
        own = sent.value
        return lambda texts: {"score": [own.score(t) for t in texts]}

    return map_text(df, make, "score double", text, keep)


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = KEEP_FROM) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. Null, empty and wordless texts go; repeated rows are judged alike; an empty table gives no rows."""
    from .stages import with_column

    made = free_name(docs.columns, "score")
    return with_column(docs, lambda d, keep: score(d, scorer, keep=keep), "score", made).filter(F.col(made) >= threshold).drop(made)


def op10_quality_weaklabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs)).select("doc_id", "score", (F.col("score") >= KEEP_FROM).alias("kept"))
