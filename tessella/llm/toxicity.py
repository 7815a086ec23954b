"""Toxicity: a factorization machine over hashed terms.

A text's terms are its lower-cased words and their prefixes of 3 to 6 letters, hashed into
BUCKETS; each counts once. score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>), so
that a pair such as an insult beside the mention of a group can weigh more than its parts.

Terms that are no more frequent in toxic than in other texts (or the reverse) carry noise that
grows with a text's length, so only terms whose frequencies differ by Z_LEAST standard errors are
learned, and those of pairs of common terms whose joint frequencies differ by Z_PAIR, although each
of the two may tell nothing by itself; the rest weigh nothing.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_sample, cut, fold, free_name, map_text, table

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)
#: Labelled texts of each class in training, picked by a hash of the id; all where there are fewer.
SAMPLE_PER_CLASS = 4_000
Z_LEAST = 3.5
#: Terms, the commonest in up to COMMON of the texts, that are looked at in pairs, and the least standard errors of a pair's difference beyond what its members make likely.
PAIRED_TERMS, COMMON, Z_PAIR = 256, 0.7, 6.0
FACTORS = 4
#: Batches that training takes at least.
STEPS = 600
THRESHOLD = 0.3
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")


def term_ids(word: str) -> list[int]:
    """Buckets of a word: itself, and each prefix shorter than it."""
    return [zlib.crc32(b"w:" + word.encode()) % BUCKETS, *(zlib.crc32(b"p:" + word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n)]


def terms(text: str | None, known: dict[str, list[int]]) -> list[int]:
    """The sorted distinct buckets of a text; known keeps those of words seen before."""
    own: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        ids = known.get(w)
        if ids is None:
            if len(known) >= CACHE_WORDS:
                known.clear()
            ids = known[w] = term_ids(w)
        own.update(ids)
    return sorted(own)


def extract(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with `terms`, the sorted buckets of each text."""

    def make():
        known: dict[str, list[int]] = {}
        return lambda texts: {"terms": [terms(t, known) for t in texts]}

    return map_text(df, make, "terms array<int>", text, keep)


class Model:
    """Selected buckets (sorted), their weights and factors, and the intercept."""

    def __init__(self, ids: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.ids, self.w0, self.w, self.v = ids, w0, w, v

    def score(self, active: np.ndarray) -> float:
        """Of one text, from the positions (in ids) of its distinct terms."""
        z = self.w0
        if len(active):
            own = self.v[active]
            z += self.w[active].sum() + 0.5 * float((own.sum(0) ** 2 - (own**2).sum(0)).sum())
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def differs(n0, n1, of0: int, of1: int):
    """By how many standard errors shares n0 of of0 and n1 of of1 differ."""
    p = (n0 + n1) / (of0 + of1)
    return np.abs(n1 / of1 - n0 / of0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / of0 + 1 / of1))


def select(docs: list[np.ndarray], y: np.ndarray, z_least: float = Z_LEAST) -> np.ndarray:
    """Buckets whose shares of toxic and other texts differ by z_least standard errors, in 5 texts at least, and those of telling pairs."""
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    ids, back = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    of = [max(int((y == k).sum()), 1) for k in (0, 1)]
    n = [np.bincount(back[y[owner] == k], minlength=len(ids)) for k in (0, 1)]
    both = n[0] + n[1]
    chosen = (both >= 5) & (differs(n[0], n[1], *of) > z_least)
    common = np.flatnonzero((both >= 5) & (both <= COMMON * len(docs)))
    common = common[np.lexsort((ids[common], -both[common]))[:PAIRED_TERMS]]
    place = np.full(len(ids), -1)
    place[common] = np.arange(len(common))
    there = np.zeros((len(docs), len(common)), np.float32)
    held = place[back] >= 0
    there[owner[held], place[back[held]]] = 1
    joint = [there[y == k].T @ there[y == k] for k in (0, 1)]
    share = [there[y == k].sum(0) / of[k] for k in (0, 1)]
    # What the members' own shares make likely is taken off, so that a common term does not bring all others along.
    excess = (joint[1] / of[1] - np.outer(share[1], share[1])) - (joint[0] / of[0] - np.outer(share[0], share[0]))
    p = (joint[0] + joint[1]) / len(docs) if docs else joint[0]
    z = np.abs(excess) / np.sqrt(np.maximum(p * (1 - p), 1e-6) * (1 / of[0] + 1 / of[1]))
    np.fill_diagonal(z, 0)
    # Prefixes stand with their words: such pairs tell no more than the word does.
    z[(joint[0] + joint[1]) >= 0.9 * np.minimum(both[common][:, None], both[common][None, :])] = 0
    chosen[common[(z > Z_PAIR).any(0)]] = True
    return ids[chosen]


def train(docs: list[np.ndarray], y: np.ndarray, prior: float, epochs: int = 15, rate: float = 0.1, l2: float = 1e-3, seed: int = 7) -> Model:
    """Fit by AdaGrad on mini-batches. docs: buckets of each text; y: 0 or 1; prior: the share of
    label 1 where the model is used, to which the intercept is moved from that of the sample.
    Without both classes the score is the prior for every text."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    ids = select(docs, y)
    rows = [np.searchsorted(ids, d[np.isin(d, ids)]) for d in docs]
    rng = np.random.default_rng(seed)
    n = len(ids)
    w0, w, v = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
    g0, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)
    order = np.arange(len(rows))
    size = int(min(256, max(16, len(rows) // 16)))
    # Few texts make few batches; they are gone through more often.
    for _ in range(max(epochs, STEPS * size // len(rows))):
        rng.shuffle(order)
        for lo in range(0, len(order), size):
            batch = order[lo : lo + size]
            flat = np.concatenate([rows[i] for i in batch]).astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            own = v[flat]
            sums = np.stack([np.bincount(owner, own[:, f], len(batch)) for f in range(FACTORS)], 1)
            squares = np.bincount(owner, (own**2).sum(1), len(batch))
            z = w0 + np.bincount(owner, w[flat], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            s0 = d.sum()
            g0 += s0**2
            w0 -= rate * s0 / np.sqrt(g0)
            each = d[owner]
            touched = np.unique(flat)
            sw = np.bincount(flat, each, n)[touched] + l2 * w[touched] / len(batch)
            gw[touched] += sw**2
            w[touched] -= rate * sw / np.sqrt(gw[touched])
            pull = each[:, None] * (sums[owner] - own)
            sv = np.stack([np.bincount(flat, pull[:, f], n)[touched] for f in range(FACTORS)], 1) + l2 * v[touched] / len(batch)
            gv[touched] += sv**2
            v[touched] -= rate * sv / np.sqrt(gv[touched])
    drawn = y.mean()
    w0 += np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return Model(ids, float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from labels(doc_id, toxic) of documents (doc_id, text). Rows with a null id, text or
    label teach nothing, and an id with both labels teaches neither."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).filter("toxic = __most").select("doc_id", "toxic")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1.0)
    drawn = F.broadcast(bounded_sample(known, "doc_id", per_class, "toxicity", ["toxic"]))  # bounded: 2 * per_class rows
    rows = extract(docs.select("doc_id", F.col(text).alias("text")).filter("text IS NOT NULL").join(drawn, "doc_id"), keep=("doc_id", "toxic"))
    rows = cut(rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("terms").alias("terms")))
    # Terms that can be selected are told apart on the executors, so that a text sends some hundred numbers at most, however long it is.
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of0, of1 = max(size.get(0, 0), 1), max(size.get(1, 0), 1)
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).filter("n0 + n1 >= 5")
    counts = cut(counts.withColumn("p", (F.col("n0") + F.col("n1")) / (of0 + of1)))
    apart = F.abs(F.col("n1") / of1 - F.col("n0") / of0) > (Z_LEAST - 0.01) * F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-12)) * (1 / of0 + 1 / of1))
    common = counts.filter(F.col("p") <= COMMON).orderBy(F.desc(F.col("n0") + F.col("n1")), "term").limit(PAIRED_TERMS)
    kept = np.unique([r["term"] for r in counts.filter(apart).select("term").unionByName(common.select("term")).collect()])
    few = rows.select("doc_id", "toxic", F.col("terms")).mapInArrow(_only(kept), "doc_id string, toxic int, terms array<int>")
    got = sorted(few.collect())
    return train([np.array(r["terms"], np.int64) for r in got], np.array([r["toxic"] for r in got], int), prior)


def _only(kept: np.ndarray):
    """Batches of (doc_id, toxic, terms) with the terms that are in kept."""

    def run(batches):
        for batch in batches:
            own = [np.asarray(x, np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array([x[np.isin(x, kept)].astype(np.int32) for x in own], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"]
            )

    return run


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with score, 0 to 1. Null and empty texts have no terms: their score is the intercept's."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m: Model = sent.value
        at = {int(b): i for i, b in enumerate(m.ids)}
        known: dict[str, tuple[int, ...]] = {}

        def active(word: str) -> tuple[int, ...]:
            if len(known) >= CACHE_WORDS:
                known.clear()
            found = known[word] = tuple(at[b] for b in term_ids(word) if b in at)
            return found

        def work(texts: list) -> dict:
            out = []
            for t in texts:
                own: set[int] = set()
                for w in set(WORD.findall((t or "").lower())):
                    got = known.get(w)
                    if got is None:
                        got = active(w)
                    if got:
                        own.update(got)
                out.append(float(m.score(np.fromiter(sorted(own), np.int64))))
            return {"score": out}

        return work

    return map_text(df, make, "score double", text, keep)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is under the threshold. Null and empty texts score as the intercept does; repeated rows
    are judged alike; an empty table gives no rows."""
    from .stages import with_column

    made = free_name(docs.columns, "score")
    return with_column(docs, lambda d, keep: score(d, model, keep=keep), "score", made).filter(F.col(made) < threshold).drop(made)


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs, labels.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
