"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, runs of characters that aren't letters become one space, and its n-grams
of 1 to 3 characters are hashed into BUCKETS. The model is a matrix of log-probabilities, one
row a language (some hundred kB, broadcast); texts are scored in numpy, many at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_sample, fold, map_text, slices, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Training texts of each language, picked by a hash of the id; all where there are fewer.
SAMPLE_PER_LANG = 3_000
#: Languages learned, those with most texts; the model's size is this times BUCKETS numbers at most (128 MB).
MAX_LANGS = 1024
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_letter = None


def letter_table() -> np.ndarray:
    """By code point: its lower-case letter, or a space."""
    global _letter
    if _letter is None:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letter = t
    return _letter


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, the text it belongs to, and whether each text has a letter."""
    raw = [np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    chars = letter_table()[np.concatenate([np.concatenate([r, [32]]).astype(np.uint32) for r in raw])] if raw else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) + 1 for r in raw])
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | (owner[1:] != owner[:-1])
    chars, owner = chars[keep], owner[keep]
    letter = chars != 32
    has = np.zeros(len(raw), bool)
    has[owner[letter]] = True
    wide = chars.astype(np.uint64)
    out, whose = [], []
    for n in ORDERS:
        if len(wide) < n:
            continue
        h = np.zeros(len(wide) - n + 1, np.uint64)
        for i in range(n):
            h = (h + wide[i : len(wide) - n + 1 + i]) * np.uint64(MULTIPLIERS[n - 1] | 1)
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        if n == 1:
            inside &= letter
        out.append((h >> np.uint64(49)).astype(np.int32)[inside])
        whose.append(owner[: len(owner) - n + 1][inside])
    return (np.concatenate(out), np.concatenate(whose), has) if out else (np.zeros(0, np.int32), np.zeros(0, np.int32), has)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their matrix of log-probabilities, with log-priors taken equal.

    Rows with a null text or language teach nothing. At most about per_lang texts of a language
    are read, of the MAX_LANGS languages with most texts (ties: first in the alphabet).
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    names = [r["lang"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    chosen = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in names], "lang string"))  # bounded: MAX_LANGS rows
    sample = bounded_sample(rows.join(chosen, "lang", "left_semi"), "doc_id", per_lang, "langid", ["lang"])

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for part in slices(batches):
            names = np.array(part.column(0).to_pylist(), object)
            texts = part.column(1).to_pylist()
            for name in set(names.tolist()):
                bucket, _, _ = ngrams([texts[i] for i in np.flatnonzero(names == name)])
                seen[name] = seen.get(name, 0) + np.bincount(bucket, minlength=BUCKETS)
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": list(seen), "counts": [v.astype(np.float64).tobytes() for v in seen.values()]})

    parts = sample.repartition(6).select("lang", "text").mapInArrow(count, "lang string, counts binary").collect()
    total: dict[str, np.ndarray] = {}
    for r in parts:
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.float64)
    langs = sorted(total)
    counts = np.array([total[x] for x in langs]).reshape(len(langs), BUCKETS) + smoothing
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with lang_pred and score, the posterior probability of that language with the
    evidence of a long text tempered to that of 200 n-grams. Texts that are null or have no letter
    (empty ones too), and all texts where no language was learned, get `und` and score 0. Ties go
    to the language first in the alphabet."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        langs, logp = sent.value

        def work(texts: list) -> dict:
            bucket, owner, has = ngrams(texts)
            if not langs:
                return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
            sums = np.stack([np.bincount(owner, row[bucket], len(texts)) for row in logp], 1).astype(float)
            sums *= np.minimum(1.0, 200 / np.maximum(np.bincount(owner, minlength=len(texts)), 1))[:, None]
            p = np.exp(sums - sums.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            return {"lang_pred": [langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)], "score": np.where(has, p[np.arange(len(texts)), best], 0.0).tolist()}

        return work

    return map_text(df, make, "lang_pred string, score double", text, keep)


def op2_langid_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = fit(docs.filter(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
