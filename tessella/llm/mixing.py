"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up by cell (source, language, topic). The cells' inclusion probabilities
are raked: scaled to the target shares of each source, then of each language, then of each topic,
never above 1, again and again until all three fit. Documents are then drawn by their cell's
probability and a hash of their id, so a run can be repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..tables import release
from .common import cut, table, unit_hash

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a category: its share of the tokens to this power, scaled to a sum of 1. 1 leaves shares as they are, 0 makes them equal.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: Up to so many cells the raking runs on the driver; beyond, over DataFrames with the same steps.
MAX_CELLS = 200_000
ROUNDS = 400
TOLERANCE = 1e-3
#: Where no probabilities fit, the total is lowered by this factor and raking starts anew.
SHRINK, SHRINKS = 0.97, 80


def topic(text: Column) -> Column:
    """The topic of a text without a topic column: the first of these forms that it shows."""
    return (
        F.when(text.contains("|"), "tabular")
        .when(text.contains("@"), "contact")
        .when(text.contains(" = "), "code")
        .when(text.rlike("(?i)licen[sc]e|rights reserved"), "legal")
        .otherwise("general")
    )


def weighed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __source, __lang, __topic (empty text for null) and __tokens (words; 0 for null texts)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = F.col("`topic`").cast("string") if "topic" in df.columns else topic(body)
    out = df.withColumn("__tokens", F.regexp_count(body, F.lit(r"\S+")).cast("long")).withColumn("__topic", F.coalesce(given, F.lit("")))
    for c in ("source", "lang"):
        out = out.withColumn(f"__{c}", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    return out


def tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power if v > 0 else 0.0 for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def rake(codes: np.ndarray, tokens: np.ndarray, shares: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """Inclusion probability of each cell, and whether all margins fit. codes[cell, dimension] index shares[dimension].
    Without tokens every probability is 1. Margins that contradict one another fit no probabilities; then the last round's are told, with False."""
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens)), True
    held = [np.bincount(codes[:, d], tokens, len(s)) for d, s in enumerate(shares)]
    # No category can give more than it has.
    scale = min([1.0, *(h[s > 0].min() if (s > 0).any() else 1.0 for h, s in ((h / np.maximum(s * total, 1e-300), s) for h, s in zip(held, shares, strict=True)))])
    w = np.ones(len(tokens))
    for _ in range(SHRINKS):
        w, before = np.full(len(tokens), scale), None
        for _ in range(ROUNDS):
            off = 0.0
            for d, s in enumerate(shares):
                now = np.bincount(codes[:, d], w * tokens, len(s))
                want = s * scale * total
                off = max(off, float(np.abs(now - want).max() / (scale * total)))
                w = np.minimum(1.0, w * (want / np.maximum(now, 1e-300))[codes[:, d]])
            if off < TOLERANCE:
                return w, True
            if before is not None and abs(before - off) < 1e-3 * off and off > 10 * TOLERANCE and not (w >= 1).any():
                return w, False  # nothing moves and no cell is used up: a smaller total would not fit either
            before = off
        scale *= SHRINK
    return w, False


def rake_frames(cells: DataFrame, shares: dict[str, DataFrame], scale: float, total: float) -> tuple[DataFrame, bool]:
    """cells(source, lang, topic, tokens) with w, raked over DataFrames as rake() does, and whether all margins fit: for more cells than
    the driver takes, with the same rounds, stops and results."""
    if not total:
        return cells.withColumn("w", F.lit(1.0)), True
    now = cells
    for _ in range(SHRINKS):
        now, before = cells.withColumn("w", F.lit(float(scale))), None
        for r in range(ROUNDS):
            now = now.withColumn("__off", F.lit(0.0))
            for d, s in shares.items():
                want = F.col("share") * scale * total
                sums = now.groupBy(d).agg(F.sum(F.col("w") * F.col("tokens")).alias("__now")).join(s, d).select(d, F.abs(F.col("__now") - want).alias("__gap"), (want / F.greatest(F.col("__now"), F.lit(1e-300))).alias("__ratio"))
                now = now.join(sums, d).withColumn("w", F.least(F.lit(1.0), F.col("w") * F.col("__ratio"))).withColumn("__off", F.greatest("__off", "__gap")).drop("__ratio", "__gap")
            now = cut(now)
            off, used = now.agg(F.max("__off") / (scale * total), F.bool_or(F.col("w") >= 1)).first()
            now = now.drop("__off")
            if r % 10 == 9:
                release(now.sparkSession)
            if off < TOLERANCE:
                return now, True
            if before is not None and abs(before - off) < 1e-3 * off and off > 10 * TOLERANCE and not used:
                return now, False
            before = off
        scale *= SHRINK
    return now, False


def probabilities(rows: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool, bool]:
    """(source, lang, topic, tokens, w) for the cells of weighed() rows, whether they are few enough to broadcast, and whether all margins fit.

    targets gives shares by dimension and category; categories that it leaves out get none, and
    dimensions that it leaves out are tempered.
    """
    temper, targets = temper or TEMPER, targets or {}
    cells = cut(rows.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__tokens").cast("double").alias("tokens")))
    n = cells.count()
    if n > max_cells:
        total = cells.agg(F.sum("tokens")).first()[0] or 0.0
        shares, scale = {}, 1.0
        for d in DIMENSIONS:
            sums = cells.groupBy(d).agg(F.sum("tokens").alias("t"))
            if d in targets:
                told = rows.sparkSession.createDataFrame(list(targets[d].items()), f"{d} string, share double")
                shares[d] = sums.join(told, d, "left").select(d, "t", F.coalesce("share", F.lit(0.0)).alias("share"))
            else:
                whole = sums.agg(F.sum(F.pow("t", F.lit(temper[d])))).first()[0] or 1.0
                shares[d] = sums.select(d, "t", (F.pow("t", F.lit(temper[d])) / whole).alias("share"))
            least = shares[d].filter("share > 0").agg(F.min(F.col("t") / (F.col("share") * max(total, 1.0)))).first()[0]
            scale = min(scale, least if least is not None else 1.0)
            shares[d] = cut(shares[d].select(d, "share"))
        found, fitted = rake_frames(cells, shares, scale, total)
        return found, False, fitted
    got = sorted(cells.collect())
    tokens = np.array([r["tokens"] for r in got], float)
    codes, shares = np.zeros((len(got), len(DIMENSIONS)), int), []
    for i, d in enumerate(DIMENSIONS):
        names = sorted({r[d] for r in got})
        at = {k: j for j, k in enumerate(names)}
        codes[:, i] = [at[r[d]] for r in got]
        sums = np.bincount(codes[:, i], tokens, len(names)) if got else np.zeros(0)
        share = targets[d] if d in targets else tempered(dict(zip(names, sums.tolist(), strict=True)), temper[d])
        shares.append(np.array([share.get(k, 0.0) for k in names], float))
    w, fitted = rake(codes, tokens, shares)
    made = [(*[r[d] for d in DIMENSIONS], r["tokens"], float(x)) for r, x in zip(got, w, strict=True)]
    return rows.sparkSession.createDataFrame(made, "source string, lang string, topic string, tokens double, w double"), True, fitted


def draw(rows: DataFrame, cells: DataFrame, few: bool, key: str = "doc_id") -> DataFrame:
    """weighed() rows with __w and __selected. Rows of the same id and cell share their fate."""
    told = cells.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("w").alias("__w"))
    joined = rows.join(F.broadcast(told) if few else told, [f"__{d}" for d in DIMENSIONS])  # bounded: MAX_CELLS cells
    return joined.withColumn("__selected", unit_hash(F.col(f"`{key}`"), "mixing") < F.col("__w"))


def mix(docs: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Every document with the weighed() columns, __w (its probability), __selected and __fitted (whether all margins fit: False where the
    targets contradict one another). docs has columns of its own of none of these names. Empty tables give no rows; null sources and
    languages are categories of their own; documents without tokens are drawn by their cell's probability like others."""
    rows = weighed(docs)
    cells, few, fitted = probabilities(rows, temper, targets, max_cells)
    return draw(rows, cells, few).withColumn("__fitted", F.lit(fitted))


def keep_drawn(docs: DataFrame, **options) -> DataFrame:
    """The documents drawn, with their own columns, whatever their names. Rows with a null id share one fate for each cell."""
    names = docs.columns
    used = [c for c in ("doc_id", "text", "source", "lang", "topic") if c in names]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.select("*", *[F.col(f"c{names.index(c)}").alias(c) for c in used])
    return mix(plain, **options).filter("__selected").select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op5_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__w").alias("weight"), F.col("__selected").alias("selected"), F.col("__fitted").alias("fitted")
    )
