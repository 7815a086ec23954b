"""Search in recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Default limits of score and height, and the ranges that settings are held to.
SCORE, SCORE_RANGE = 0.7, (0.5, 1.0)
HEIGHT, HEIGHT_RANGE = 0.010, (0.004, 0.2)


def limits(score: float | None = None, height: float | None = None) -> tuple[float, float]:
    held = lambda v, d, r: min(max(d if v is None else v, r[0]), r[1])
    return held(score, SCORE, SCORE_RANGE), held(height, HEIGHT, HEIGHT_RANGE)


def shown(lines: DataFrame, score: float = SCORE, height: float = HEIGHT, hidden: DataFrame | None = None) -> DataFrame:
    """Lines within the limits that nobody has hidden. hidden(key, norm)."""
    out = lines.filter((F.col("score") >= score) & (F.col("h") >= height))
    return out.join(hidden, ["key", "norm"], "left_anti") if hidden is not None else out


def keys_with_word(lines: DataFrame, word: str) -> DataFrame:
    return lines.filter(F.col("norm").contains(word)).select("key").distinct()


def keys_with_all(lines: DataFrame, words: list[str]) -> DataFrame:
    """Keys that hold every word in some line, not the same one for all. One grouping whatever the number of words."""
    words = [w for w in dict.fromkeys(words) if w]
    if not words:
        return lines.select("key").distinct()
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.col("norm").contains(w)
    got = lines.filter(any_word).groupBy("key").agg(*[F.bool_or(F.col("norm").contains(w)).alias(f"w{i}") for i, w in enumerate(words)])
    return got.filter(" AND ".join(f"w{i}" for i in range(len(words)))).select("key")


def snippets(lines: DataFrame, words: list[str]) -> DataFrame:
    """(key, snippet): the first line by y, x, id that holds any of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("norm").contains(w)
    return lines.filter(hit).groupBy("key").agg(F.min_by("text", F.struct("y", "x", "id")).alias("snippet"))


def lines_of(lines: DataFrame, hidden: DataFrame, key) -> DataFrame:
    """A content's lines within the limits, those hidden marked."""
    mark = hidden.withColumn("is_hidden", F.lit(True))
    return shown(lines).filter(F.col("key") == key).join(mark, ["key", "norm"], "left").withColumn("is_hidden", F.coalesce("is_hidden", F.lit(False)))


def distance_to_limits(score: float = SCORE, height: float = HEIGHT) -> Column:
    return F.greatest(F.abs(F.col("score") - score) / score, F.abs(F.col("h") - height) / height)


def near_limits(lines: DataFrame, n: int, score: float = SCORE, height: float = HEIGHT) -> DataFrame:
    return lines.withColumn("distance", distance_to_limits(score, height)).orderBy("distance", "key", "y", "id").limit(n)


def trigrams(lines: DataFrame) -> DataFrame:
    """(trigram, id): an inverted index for substring search, for tables too large to scan for each word."""
    n = F.length("norm")
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring("norm", i, F.lit(3)))
    return lines.filter(n >= 3).select(F.explode(F.array_distinct(grams)).alias("trigram"), "id")


def ids_with(index: DataFrame, lines: DataFrame, word: str) -> DataFrame:
    """Ids of lines that hold a word of three letters or more: lines with all its trigrams, then a check of the text."""
    grams = sorted({word[i : i + 3] for i in range(len(word) - 2)})
    all_grams = index.filter(F.col("trigram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("id")
    return lines.join(all_grams, "id", "left_semi").filter(F.col("norm").contains(word)).select("id")


def hide(hidden: DataFrame, lines: DataFrame, key, norm: str, on: bool = True) -> DataFrame:
    """hidden(key, norm) with a line hidden or shown again; a line that doesn't exist changes nothing."""
    from ..tables import delete, insert_ignore

    row = lines.filter((F.col("key") == key) & (F.col("norm") == norm)).select("key", "norm").distinct()
    return insert_ignore(hidden, row, ["key", "norm"]) if on else delete(hidden, row, ["key", "norm"])


def stats(looked: DataFrame, lines: DataFrame, hidden: DataFrame) -> DataFrame:
    """Counts: contents read, contents with shown text, lines stored, lines shown, lines hidden."""
    seen = shown(lines, hidden=hidden)
    parts = [("read", looked.select("key")), ("with_text", seen.select("key").distinct()), ("stored", lines.select("key")), ("shown", seen.select("key")), ("hidden", hidden.select("key"))]
    out = None
    for name, d in parts:
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out
