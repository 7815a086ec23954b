"""Carrying a user's data over to another catalogue, by content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def matching(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_id, target_id) of the same content: equal quick hashes; sizes and full hashes equal where both are known."""
    s = source.select("quick_hash", F.col("id").alias("source_id"), F.col("size").alias("s_size"), F.col("full_hash").alias("s_full"))
    t = target.select("quick_hash", F.col("id").alias("target_id"), F.col("size").alias("t_size"), F.col("full_hash").alias("t_full"))
    loose = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(True))
    return s.join(t, "quick_hash").filter(loose("s_size", "t_size") & loose("s_full", "t_full")).select("source_id", "target_id")


def new_tags(source: DataFrame, target: DataFrame, source_tags: DataFrame, target_tags: DataFrame) -> DataFrame:
    """(file_id, tag) that the target lacks. Tags are (file_id, name); only additions, and a tag is one by its fold."""
    # Tags meet contents before the pairs of files, so a content with many copies on both sides makes a row for each target copy only.
    tagged = source_tags.join(source.select(F.col("id").alias("file_id"), "quick_hash", "size", "full_hash"), "file_id").select("quick_hash", "size", "full_hash", F.lower("name").alias("tag")).distinct()
    t = target.select("quick_hash", F.col("id").alias("file_id"), F.col("size").alias("t_size"), F.col("full_hash").alias("t_full"))
    loose = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(True))
    both = tagged.join(t, "quick_hash").filter(loose("size", "t_size") & loose("full_hash", "t_full")).select("file_id", "tag").distinct()
    return both.join(target_tags.select("file_id", F.lower("name").alias("tag")), ["file_id", "tag"], "left_anti")


def plan_counts(source: DataFrame, target: DataFrame, source_tags: DataFrame, target_tags: DataFrame) -> DataFrame:
    """(tag, added): what new_tags() would add."""
    return new_tags(source, target, source_tags, target_tags).groupBy("tag").agg(F.count(F.lit(1)).alias("added"))


def new_decisions(incoming: DataFrame, existing: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Incoming decisions (key, id, x, y, w, h, species, ...) that overlap no existing one of their species, nor one added before them, by
    least_iou or more. What is added depends on what was before, so each content's few boxes are handled in order of id."""
    from .vectors import _iou

    schema = incoming.schema

    def add(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        held, kept = list(old.itertuples()), []
        for r in new.sort_values("id").itertuples():
            like = [h for h in held if (h.species if not pd.isna(h.species) else None) == (r.species if not pd.isna(r.species) else None)]
            if all(_iou(r, h) < least_iou for h in like):
                held.append(r)
                kept.append(r.Index)
        out = new.loc[kept]
        return out.astype({c: object for c in out.columns if not pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c])})

    return incoming.groupBy("key").cogroup(existing.groupBy("key")).applyInPandas(add, schema)


def new_people(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, id): each incoming person's id at the target, by fold; those that are new get ids after the last."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    names = incoming.groupBy(F.lower(F.trim("name")).alias("fold")).agg(F.min("name").alias("name"))
    known = existing.groupBy(F.lower(F.trim("name")).alias("fold")).agg(F.min("id").alias("id"))
    found = names.join(known, "fold", "left")
    return found.select("name", F.coalesce("id", F.monotonically_increasing_id() + top + 1).alias("id"))


def new_keyed(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows by content (dates, positions, estimates): the target's own win."""
    return incoming.join(existing.select("key"), "key", "left_anti")


def new_positions(incoming: DataFrame, existing: DataFrame, files: DataFrame) -> DataFrame:
    """new_keyed() but for contents whose file has a position of its own."""
    own = files.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("full_hash").alias("key"))
    return new_keyed(incoming, existing).join(own, "key", "left_anti")


def user_data(tags: DataFrame, files: DataFrame) -> DataFrame:
    """One row a content with its own tags, sorted, as JSON text: the export of a user's data."""
    own = tags.filter("source = 'user'").join(files.select(F.col("id").alias("file_id"), F.col("full_hash").alias("key")), "file_id")
    by = own.groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("tags"))
    return by.select("key", F.to_json(F.struct("tags")).alias("data"))


def parse_user_data(rows: DataFrame) -> DataFrame:
    """(key, tag) of user_data() rows; entries that are no tag are dropped."""
    parsed = F.from_json("data", "tags array<string>")
    return rows.select("key", F.explode(parsed["tags"]).alias("tag")).filter((F.length(F.trim("tag")) > 0) & (F.char_length("tag") <= 100))


def export_names(files: DataFrame, existing: list[str] = ()) -> DataFrame:
    """(id, target): names for an export in the order of capture, unique without regard to case: the first of a name keeps it, later
    ones get _2, _3 and so on; names that exist at the target are taken too.

    A suffix could itself be a name of the export; such a name is numbered after those that have it by right.
    """
    from pyspark.sql import Window

    from ..functions.strings import extension, stem

    order = [F.col("taken").asc_nulls_last(), F.col("path"), F.col("id")]
    fold = F.lower("name")
    taken = files.sparkSession.createDataFrame([(n.lower(),) for n in existing], "fold string").distinct().withColumn("__there", F.lit(1))
    rows = files.withColumn("fold", fold).join(F.broadcast(taken), "fold", "left").withColumn("__r", F.row_number().over(Window.partitionBy("fold").orderBy(*order)) + F.coalesce("__there", F.lit(0)))
    name = F.when(F.col("__r") == 1, F.col("name")).otherwise(F.concat(stem(F.col("name")), F.lit("_"), F.col("__r").cast("string"), F.when(extension(F.col("name")) != "", F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1))).otherwise("")))
    first = rows.withColumn("target", name)
    # A made-up name that meets a given one moves on by its count of meetings.
    given = first.filter("__r = 1").select(F.lower("target").alias("t2"))
    meets = first.filter("__r > 1").join(given, F.lower("target") == F.col("t2"), "left_semi").select("id", F.lit(True).alias("__meets"))
    return first.join(meets, "id", "left").select("id", F.when(F.col("__meets"), F.concat(stem(F.col("target")), F.lit("_"), F.col("id").cast("string"), F.lit("."), F.element_at(F.split("target", r"\."), -1))).otherwise(F.col("target")).alias("target"))


def partners(files: DataFrame) -> DataFrame:
    """(id, raw_id, clip_id): for each still its raw file and its clip, by folder and stem; the clip taken at the same moment. First by id."""
    from .timeline import folded_clips
    from ..functions.strings import stem

    key = F.lower(stem(F.col("name")))
    rows = files.withColumn("__stem", key)
    raw = rows.filter("kind = 'raw'").groupBy("folder", "__stem").agg(F.min("id").alias("raw_id"))
    _, clips = folded_clips(files)
    stills = rows.filter(F.col("kind").isin("jpeg", "heic", "png"))
    return stills.join(raw, ["folder", "__stem"], "left").join(clips.select(F.col("still_id").alias("id"), "clip_id"), "id", "left").select("id", "raw_id", "clip_id")
