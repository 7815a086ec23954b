"""What a user changes: tags, dates, positions, hidden folders, trash. Each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates
from ..functions.boxes import valid_position
from ..functions.strings import valid_name
from ..tables import delete, insert_ignore, upsert


def add_tag(tags: DataFrame, files: DataFrame, name: str, at: int) -> DataFrame:
    """tags(file_id, name, source, added_at) with an own tag on files(file_id). A tag is one by its fold and keeps its first spelling."""
    fold = name.strip().lower()
    first = tags.filter(F.lower(F.trim("name")) == fold).agg(F.min_by("name", F.coalesce("added_at", F.lit(0)))).first()[0]
    rows = files.select("file_id").distinct().select("file_id", F.lit(first or name.strip()).alias("name"), F.lit("user").alias("source"), F.lit(at).cast("bigint").alias("added_at"))
    have = tags.filter((F.lower(F.trim("name")) == fold) & (F.col("source") == "user")).select("file_id")
    return tags.unionByName(rows.filter(valid_name(F.col("name"))).join(have, "file_id", "left_anti"))


def remove_tag(tags: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Without an own tag on files; tags that folders give stay."""
    gone = tags.filter((F.lower(F.trim("name")) == name.strip().lower()) & (F.col("source") == "user")).join(files.select("file_id"), "file_id", "left_semi")
    return delete(tags, gone, ["file_id", "name", "source"])


def apply_dates(overrides: DataFrame, changes: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(table, undo): changes(key, taken, taken_offset), of which none may be invalid; undo has what stood before, null where nothing did."""
    bad = changes.filter(dates.capture_seconds(F.col("taken")).isNull()).limit(1).count()
    if bad:
        raise ValueError("a date that is none")
    new = changes.dropDuplicates(["key"]).withColumn("at", F.lit(at).cast("bigint"))
    undo = new.select("key").join(overrides.select("key", "taken", "taken_offset"), "key", "left")
    return upsert(overrides, new.select(overrides.columns), ["key"]), undo


def set_positions(overrides: DataFrame, changes: DataFrame, files: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(table, kept): positions by content; a file's own position wins, and such contents are counted as kept."""
    own = files.filter(valid_position(F.col("lat"), F.col("lon"))).select(F.col("full_hash").alias("key")).distinct()
    fine = changes.filter(valid_position(F.col("lat"), F.col("lon")))
    new = fine.join(own, "key", "left_anti").dropDuplicates(["key"]).withColumn("at", F.lit(at).cast("bigint"))
    return upsert(overrides, new.select(overrides.columns), ["key"]), fine.join(own, "key", "left_semi").agg(F.countDistinct("key").alias("kept"))


def set_hidden(folders: DataFrame, path: str, on: bool, at: int) -> DataFrame:
    row = folders.sparkSession.createDataFrame([(path, at)], "path string, added_at bigint")
    return insert_ignore(folders, row.select(folders.columns), ["path"]) if on else folders.filter(F.col("path") != path)


def rename_folder(rows: DataFrame, old: str, new: str, column: str = "path") -> DataFrame:
    """Rows of a folder and below it under its new path."""
    c = F.col(column)
    return rows.withColumn(column, F.when(c == old, new).when(c.startswith(old + "/"), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1_000_000))).otherwise(c))


def trash_list(trash: DataFrame) -> DataFrame:
    """Newest batch first; in a batch media before their companions, then by path."""
    return trash.orderBy(F.desc("batch"), F.col("kind").isNull(), "path")


def companions(files: DataFrame, first: int) -> DataFrame:
    """Files that go with one file: same folder and stem; videos only where they are clips."""
    from ..functions.strings import stem
    from .timeline import MOST_CLIP_MS

    rows = files.withColumn("__stem", F.lower(stem(F.col("name"))))
    one = rows.filter(F.col("id") == first).select("folder", "__stem")
    near = rows.join(F.broadcast(one), ["folder", "__stem"], "left_semi")  # one row
    return near.filter((F.col("id") == first) | (F.col("kind") != "video") | (F.col("duration_ms") <= MOST_CLIP_MS)).drop("__stem")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that were running when the catalogue was closed."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "interrupted").otherwise(F.col("state")))
