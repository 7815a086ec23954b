"""Removing copies, the trash, and what is carried between drives: plans and records, not the moving of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates
from ..tables import small
from . import dupes


def removal_plan(files: DataFrame, tags: DataFrame, keep: DataFrame, remove: DataFrame) -> dict[str, DataFrame]:
    """What removing copies does: heirs (id, heir), tags (file_id, name) that the heirs get as own ones, dates (heir, taken) they get, and
    conflicts: (id, why) of files that are no copy of one that stays (`no_heir`) or whose dates disagree (`date`). With any conflict
    nothing may be removed.

    files(id, grp, ...); keep(id) and remove(id). A date goes over where the heir has none, or to the oldest of dates within a day.
    """
    kept, gone = files.join(small(keep.select("id")), "id", "left_semi"), files.join(small(remove.select("id")), "id", "left_semi")
    heirs = dupes.heirs(gone, kept)
    lone = gone.join(heirs.select("id"), "id", "left_anti").select("id", F.lit("no_heir").alias("why"))
    both = keep.select("id").join(remove.select("id"), "id", "left_semi").select("id", F.lit("keeps_and_goes").alias("why"))
    own = tags.join(heirs.withColumnRenamed("id", "file_id"), "file_id").filter("source = 'user' OR lower(name) <> 'hidden'").select(F.col("heir").alias("file_id"), F.col("name"))
    held = tags.select("file_id", F.lower("name").alias("fold"))
    carried = own.withColumn("fold", F.lower("name")).join(held, ["file_id", "fold"], "left_anti").groupBy("file_id", "fold").agg(F.min("name").alias("name")).drop("fold")
    members = heirs.join(gone.select("id", "taken"), "id").select(F.col("heir").alias("grp"), "taken", F.lit(False).alias("is_best")).unionByName(kept.join(heirs.select(F.col("heir").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("grp"), "taken", F.lit(True).alias("is_best")))
    merged = dupes.merge_dates(members)
    clash = merged.filter("action = 'conflict'").select(F.col("grp").alias("id"), F.lit("date").alias("why"))
    return {"heirs": heirs, "tags": carried, "dates": merged.filter("action = 'set'").select(F.col("grp").alias("heir"), "taken"), "conflicts": lone.unionByName(both).unionByName(clash)}


def to_trash(files: DataFrame, tags: DataFrame, trash: DataFrame, ids: DataFrame, at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, tags, trash) after the files of ids(id) and their companions went: those of one folder and stem. The trash keeps each
    file's record with its tags, under one batch, the time."""
    from ..functions.strings import stem

    key = F.lower(stem(F.col("name")))
    asked = files.join(small(ids.select("id")), "id", "left_semi").select("folder", key.alias("__stem")).distinct()
    gone = files.withColumn("__stem", key).join(asked, ["folder", "__stem"], "left_semi").drop("__stem")
    own = tags.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy(F.col("file_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("name", "source"))).alias("tags"))  # a file's tags
    rows = gone.join(own, "id", "left").withColumn("batch", F.lit(at).cast("bigint"))
    left = files.join(gone.select("id"), "id", "left_anti")
    return left, tags.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti"), trash.unionByName(rows.select(trash.columns), allowMissingColumns=True)


def restore(files: DataFrame, tags: DataFrame, trash: DataFrame, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, tags, trash) after a batch came back with its tags; files whose path is taken again stay in the trash."""
    mine = trash.filter(F.col("batch") == batch).join(files.select("folder", "name"), ["folder", "name"], "left_anti")
    told = mine.select(F.col("id").alias("file_id"), F.explode("tags").alias("t")).select("file_id", "t.name", "t.source")
    return files.unionByName(mine.select(files.columns)), tags.unionByName(told, allowMissingColumns=True), trash.join(mine.select("id"), "id", "left_anti")


def empty_trash(trash: DataFrame, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(trash, gone): without the batches before a time, or without any."""
    gone = trash if before is None else trash.filter(F.col("batch") < before)
    return trash.join(gone.select("id"), "id", "left_anti"), gone


def carry_over_matrix(files: DataFrame, tags: DataFrame, eligible: DataFrame) -> DataFrame:
    """(source, target, added) for every ordered pair of eligible drives: tags that files of the target would get from files of one
    content on the source. files(drive, id, full_hash), tags(drive, file_id, name); pairs that add nothing are left out.

    Each content's tags by drive and its files by drive meet once, not once for each pair of drives.
    """
    on = lambda rows: rows.join(F.broadcast(eligible.select("drive").distinct()), "drive", "left_semi")  # noqa: E731  a row a drive
    own = on(files).filter("missing_since IS NULL").select("drive", F.col("id").alias("file_id"), "full_hash")
    told = on(tags).filter("source = 'user'").select("drive", "file_id", F.lower("name").alias("tag"))
    given = told.join(own, ["drive", "file_id"]).select(F.col("drive").alias("source"), "full_hash", "tag").distinct()
    new = given.join(own.select(F.col("drive").alias("target"), "file_id", "full_hash"), "full_hash").filter("source <> target")
    held = on(tags).select(F.col("drive").alias("target"), "file_id", F.lower("name").alias("tag"))
    return new.join(held, ["target", "file_id", "tag"], "left_anti").groupBy("source", "target").agg(F.count(F.lit(1)).alias("added"))


def date_check(files: DataFrame) -> DataFrame:
    """One row about a selection: files, those with a capture time, their distinct days, and the first 20 names of those without."""
    day = F.substring("taken", 1, 10)
    names = F.slice(F.sort_array(F.collect_set(F.when(F.col("taken").isNull(), F.col("name")))), 1, 20)  # names of a selection, of which the first 20 are told
    return files.agg(F.count(F.lit(1)).alias("n"), F.count("taken").alias("dated"), F.countDistinct(day).alias("days"), names.alias("undated_names"))


def spread_seconds(files: DataFrame) -> DataFrame:
    """One row: how far the capture times of a selection lie apart."""
    at = dates.capture_seconds(F.col("taken"))
    return files.agg((F.max(at) - F.min(at)).alias("seconds"))
