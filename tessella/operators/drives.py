"""Several independent catalogues: what they share, what a backup lacks, what is on one alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import latest

GLOBAL = 1 << 40
BACKUP_SHARE = 0.9


def present(files: DataFrame) -> DataFrame:
    return files.filter("missing_since IS NULL AND full_hash IS NOT NULL")


def global_id(df: DataFrame, drive_no: str = "drive_no") -> DataFrame:
    return df.withColumn("gid", F.col(drive_no) * F.lit(GLOBAL) + F.col("id"))


def contents(files: DataFrame) -> DataFrame:
    return present(files).select("drive", "full_hash").distinct()


def overlap(files: DataFrame) -> DataFrame:
    """For each pair of drives (x < y): distinct contents of each and in common.

    One grouping by content gives each its set of drives; pairs come from those short sets, so there
    is one shuffle of contents however many drives there are.
    """
    of = contents(files).groupBy("full_hash").agg(F.sort_array(F.collect_set("drive")).alias("on"))
    totals = of.select(F.explode("on").alias("drive")).groupBy("drive").agg(F.count(F.lit(1)).alias("n"))
    pair = F.expr("flatten(transform(on, (x, i) -> transform(slice(on, i + 2, size(on)), y -> struct(x AS x, y AS y))))")
    shared = of.select(F.explode(pair).alias("p")).groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("shared"))
    x, y = totals.select(F.col("drive").alias("x"), F.col("n").alias("x_contents")), totals.select(F.col("drive").alias("y"), F.col("n").alias("y_contents"))
    both = F.broadcast(x).crossJoin(F.broadcast(y)).filter("x < y")  # a row for each drive: a handful
    return both.join(F.broadcast(shared), ["x", "y"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def probable_backup(pairs: DataFrame) -> DataFrame:
    """overlap() with `backup`: none where nothing is shared or neither side holds 90 % in common; mirror where both do and
    their totals are equal; else the smaller side's name."""
    of_x, of_y = F.col("shared") / F.col("x_contents"), F.col("shared") / F.col("y_contents")
    full_x, full_y = of_x >= BACKUP_SHARE, of_y >= BACKUP_SHARE
    told = (
        F.when(F.col("shared") == 0, "none")
        .when(full_x & full_y & (F.col("x_contents") == F.col("y_contents")), "mirror")
        .when(full_x | full_y, F.when(F.col("x_contents") <= F.col("y_contents"), F.col("x")).otherwise(F.col("y")))
        .otherwise("none")
    )
    return pairs.withColumn("backup", told)


def eligible(drives: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drives that are no backup, told (role) or suspected, in drives(drive, role)."""
    suspected = probable_backup(pairs).filter(~F.col("backup").isin("none", "mirror")).select(F.col("backup").alias("drive"))
    return drives.filter(F.coalesce(F.col("role") != "backup", F.lit(True))).join(suspected, "drive", "left_anti")


def primary_of(files: DataFrame, backup: str) -> DataFrame:
    """The drive that holds the largest share of a backup's contents; of equal ones the first by name."""
    mine = contents(files).filter(F.col("drive") == backup).select("full_hash")
    other = contents(files).filter(F.col("drive") != backup).join(mine, "full_hash", "left_semi").groupBy("drive").agg(F.count(F.lit(1)).alias("shared"))
    return other.orderBy(F.desc("shared"), "drive").limit(1)


def missing_on(files: DataFrame, here: str, there: str) -> DataFrame:
    """Files of one drive whose content the other lacks."""
    rows = present(files)
    return rows.filter(F.col("drive") == here).join(rows.filter(F.col("drive") == there).select("full_hash"), "full_hash", "left_anti")


def different_pairs(files: DataFrame, main: str, backup: str) -> DataFrame:
    """(path, main_id, backup_id): same path on both drives, and the main one's content nowhere on the backup."""
    rows = present(files)
    b = rows.filter(F.col("drive") == backup)
    gone = missing_on(files, main, backup).select("path", F.col("id").alias("main_id"))
    return gone.join(b.select("path", F.col("id").alias("backup_id")), "path")


def only_here(files: DataFrame, here: str, there: str, also_path: bool = False) -> DataFrame:
    """Files whose content the other drive lacks; with also_path also only those whose path it lacks."""
    out = missing_on(files, here, there)
    if also_path:
        out = out.join(present(files).filter(F.col("drive") == there).select("path"), "path", "left_anti")
    return out


def backup_report(files: DataFrame, main: str, backup: str) -> DataFrame:
    """Counts: missing on the backup, extra there, different under the same path, moved (same content, no common path)."""
    rows = present(files)
    different = different_pairs(files, main, backup)
    missing = only_here(files, main, backup).join(different.select(F.col("main_id").alias("id")), "id", "left_anti")
    extra = only_here(files, backup, main).join(different.select(F.col("backup_id").alias("id")), "id", "left_anti")
    a, b = rows.filter(F.col("drive") == main), rows.filter(F.col("drive") == backup)
    moved = a.join(b.select("full_hash"), "full_hash", "left_semi").join(b.select("full_hash", "path"), ["full_hash", "path"], "left_anti")
    parts = [d.select(F.lit(n).alias("what")) for n, d in (("missing", missing), ("extra", extra), ("different", different), ("moved", moved))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def removable_on_backup(files: DataFrame, removed: DataFrame, main: str, backup: str) -> DataFrame:
    """Ids on the backup of copies that were removed from the main drive: still there at the same path with the same content, the
    kept copy is on the main drive, the main drive lacks the path again, and the backup holds another file of the kept content."""
    rows = present(files)
    a, b = rows.filter(F.col("drive") == main), rows.filter(F.col("drive") == backup)
    r = removed.select("path", "full_hash", "kept_hash")
    on_b = b.select("id", "path", "full_hash").join(r, ["path", "full_hash"])
    on_b = on_b.join(a.select(F.col("full_hash").alias("kept_hash")), "kept_hash", "left_semi").join(a.select("path"), "path", "left_anti")
    kept = b.select(F.col("full_hash").alias("kept_hash"), F.col("id").alias("kid")).groupBy("kept_hash").agg(F.min("kid").alias("k_least"), F.max("kid").alias("k_most"))
    return on_b.join(kept, "kept_hash").filter("k_least <> id OR k_most <> id").select("id", "path").distinct()


def cross_groups(files: DataFrame) -> DataFrame:
    """Contents on two drives or more: (full_hash, n_drives, n_copies)."""
    return present(files).groupBy("full_hash").agg(F.countDistinct("drive").alias("n_drives"), F.count(F.lit(1)).alias("n_copies")).filter("n_drives >= 2")


def cross_duplicates(files: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """cross_groups with is_ignored: whether any copy lies in an ignored folder."""
    bad = F.lit(False)
    for f in ignored:
        bad = bad | (F.col("folder") == f) | F.col("folder").startswith(f + "/")
    rows = present(files).withColumn("__bad", bad)
    return rows.groupBy("full_hash").agg(F.countDistinct("drive").alias("n_drives"), F.count(F.lit(1)).alias("n_copies"), F.bool_or("__bad").alias("is_ignored")).filter("n_drives >= 2")


def shown_once(files: DataFrame) -> DataFrame:
    """One row for each photo that lies on several drives under one name: the latest by the user's date (none last), then drive, path (none last) and id."""
    rows = present(files).withColumn("copy_name", F.lower("name"))
    return latest(rows, ["copy_name", "full_hash"], F.col("dated_at").desc_nulls_last(), F.col("drive"), F.col("path").asc_nulls_last(), F.col("id"))


def other_copies(files: DataFrame, drive: str, file_id: int) -> DataFrame:
    rows = present(files).withColumn("copy_name", F.lower("name"))
    asked = rows.filter((F.col("drive") == drive) & (F.col("id") == file_id)).select("copy_name", "full_hash").distinct()
    return rows.join(F.broadcast(asked), ["copy_name", "full_hash"]).filter(~((F.col("drive") == drive) & (F.col("id") == file_id)))


def merge_people(per_drive: DataFrame) -> DataFrame:
    """People of all drives by name: faces and photos add up, hidden only if hidden everywhere, the group is the first drive's."""
    return per_drive.groupBy(F.lower("name").alias("person")).agg(
        F.countDistinct("drive").alias("n_drives"), F.sum("faces").alias("faces"), F.sum("photos").alias("photos"), F.bool_and("hidden").alias("hidden"), F.min_by("grp", F.struct("drive", "name")).alias("grp")
    )


def drive_facts(files: DataFrame) -> DataFrame:
    return files.groupBy("drive").agg(F.count_if(F.col("missing_since").isNull()).alias("n_files"), F.max("added_at").alias("last_new"), F.max("verified_at").alias("last_verified"))


def tag_hits(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of all drives by fold; a photo under one name and content counts once. tags(drive, file_id, name)."""
    rows = present(files).select("drive", F.col("id").alias("file_id"), F.lower("name").alias("copy_name"), "full_hash")
    return tags.join(rows, ["drive", "file_id"]).groupBy(F.lower(F.trim("name")).alias("tag")).agg(F.countDistinct(F.struct("copy_name", "full_hash")).alias("photos"), F.countDistinct("drive").alias("n_drives"))


def folder_names(files: DataFrame) -> DataFrame:
    """Names of folders at any level: distinct photos in or below them, and drives that have them."""
    rows = present(files).select("drive", "full_hash", F.explode(F.array_distinct(F.transform(F.split("folder", "/"), F.lower))).alias("folder_name"))
    return rows.groupBy("folder_name").agg(F.countDistinct("full_hash").alias("photos"), F.countDistinct("drive").alias("n_drives"))


def subtree_counts(files: DataFrame) -> DataFrame:
    """Files in each folder and below it."""
    from .timeline import ancestors

    return files.select(F.explode(ancestors(F.col("folder"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def latest_job(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("kind").agg(F.max("id").alias("id"), F.max_by("state", "id").alias("state"))


def running(jobs: DataFrame, now: int, within: int = 120) -> DataFrame:
    """Jobs that say they run and were heard of lately."""
    return jobs.filter((F.col("state") == "running") & (F.col("updated_at") > now - within))

