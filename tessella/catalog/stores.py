"""Queries over several drives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..adapters import load
from ..operators import drives


def _files(spark, d) -> DataFrame:
    return load(spark, d, "drive_paths")


def backup_overlap(spark, d):
    return drives.probable_backup(drives.overlap(_files(spark, d))).select("x", "y", F.col("x_contents"), F.col("y_contents"), "shared", "backup")


def backup_missing_different_extra(spark, d):
    return drives.backup_report(_files(spark, d), "a", "b")


def only_here(spark, d):
    return drives.only_here(_files(spark, d), "a", "b", also_path=True).select("id", "path")


def different_pairs(spark, d):
    return drives.different_pairs(_files(spark, d), "a", "b")


def cross_drive_duplicates(spark, d):
    return drives.cross_duplicates(_files(spark, d), ["en/src3", "de"])


def copies_shown_once(spark, d):
    rows = _files(spark, d).withColumn("dated_at", F.when(F.col("id") % 3 == 0, F.when(F.col("drive") == "a", F.col("id")).otherwise(F.col("id") + 5)))
    return drives.shown_once(rows).select("id", "drive", "path", "full_hash")


def removable_on_backup(spark, d):
    return drives.removable_on_backup(_files(spark, d), load(spark, d, "removed_copies"), "a", "b")


def merged_people(spark, d):
    return drives.merge_people(load(spark, d, "drive_people"))


def primary_of_backup(spark, d):
    return drives.primary_of(_files(spark, d), "b")


def drive_facts(spark, d):
    return drives.drive_facts(_files(spark, d))


def cross_drive_tags(spark, d):
    files = _files(spark, d)
    tags = load(spark, d, "file_tags").select("file_id", "name")
    both = tags.withColumn("drive", F.lit("a")).unionByName(tags.withColumn("drive", F.lit("b")))
    return drives.tag_hits(files, both)


def folder_name_suggestions(spark, d):
    return drives.folder_names(_files(spark, d))


def other_copies(spark, d):
    files = drives.present(_files(spark, d)).withColumn("copy_name", F.lower("name"))
    # Of every file, how many other copies it has: the per-file lookup for all files at once.
    per = files.groupBy("copy_name", "full_hash").agg(F.count(F.lit(1)).alias("n"))
    return files.join(per, ["copy_name", "full_hash"]).select("drive", "id", (F.col("n") - 1).alias("others"))


def carry_over_counts(spark, d):
    from ..operators import transfer

    rows = drives.present(_files(spark, d))
    target = rows.filter("drive = 'b'")
    source_tags = load(spark, d, "file_tags").filter("source = 'user'")
    return transfer.plan_counts(rows.filter("drive = 'a'"), target, source_tags, source_tags.filter(F.col("file_id") % 2 == 0))


def global_ids(spark, d):
    rows = _files(spark, d).withColumn("drive_no", F.when(F.col("drive") == "a", 0).otherwise(1))
    return drives.global_id(rows).groupBy("drive").agg(F.min("gid").alias("least"), F.max("gid").alias("most"))


def subtree_of_folders(spark, d):
    return drives.subtree_counts(load(spark, d, "files").filter("missing_since IS NULL"))


def latest_job_per_kind(spark, d):
    return drives.latest_job(load(spark, d, "jobs"))


def jobs_running(spark, d):
    return drives.running(load(spark, d, "jobs"), 1600000000 + 30 * 500).select("id", "kind")


def eligible_drives(spark, d):
    pairs = drives.overlap(_files(spark, d))
    roles = spark.createDataFrame([("a", None), ("b", None), ("c", "backup")], "drive string, role string")
    return drives.eligible(roles, pairs).select("drive")


QUERIES = {f.__name__: f for f in (backup_overlap, backup_missing_different_extra, only_here, different_pairs, cross_drive_duplicates, copies_shown_once, removable_on_backup, merged_people, primary_of_backup, drive_facts, cross_drive_tags, folder_name_suggestions, other_copies, carry_over_counts, global_ids, latest_job_per_kind, jobs_running, eligible_drives)} | {"folder_subtree_counts": subtree_of_folders}

_P = "p AS (SELECT * FROM drive_paths WHERE missing_since IS NULL AND full_hash IS NOT NULL), a AS (SELECT * FROM p WHERE drive = 'a'), b AS (SELECT * FROM p WHERE drive = 'b')"
_O = f"{_P}, o AS (SELECT (SELECT count(DISTINCT full_hash) FROM a) AS xc, (SELECT count(DISTINCT full_hash) FROM b) AS yc, (SELECT count(DISTINCT full_hash) FROM a WHERE full_hash IN (SELECT full_hash FROM b)) AS shared)"
_BACKUP = "CASE WHEN shared = 0 THEN 'none' WHEN shared >= 0.9 * xc AND shared >= 0.9 * yc AND xc = yc THEN 'mirror' WHEN shared >= 0.9 * xc OR shared >= 0.9 * yc THEN CASE WHEN xc <= yc THEN 'a' ELSE 'b' END ELSE 'none' END"
SQL = {
    "backup_overlap": f"WITH {_O} SELECT 'a' AS x, 'b' AS y, xc AS x_contents, yc AS y_contents, shared, {_BACKUP} AS backup FROM o",
    "backup_missing_different_extra": f"""WITH {_P}, dif AS (SELECT a.id AS aid, b.id AS bid FROM a JOIN b ON a.path = b.path WHERE a.full_hash NOT IN (SELECT full_hash FROM b)),
w AS (SELECT 'missing' AS what FROM a WHERE full_hash NOT IN (SELECT full_hash FROM b) AND id NOT IN (SELECT aid FROM dif)
UNION ALL SELECT 'extra' FROM b WHERE full_hash NOT IN (SELECT full_hash FROM a) AND id NOT IN (SELECT bid FROM dif)
UNION ALL SELECT 'different' FROM dif
UNION ALL SELECT 'moved' FROM a WHERE full_hash IN (SELECT full_hash FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.full_hash = a.full_hash AND b.path = a.path)) SELECT what, count(*) AS n FROM w GROUP BY what""",
    "only_here": f"WITH {_P} SELECT id, path FROM a WHERE full_hash NOT IN (SELECT full_hash FROM b) AND path NOT IN (SELECT path FROM b)",
    "different_pairs": f"WITH {_P} SELECT a.path, a.id AS main_id, b.id AS backup_id FROM a JOIN b ON a.path = b.path WHERE a.full_hash NOT IN (SELECT full_hash FROM b)",
    "cross_drive_duplicates": f"WITH {_P} SELECT full_hash, count(DISTINCT drive) AS n_drives, count(*) AS n_copies, bool_or(folder = 'en/src3' OR starts_with(folder, 'en/src3/') OR folder = 'de' OR starts_with(folder, 'de/')) AS is_ignored FROM p GROUP BY full_hash HAVING count(DISTINCT drive) >= 2",
    "copies_shown_once": f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(name), full_hash ORDER BY CASE WHEN id % 3 = 0 THEN CASE WHEN drive = 'a' THEN id ELSE id + 5 END END DESC NULLS LAST, drive, path) AS r FROM p) SELECT id, drive, path, full_hash FROM r WHERE r = 1",
    "removable_on_backup": f"WITH {_P} SELECT DISTINCT b.id, b.path FROM b JOIN removed_copies r ON r.path = b.path AND r.full_hash = b.full_hash WHERE r.kept_hash IN (SELECT full_hash FROM a) AND b.path NOT IN (SELECT path FROM a) AND EXISTS (SELECT 1 FROM b k WHERE k.full_hash = r.kept_hash AND k.id <> b.id)",
    "merged_people": "SELECT lower(name) AS person, count(DISTINCT drive) AS n_drives, CAST(sum(faces) AS BIGINT) AS faces, CAST(sum(photos) AS BIGINT) AS photos, bool_and(hidden) AS hidden, arg_min(grp, drive || name) AS grp FROM drive_people GROUP BY lower(name)",
    "primary_of_backup": f"WITH {_P} SELECT 'a' AS drive, count(DISTINCT full_hash) AS shared FROM a WHERE full_hash IN (SELECT full_hash FROM b)",
    "drive_facts": "SELECT drive, count(*) FILTER (WHERE missing_since IS NULL) AS n_files, max(added_at) AS last_new, max(verified_at) AS last_verified FROM drive_files GROUP BY drive",
    "cross_drive_tags": f"WITH {_P} SELECT lower(trim(t.name)) AS tag, count(DISTINCT lower(p.name) || p.full_hash) AS photos, count(DISTINCT p.drive) AS n_drives FROM file_tags t JOIN p ON p.id = t.file_id GROUP BY 1",
    "folder_name_suggestions": f"WITH {_P}, l AS (SELECT drive, full_hash, lower(unnest(string_split(folder, '/'))) AS folder_name FROM p) SELECT folder_name, count(DISTINCT full_hash) AS photos, count(DISTINCT drive) AS n_drives FROM l GROUP BY 1",
    "other_copies": f"WITH {_P} SELECT drive, id, count(*) OVER (PARTITION BY lower(name), full_hash) - 1 AS others FROM p",
    "carry_over_counts": f"""WITH {_P}, u AS (SELECT DISTINCT b.id AS file_id, lower(t.name) AS tag FROM file_tags t JOIN a ON a.id = t.file_id JOIN b ON b.quick_hash = a.quick_hash AND b.size = a.size AND b.full_hash = a.full_hash WHERE t.source = 'user')
SELECT tag, count(*) AS added FROM u WHERE NOT EXISTS (SELECT 1 FROM file_tags t WHERE t.file_id = u.file_id AND lower(t.name) = u.tag AND t.source = 'user' AND t.file_id % 2 = 0) GROUP BY tag""",
    "global_ids": "SELECT drive, min(CASE WHEN drive = 'a' THEN 0 ELSE 1099511627776 END + id) AS least, max(CASE WHEN drive = 'a' THEN 0 ELSE 1099511627776 END + id) AS most FROM drive_files GROUP BY drive",
    "latest_job_per_kind": "SELECT kind, max(id) AS id, arg_max(state, id) AS state FROM jobs GROUP BY kind",
    "jobs_running": "SELECT id, kind FROM jobs WHERE state = 'running' AND updated_at > 1600000000 + 30 * 500 - 120",
    "eligible_drives": f"WITH {_O} SELECT drive FROM (VALUES ('a'), ('b')) v(drive) WHERE drive <> (SELECT {_BACKUP} FROM o)",
    "folder_subtree_counts": """WITH RECURSIVE f AS (SELECT folder FROM files WHERE missing_since IS NULL), up AS (SELECT folder FROM f UNION ALL SELECT regexp_replace(folder, '/[^/]*$', '') FROM up WHERE contains(folder, '/')) SELECT folder, count(*) AS n FROM up GROUP BY folder""",
}
