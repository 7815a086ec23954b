"""Search over several drives at once, by names rather than ids."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..plans.query import Library, Query, compile_query
from ..tables import latest


@dataclass(frozen=True)
class NamedQuery:
    """A query whose people and groups are names; the rest is as in Query."""

    query: Query = Query()
    people: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()


def query_for(lib: Library, named: NamedQuery) -> Query | None:
    """The query of one drive; None where the drive lacks one of the names, as it then shows nothing."""
    ids: dict[str, tuple[int, ...]] = {}
    for part, keyed, column in (("people", lib.person_keys, "person_id"), ("groups", lib.group_keys, "group_id")):
        found = []
        for name in getattr(named, part):
            got = keyed.filter(F.lower("name") == name.lower()).agg(F.min(column)).first()[0] if keyed is not None else None
            if got is None:
                return None
            found.append(got)
        ids[part] = tuple(found)
    for tag in named.query.tags:
        if not lib.tags.filter(F.lower(F.trim("name")) == tag.strip().lower()).limit(1).count():
            return None
    return replace(named.query, **ids)


def timeline(drives: dict[str, Library], named: NamedQuery) -> DataFrame | None:
    """Items of all drives, a photo that lies on several (one name and content) once: the one with the latest date of the user's, then by drive,
    path (none last) and id; loved if any copy is. Items whose content is unknown count as one content. Sorted newest first, then by path, drive
    and id. None where no drive can show anything."""
    parts = []
    for drive, lib in drives.items():
        q = query_for(lib, named)
        if q is None:
            continue
        hearts = lib.tags.filter(F.lower("name") == "favourite").select(F.col("file_id").alias("id"), F.lit(True).alias("loved")).distinct()
        dated = F.col("dated_at") if "dated_at" in lib.items.columns else F.lit(None).cast("bigint")
        items = compile_query(lib, q).join(hearts, "id", "left")
        parts.append(items.select(F.lit(drive).alias("drive"), "id", "path", "sort", "full_hash", F.lower("name").alias("copy_name"), dated.alias("dated_at"), F.coalesce("loved", F.lit(False)).alias("loved")))
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    loved = rows.groupBy(F.col("copy_name").alias("__name"), F.col("full_hash").alias("__hash")).agg(F.bool_or("loved").alias("loved"), F.countDistinct("drive").alias("n_drives"))
    once = latest(rows.drop("loved"), ["copy_name", "full_hash"], F.col("dated_at").desc_nulls_last(), F.col("drive"), F.col("path").asc_nulls_last(), F.col("id"))
    same = F.col("copy_name").eqNullSafe(F.col("__name")) & F.col("full_hash").eqNullSafe(F.col("__hash"))
    return once.join(loved, same).drop("__name", "__hash").orderBy(F.desc("sort"), "path", "drive", "id")


def group_hits(per_drive: DataFrame) -> DataFrame:
    """Groups of all drives by name; their counts are added up, not counted anew. per_drive(drive, name, n)."""
    return per_drive.groupBy(F.lower("name").alias("grp")).agg(F.sum("n").alias("n"), F.countDistinct("drive").alias("n_drives"))


def people_hits(per_drive: DataFrame) -> DataFrame:
    """People of all drives by name, with distinct photos. per_drive(drive, name, copy_name, full_hash)."""
    return per_drive.groupBy(F.lower("name").alias("person")).agg(F.countDistinct(F.struct("copy_name", "full_hash")).alias("photos"), F.countDistinct("drive").alias("n_drives"))
