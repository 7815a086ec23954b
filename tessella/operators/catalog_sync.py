"""Keeping a catalogue in step with a directory tree."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import dates
from ..tables import cut
from .timeline import event


def reconcile(index: DataFrame, found: DataFrame) -> DataFrame:
    """(path, id, change) for every path that the index or the walk has; rows of equal paths are all told, each with each.

    index(id, path, size, mtime_ns, quick_hash, missing_since), found(path, size, mtime_ns, quick_hash). Changes: unchanged, tz_shifted
    (same content, time off by a time zone), changed, reappeared, added, missing, gone (was missing before), renamed_unicode (as it was,
    under a path of the same letters in another composed form). found's paths are composed (path_nfc, else path); with raw_path, the
    path as it is on the drive, and index's raw_path, the form that was read last, a change of form is told.
    """
    has_form = "raw_path" in index.columns and "raw_path" in found.columns
    form = F.col("i_raw") != F.col("f_raw") if has_form else F.lit(False)
    index = index.withColumn("i_raw", F.col("raw_path") if has_form else F.lit(None).cast("string"))
    found = found.withColumn("f_raw", F.col("raw_path") if has_form else F.lit(None).cast("string"))
    a = index.select("path", "id", "i_raw", *[F.col(c).alias(f"i_{c}") for c in ("size", "mtime_ns", "quick_hash", "missing_since")])
    b = found.select("path", "f_raw", *[F.col(c).alias(f"f_{c}") for c in ("size", "mtime_ns", "quick_hash")], F.lit(True).alias("__f"))
    same = (F.col("i_size") == F.col("f_size")) & (F.col("i_mtime_ns") == F.col("f_mtime_ns"))
    shifted = (F.col("i_quick_hash") == F.col("f_quick_hash")) & (F.col("i_size") == F.col("f_size")) & dates.is_tz_shift(F.col("f_mtime_ns") - F.col("i_mtime_ns"))
    change = (
        F.when(F.col("id").isNull(), "added")
        .when(F.col("__f").isNull(), F.when(F.col("i_missing_since").isNull(), "missing").otherwise("gone"))
        .when(F.col("i_missing_since").isNotNull(), "reappeared")
        .when(same & F.coalesce(form, F.lit(False)), "renamed_unicode")
        .when(same, "unchanged")
        .when(shifted, "tz_shifted")
        .otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", "id", change.alias("change"))


def match_moves(index: DataFrame, changes: DataFrame, found: DataFrame) -> DataFrame:
    """(path, id): new paths that are vanished records under another name; each record and path is used once.

    Candidates agree in size and quick hash; preferred are records with the same name, then those with the same time, then the least
    id. One that agrees in name and time is taken as it is; of others the full hash must agree where both sides have it. Paths choose in
    their order. A size and hash is one group; its rows are the copies of one content, and only those that vanished or are new, so they
    are handed to one function in order.
    """
    full = lambda rows: F.col("full_hash") if "full_hash" in rows.columns else F.lit(None).cast("string")
    gone = index.join(changes.filter("change IN ('missing', 'gone')").select("id"), "id", "left_semi").select("size", "quick_hash", "id", "path", "mtime_ns", full(index).alias("full"), F.lit(0).alias("side"))
    new = found.join(changes.filter("change = 'added'").select("path"), "path", "left_semi").select("size", "quick_hash", F.lit(None).cast("bigint").alias("id"), "path", "mtime_ns", full(found).alias("full"), F.lit(1).alias("side"))
    both = gone.unionByName(new)
    # Only keys with both sides can match.
    keys = both.groupBy("size", "quick_hash").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo <> hi").select("size", "quick_hash")

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        told = {int(r.id): (r.path.rsplit("/", 1)[-1], r.mtime_ns, r.full) for r in rows[rows.side == 0].sort_values("id").itertuples()}
        # Records in order of their ids: by name and time, by name, by time, all. Used ones are passed over once.
        lists: dict = {}
        for i, (name, at, _) in told.items():
            for key in ((name, at), ("name", name), ("time", at), "all"):
                lists.setdefault(key, deque()).append(i)
        out, used = [], set()
        for p in rows[rows.side == 1].sort_values("path").itertuples():
            name = p.path.rsplit("/", 1)[-1]
            best = None
            for key in ((name, p.mtime_ns), ("name", name), ("time", p.mtime_ns), "all"):
                own = lists.get(key, ())
                while own and own[0] in used:
                    own.popleft()
                plain = key == (name, p.mtime_ns)
                best = next((i for i in own if i not in used and (plain or told[i][2] is None or p.full is None or told[i][2] == p.full)), None)
                if best is not None:
                    break
            if best is not None:
                used.add(best)
                out.append((p.path, best))
        return pd.DataFrame(out, columns=["path", "id"]).astype({"path": object, "id": "int64"})

    return both.join(keys, ["size", "quick_hash"], "left_semi").groupBy("size", "quick_hash").applyInPandas(assign, "path string, id bigint")


def mark_missing(index: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """index with missing_since null where the walk found the path, else as it is, or now. Each row of the index stays, whatever paths repeat."""
    seen = found.select("path").distinct().withColumn("__seen", F.lit(True))
    out = index.join(seen, "path", "left")
    return out.withColumn("missing_since", F.when(F.col("__seen"), F.lit(None).cast("bigint")).otherwise(F.coalesce("missing_since", F.lit(now).cast("bigint")))).drop("__seen").select(index.columns)


def forget_missing(index: DataFrame) -> DataFrame:
    return index.filter("missing_since IS NULL")


def prune_folders(folders: DataFrame, files: DataFrame, job: int, rounds: int = 100) -> DataFrame:
    """Folders without leaves that this job has not seen and that hold neither files nor folders, again and again until none is left."""
    held = files.select(F.col("folder_id").alias("id")).distinct()
    now = folders
    n = now.count()
    for _ in range(rounds):
        empty = now.filter(F.col("last_seen") != job).join(held, "id", "left_anti").join(now.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti").select("id")
        now = cut(now.join(empty, "id", "left_anti"))
        left = now.count()
        if left == n:
            break
        n = left
    return now


def prune_tags(tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    return tags.join(file_tags.select(F.col("tag_id").alias("id")), "id", "left_semi")


def upsert_folders(old: DataFrame, paths: DataFrame, job: int) -> DataFrame:
    """Folders by path: those found get this job's number and their parsed event; new ones get ids after the last."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    name = F.element_at(F.split("path", "/"), -1)
    e = event(name)
    fresh = paths.select("path").distinct().join(old.select("path"), "path", "left_anti")
    # Ids by a running number within each range partition, so that no single task numbers all rows.
    numbered = fresh.withColumn("id", F.monotonically_increasing_id() + top + 1)
    new = numbered.select("id", "path", name.alias("name"), e["year"].alias("event_year"), e["month"].alias("event_month"), e["name"].alias("event_name"), F.lit(job).cast("bigint").alias("last_seen"))
    seen = old.join(paths.select("path").distinct().withColumn("__s", F.lit(True)), "path", "left").withColumn("last_seen", F.when(F.col("__s"), F.lit(job).cast("bigint")).otherwise(F.col("last_seen"))).drop("__s")
    return seen.select(new.columns).unionByName(new)


def folder_tags(files: DataFrame) -> DataFrame:
    """(file_id, name): a tag for each level of a file's folder, the event's name where the level is an event."""
    e = lambda level: F.coalesce(F.when(event(level)["name"] != "", event(level)["name"]), level)
    return files.select(F.col("id").alias("file_id"), F.explode(F.array_distinct(F.array_sort(F.transform(F.split("folder", "/"), e)))).alias("name"))


def replace_folder_tags(file_tags: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of folders made anew, the user's rows as they are."""
    own = file_tags.filter("source <> 'folder'").select("file_id", "name", "source")
    return own.unionByName(folder_tags(files).withColumn("source", F.lit("folder")))


def arrivals(files: DataFrame, after: int) -> DataFrame:
    """(id, keeper): new rows (id over the watermark) whose content a present older row has; the keeper is the first of those by path."""
    rows = files.filter("missing_since IS NULL AND full_hash IS NOT NULL")
    old = rows.filter(F.col("id") <= after).groupBy("full_hash").agg(F.min_by("id", "path").alias("keeper"))
    return rows.filter(F.col("id") > after).join(old, "full_hash").select("id", "keeper")


def pending_hashes(files: DataFrame) -> DataFrame:
    return files.filter("missing_since IS NULL AND full_hash IS NULL")


def verify(files: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, verdict): ok, unhashed, missing (no fresh hash), relocated (missing, but a present file elsewhere has the content), damaged
    (other bytes, same size and time) or changed. fresh(id, full_hash, size, mtime_ns)."""
    rows = files.filter("missing_since IS NULL")
    f = fresh.select("id", F.col("full_hash").alias("f_hash"), F.col("size").alias("f_size"), F.col("mtime_ns").alias("f_mtime"), F.lit(True).alias("__f"))
    copies = rows.join(fresh.select("id"), "id", "left_semi").groupBy("full_hash").agg(F.min("id").alias("c_least"), F.max("id").alias("c_most"))
    elsewhere = F.col("c_least").isNotNull() & ((F.col("c_least") != F.col("id")) | (F.col("c_most") != F.col("id")))
    verdict = (
        F.when(F.col("__f").isNull(), F.when(F.coalesce(elsewhere, F.lit(False)), "relocated").otherwise("missing"))
        .when(F.col("full_hash").isNull(), "unhashed")
        .when(F.col("f_hash") == F.col("full_hash"), "ok")
        .when((F.col("f_size") == F.col("size")) & (F.col("f_mtime") == F.col("mtime_ns")), "damaged")
        .otherwise("changed")
    )
    return rows.join(f, "id", "left").join(copies, "full_hash", "left").select("id", verdict.alias("verdict"))


def verify_order(files: DataFrame, n: int) -> DataFrame:
    """The next files to verify: never verified ones first, then the longest ago."""
    return files.filter("missing_since IS NULL").orderBy(F.col("verified_at").asc_nulls_first(), "path", "id").limit(n)


def kept_hash_backfill(trash: DataFrame, removed: DataFrame, within: int = 3600) -> DataFrame:
    """trash with kept_hash filled from the latest removal of the same path and content up to an hour after the deletion."""
    t = trash.select("id", "path", "full_hash", "deleted_at")
    r = removed.select("path", "full_hash", F.col("id").alias("rid"), F.col("kept_hash").alias("r_kept"), "removed_at")
    hit = t.join(r, ["path", "full_hash"]).filter(F.col("removed_at").between(F.col("deleted_at"), F.col("deleted_at") + within))
    best = hit.groupBy("id").agg(F.max_by("r_kept", "rid").alias("__kept"))
    return trash.join(best, "id", "left").withColumn("kept_hash", F.coalesce("__kept", "kept_hash")).drop("__kept")


def take_over(files: DataFrame, value: str, key: str = "quick_hash") -> DataFrame:
    """Copies without a value take it from a twin with the same key."""
    known = files.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, "id").alias("__v"))
    return files.join(known, key, "left").withColumn(value, F.coalesce(value, "__v")).drop("__v")

