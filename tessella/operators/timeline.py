"""Effective values, the timeline projection and its predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, strings
from ..tables import small

EVENT = r"^(\d{4}|\d{2})[-.]?(0[1-9]|1[0-2])(?:([-_. ])(.*))?$"
MOST_CLIP_MS = 6000
#: Sizes of the displays of phones, tablets and computers, either way round, and words in the names of pictures of them.
SCREENS = (
    (640, 960), (640, 1136), (750, 1334), (828, 1792), (1080, 1920), (1125, 2436), (1170, 2532), (1179, 2556),
    (1206, 2622), (1242, 2208), (1242, 2688), (1284, 2778), (1290, 2796), (1320, 2868),
    (720, 1280), (720, 1600), (1080, 2160), (1080, 2240), (1080, 2340), (1080, 2400), (1080, 2412),
    (1344, 2992), (1440, 2960), (1440, 3040), (1440, 3120), (1440, 3200),
    (1488, 2266), (1536, 2048), (1620, 2160), (1640, 2360), (1668, 2388), (2048, 2732),
    (1280, 800), (1366, 768), (1440, 900), (1536, 864), (1680, 1050), (1920, 1080), (1920, 1200),
    (2560, 1440), (2560, 1600), (2560, 1664), (2880, 1800), (2880, 1864), (3024, 1964),
    (3440, 1440), (3456, 2234), (3840, 2160), (5120, 2880),
)
SHOT_WORDS = ("screenshot", "screen shot", "screen-shot", "screen_shot", "bildschirmfoto", "bildschirmaufnahme", "bildschirmkopie")
SHOT_FROM = 60


def effective_taken(files: DataFrame, overrides: DataFrame, key: str = "full_hash") -> DataFrame:
    """files with eff_taken and eff_offset. An override's offset counts even where it is null."""
    o = overrides.select(F.col("key").alias(key), F.col("taken").alias("__taken"), F.col("taken_offset").alias("__offset"), F.lit(True).alias("__set"))
    out = files.join(o, key, "left")
    return (
        out.withColumn("eff_taken", F.coalesce("__taken", "taken"))
        .withColumn("eff_offset", F.when(F.col("__set"), F.col("__offset")).otherwise(F.col("taken_offset")))
        .drop("__taken", "__offset", "__set")
    )


def effective_position(files: DataFrame, overrides: DataFrame, key: str = "full_hash") -> DataFrame:
    """files with eff_lat and eff_lon: the file's own first, each by itself."""
    o = overrides.select(F.col("key").alias(key), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    out = files.join(o, key, "left")
    return out.withColumn("eff_lat", F.coalesce("lat", "__lat")).withColumn("eff_lon", F.coalesce("lon", "__lon")).drop("__lat", "__lon")


def event(name: Column) -> Column:
    """struct<year, month, name> of an event folder's name such as `2019-07 Summer`; null for others."""
    digits, month, sep, rest = (F.regexp_extract(name, EVENT, i) for i in (1, 2, 3, 4))
    year = F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(digits).cast("int")
    fine = name.rlike(EVENT) & ~(((sep == "") | (sep.isin("-", "_", "."))) & rest.rlike(r"^\d"))
    return F.when(fine, F.struct(year.alias("year"), month.cast("int").alias("month"), F.trim(rest).alias("name")))


def nearest_event(folder: Column) -> Column:
    """The event of the lowest level of a folder path that is one."""
    events = F.transform(F.reverse(F.split(folder, "/")), event)
    return F.try_element_at(F.filter(events, lambda e: e.isNotNull()), F.lit(1))


def shot_score(name: Column, kind: Column, width: Column, height: Column, camera: Column, pixels: Column) -> Column:
    """How much a picture looks like one of a screen, 0 to 100."""
    low = F.lower(name)
    worded = low.contains(SHOT_WORDS[0])
    for w in SHOT_WORDS[1:]:
        worded = worded | low.contains(w)
    sized = F.lit(False)
    for w, h in SCREENS:
        sized = sized | ((width == w) & (height == h)) | ((width == h) & (height == w))
    bare = camera.isNull()
    total = (
        F.when(worded, 50).otherwise(0)
        + F.when(kind == "png", 15).when(kind == "jpeg", 5).otherwise(0)
        + F.when(bare, 10).otherwise(0)
        + F.when(F.coalesce(sized, F.lit(False)), F.when(bare, 45).otherwise(25)).otherwise(0)
        + F.floor(F.coalesce(pixels, F.lit(0)) / 2).cast("int")
    )
    total = F.when(bare, total).otherwise(F.least(total, F.lit(40)))
    return F.when(kind.isin("png", "jpeg"), F.least(total, F.lit(100))).otherwise(0)


def folded_clips(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without the clips of still-and-clip pairs, and (still_id, clip_id): for each still its first clip by id.

    A clip is a video of up to 6 s; it belongs to the first still of its folder and stem that was taken at the same moment.
    """
    stem = F.lower(strings.stem(F.col("name")))
    rows = files.withColumn("__stem", stem)
    still = rows.filter(F.col("kind").isin("jpeg", "heic", "png")).select("folder", "__stem", *[F.col(c).alias(f"s_{c}") for c in ("id", "taken", "taken_offset", "mtime_ns")])
    clip = rows.filter((F.col("kind") == "video") & (F.col("duration_ms") <= MOST_CLIP_MS)).select("folder", "__stem", *[F.col(c).alias(f"c_{c}") for c in ("id", "taken", "taken_offset", "mtime_ns")])
    c = F.col
    pairs = still.join(clip, ["folder", "__stem"]).filter(dates.same_moment(c("s_taken"), c("s_taken_offset"), c("s_mtime_ns"), c("c_taken"), c("c_taken_offset"), c("c_mtime_ns")))
    mine = pairs.groupBy("c_id").agg(F.min("s_id").alias("s_id"))
    first = mine.groupBy("s_id").agg(F.min("c_id").alias("c_id")).select(c("s_id").alias("still_id"), c("c_id").alias("clip_id"))
    return files.join(mine.select(c("c_id").alias("id")), "id", "left_anti"), first


def timeline(files: DataFrame, overrides: DataFrame, estimates: DataFrame) -> DataFrame:
    """One item for each shown file with sort, date_source and precision.

    Date: the user's estimate, else the effective date, else the month of the nearest event folder,
    else the earlier of creation and change. Order by sort descending, then path in lower case.
    A file without a folder has no path.
    """
    shown = files.filter("missing_since IS NULL AND kind <> 'raw'")
    shown, pairs = folded_clips(shown)
    rows = effective_taken(shown, overrides)
    e = estimates.select(F.col("key").alias("full_hash"), F.col("year").alias("__y"), F.col("month").alias("__m"), F.col("day").alias("__d"))
    rows = rows.join(e, "full_hash", "left").join(pairs.select(F.col("still_id").alias("id"), "clip_id"), "id", "left")
    ev = nearest_event(F.col("folder"))
    created = F.coalesce(F.col("created_ns"), F.lit(0))
    by_created = (created > 0) & ((created <= F.col("mtime_ns")) | (F.col("mtime_ns") <= 0))

    def told(when, source, precision):
        return F.struct(when.alias("sort"), F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"), precision.alias("precision"))

    chosen = (
        F.when(F.col("__y").isNotNull(), told(dates.estimate_key(F.col("__y"), F.col("__m"), F.col("__d")), "estimate", dates.precision(F.col("__m"), F.col("__d"))))
        .when(F.col("eff_taken").isNotNull(), told(F.col("eff_taken"), "taken", F.lit("day")))
        .when(ev.isNotNull(), told(F.format_string("%04d-%02d-01", ev["year"], ev["month"]), "folder", F.lit("month")))
        .otherwise(told(dates.local_text(dates.earlier_of(created, F.col("mtime_ns"))), F.when(by_created, "created").otherwise("modified"), F.lit("day")))
    )
    out = rows.withColumn("__c", chosen).withColumn("sort", F.col("__c.sort")).withColumn("date_source", F.col("__c.source")).withColumn("precision", F.col("__c.precision"))
    return out.withColumn("path", F.concat("folder", F.lit("/"), "name")).drop("__c", "__y", "__m", "__d")


def in_order(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("sort"), F.lower("path"))


def parts(items: DataFrame) -> DataFrame:
    """items with year, month, day cut to their precision, and day_code (YYYYMMDD; 0000 for a year alone)."""
    at = lambda a, n: F.substring("sort", a, n).cast("int")
    return (
        items.withColumn("year", at(1, 4))
        .withColumn("month", F.when(F.col("precision") != "year", at(6, 2)))
        .withColumn("day", F.when(F.col("precision") == "day", at(9, 2)))
        .withColumn("day_code", F.col("year") * 10000 + F.coalesce("month", F.lit(0)) * 100 + F.coalesce("day", F.when(F.col("precision") == "month", F.lit(1)).otherwise(0)))
    )


def needs_a_date(items: DataFrame) -> DataFrame:
    return items.filter(F.col("date_source").isin("folder", "created", "modified"))


def media_type(items: DataFrame, marks: DataFrame) -> DataFrame:
    """items with media_type: photo, video, live or screenshot; each item is of one."""
    m = marks.select(F.col("key").alias("full_hash"), "is_shot")
    score = shot_score(F.col("name"), F.col("kind"), F.col("width"), F.col("height"), F.col("camera"), F.col("shot_pixels"))
    is_shot = F.coalesce("is_shot", score >= SHOT_FROM)
    return items.join(m, "full_hash", "left").withColumn("shot_score", score).withColumn(
        "media_type", F.when(F.col("kind") == "video", "video").when(F.col("clip_id").isNotNull(), "live").when(is_shot, "screenshot").otherwise("photo")
    ).drop("is_shot")


def month_groups(items: DataFrame) -> DataFrame:
    return parts(items).groupBy(F.floor(F.col("day_code") / 100).cast("int").alias("month_code")).agg(F.count(F.lit(1)).alias("n"))


def hidden(items: DataFrame, folders: DataFrame) -> DataFrame:
    """items with is_hidden: whether a flagged folder holds them, at any level. Each folder is looked at once."""
    flagged = small(folders.select(F.col("path").alias("__above")).distinct())
    own = items.select("folder").distinct()
    held = own.select("folder", F.explode(ancestors(F.col("folder"))).alias("__above")).join(flagged, "__above", "left_semi").select("folder").distinct()
    return items.join(held.withColumn("__h", F.lit(True)), "folder", "left").withColumn("is_hidden", F.coalesce("__h", F.lit(False))).drop("__h")


def ancestors(folder: Column) -> Column:
    """A folder and the folders above it, as paths."""
    levels = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(levels)), lambda i: F.array_join(F.slice(levels, F.lit(1), i), "/"))


def details(items: DataFrame, tags: DataFrame, file_id: int) -> DataFrame:
    """One item with its tags, those of folders first."""
    mine = tags.filter(F.col("file_id") == file_id).groupBy(F.col("file_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("source") != "folder").alias("own"), "name"))), lambda t: t["name"]).alias("tags"))
    return items.filter(F.col("id") == file_id).join(mine, "id", "left")


def hiding_folder(items: DataFrame, folders: DataFrame) -> DataFrame:
    """(id, hiding_folder): the lowest flagged folder above each item."""
    flagged = small(folders.select(F.col("path").alias("above")).distinct())
    return items.select("id", F.explode(ancestors(F.col("folder"))).alias("above")).join(flagged, "above").groupBy("id").agg(F.max_by("above", F.length("above")).alias("hiding_folder"))

