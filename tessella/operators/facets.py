"""Counts beside a search: tags, dates, people, places, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes
from ..tables import small
from . import timeline


def tag_facets(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Every tag with its present files (clips too, raw ones not): kind by its sources, own files, latest use."""
    rows = files.filter("missing_since IS NULL AND kind <> 'raw'").select(F.col("id").alias("file_id"))
    own = F.col("source") == "user"
    return (
        tags.join(rows, "file_id")
        .groupBy("name")
        .agg(
            F.countDistinct("file_id").alias("n"),
            F.when(F.bool_and(own), "own").when(F.bool_or(own), "both").otherwise("folder").alias("tag_kind"),
            F.countDistinct(F.when(own, F.col("file_id"))).alias("n_own"),
            F.max("added_at").alias("last_used"),
        )
    )


def facets_within(items: DataFrame, tags: DataFrame, skip: list[str] = ()) -> DataFrame:
    """Tags within the items shown, but for those a query has chosen already."""
    rows = tags.filter(~F.col("name").isin(*skip)) if skip else tags
    return rows.join(items.select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy("name").agg(F.countDistinct("file_id").alias("n"))


def date_facets(items: DataFrame) -> DataFrame:
    """(year, month, n): items by year (month null) and by month."""
    rows = timeline.parts(items)
    years = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n")).select("year", F.lit(None).cast("int").alias("month"), "n")
    return years.unionByName(rows.filter("month IS NOT NULL").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")))


def suggest_dates(items: DataFrame, terms: list, limit: int = 12) -> DataFrame:
    """(term, n) for each candidate term that some item lies in, in the given order."""
    rows = timeline.parts(items)
    counted = rows.agg(*[F.count_if(t.matches(F.col("year"), F.col("month"), F.col("day"))).alias(f"t{i}") for i, t in enumerate(terms)])
    stacked = counted.select(F.posexplode(F.array(*[F.col(f"t{i}") for i in range(len(terms))])).alias("term", "n"))
    return stacked.filter("n > 0").orderBy("term").limit(limit)


def counters(files: DataFrame) -> DataFrame:
    here = F.col("missing_since").isNull()
    return files.agg(F.count_if(here).alias("present"), F.count_if(~here).alias("missing"), F.count_if(here & F.col("full_hash").isNull()).alias("unhashed"), F.coalesce(F.sum(F.when(here, F.col("size"))), F.lit(0)).alias("bytes"))


def histogram(df: DataFrame, value: Column, edges: list[float], **sub: Column) -> DataFrame:
    """Half-open buckets (edge to next edge) with open ends: (bucket, n) and a count for each condition in sub."""
    bucket = F.lit(0)
    for i, e in enumerate(edges):
        bucket = F.when(value >= e, i + 1).otherwise(bucket)
    return df.filter(value.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in sub.items()])


def looks_emptied(files: DataFrame) -> DataFrame:
    """Whether more than half of the rows are missing."""
    return files.agg((F.count_if(F.col("missing_since").isNotNull()) * 2 > F.count(F.lit(1))).alias("emptied"))


def recognition_overview(files: DataFrame, looked: DataFrame) -> DataFrame:
    """Distinct present contents: all, looked at, failed."""
    keys = files.filter("missing_since IS NULL").select(F.col("full_hash").alias("key")).distinct()
    return keys.join(looked.select("key", "error", F.lit(1).alias("__l")), "key", "left").agg(F.count(F.lit(1)).alias("contents"), F.count("__l").alias("looked"), F.count("error").alias("failed"))


def errors(looked: DataFrame, n: int = 5) -> DataFrame:
    return looked.filter("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(n)


def pending(files: DataFrame, looked: DataFrame, model: int | None = None, retry: bool = False) -> DataFrame:
    """(key, taken, path) of contents still to look at, newest first: never looked at, by another model, or failed if asked to retry."""
    keys = files.filter("missing_since IS NULL AND kind <> 'video'").groupBy(F.col("full_hash").alias("key")).agg(F.max(F.coalesce("taken", F.lit(""))).alias("taken"), F.min(F.concat_ws("/", "folder", "name")).alias("path"))
    done = looked
    if model is not None:
        done = done.filter(F.col("model") == model)
    if retry:
        done = done.filter("error IS NULL")
    return keys.join(done, "key", "left_anti")


def ranked_pending(rows: DataFrame) -> DataFrame:
    """Pending contents with rank: pictures of screens 0, without a camera 1, others 2."""
    score = timeline.shot_score(F.col("name"), F.col("kind"), F.col("width"), F.col("height"), F.col("camera"), F.col("shot_pixels"))
    return rows.withColumn("rank", F.when(score >= timeline.SHOT_FROM, 0).when(F.col("camera").isNull(), 1).otherwise(2))


def places(points: DataFrame, named: DataFrame) -> DataFrame:
    """(place, n) of points(lat, lon) in named rectangles. The rectangles are few and broadcast after a count; points are never moved."""
    p, r = points.alias("p"), small(named).alias("r")
    inside = boxes.in_area(F.col("p.lat"), F.col("p.lon"), F.col("r.south"), F.col("r.west"), F.col("r.north"), F.col("r.east"))
    return p.join(r, inside).groupBy(F.col("r.name").alias("place")).agg(F.count(F.lit(1)).alias("n"))


def places_by_cell(points: DataFrame, named: DataFrame, degrees: float = 10.0) -> DataFrame:
    """places() for so many rectangles that they can't be broadcast: both sides are dealt by grid cells and joined on them."""
    cells = lambda lo, hi: F.sequence(F.floor(lo / degrees).cast("int"), F.floor(hi / degrees).cast("int"))
    named = named.select(F.col("name").alias("place"), "south", "west", "north", "east")
    r = named.withColumn("cy", F.explode(cells(F.col("south"), F.col("north")))).withColumn("cx", F.explode(cells(F.col("west"), F.col("east"))))
    p = points.select("lat", "lon").withColumn("cy", F.floor(F.col("lat") / degrees).cast("int")).withColumn("cx", F.floor(F.col("lon") / degrees).cast("int"))
    both = p.join(r, ["cy", "cx"]).filter(boxes.in_area(F.col("lat"), F.col("lon"), F.col("south"), F.col("west"), F.col("north"), F.col("east")))
    return both.groupBy("place").agg(F.count(F.lit(1)).alias("n"))


def export_summary(files: DataFrame) -> DataFrame:
    """Files and bytes by role: photo, raw, clip."""
    role = F.when(F.col("kind") == "raw", "raw").when(F.col("kind") == "video", "clip").otherwise("photo")
    return files.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def pair_counts(files: DataFrame) -> DataFrame:
    """Stems of a folder that have a raw file and a photo, and a clip and a photo."""
    from ..functions.strings import stem

    per = files.groupBy("folder", F.lower(stem(F.col("name"))).alias("__stem")).agg(F.bool_or(F.col("kind") == "raw").alias("r"), F.bool_or(F.col("kind") == "video").alias("v"), F.bool_or(F.col("kind").isin("jpeg", "heic", "png")).alias("p"))
    return per.agg(F.count_if(F.col("r") & F.col("p")).alias("raw_pairs"), F.count_if(F.col("v") & F.col("p")).alias("clip_pairs"))


def own_tags_of(tags: DataFrame, ids: DataFrame) -> DataFrame:
    return tags.filter("source = 'user'").join(ids, "file_id", "left_semi").groupBy("name").agg(F.countDistinct("file_id").alias("n"))


def first_names(files: DataFrame, n: int = 20) -> DataFrame:
    """One row: the count of files and the first n names in order."""
    first = files.select("name").orderBy("name").limit(n).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return files.agg(F.count(F.lit(1)).alias("n")).crossJoin(first)  # one row each
