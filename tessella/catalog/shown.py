"""Queries over the timeline: its projection, predicates, facets and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import load
from ..functions import dates
from ..operators import facets, text, timeline
from ..plans.query import Library, Query, compile_query


def _items(spark, d):
    items = timeline.timeline(load(spark, d, "files"), load(spark, d, "taken_overrides"), load(spark, d, "date_estimates"))
    return timeline.hidden(timeline.media_type(items, load(spark, d, "shot_marks")), load(spark, d, "hidden_folders"))


def _lines(spark, d):
    return load(spark, d, "text_lines").withColumn("norm", F.lower("text"))


def _library(spark, d):
    items = _items(spark, d)
    faces = load(spark, d, "faces")
    keys = items.select("id", "full_hash")
    of = faces.select(F.col("key").alias("id"), F.col("label").alias("person_id"), "species").join(keys, "id").withColumnRenamed("full_hash", "key")
    people = load(spark, d, "people").select(F.col("id").alias("person_id"), "name", "hidden")
    positions = timeline.effective_position(load(spark, d, "files"), load(spark, d, "geo_overrides")).select(F.col("full_hash").alias("key"), F.col("eff_lat").alias("lat"), F.col("eff_lon").alias("lon"))
    lines = _lines(spark, d).select(F.col("key").alias("id"), "norm").join(keys, "id").select(F.col("full_hash").alias("key"), "norm")
    return Library(items, load(spark, d, "file_tags"), of.join(F.broadcast(people), "person_id"), None, of.filter("species <> 'person'").select("species", "key"), lines, positions, {"hidden_folders": load(spark, d, "hidden_folders")})


def timeline_fallback_dates(spark, d):
    return timeline.parts(_items(spark, d)).select("id", "path", "sort", "date_source", "precision", "day_code")


def timeline_media_types(spark, d):
    return _items(spark, d).select("id", "media_type", "shot_score", "is_hidden", "clip_id")


def date_term_filter(spark, d):
    rows = timeline.parts(_items(spark, d))
    return rows.filter(dates.Term(year=2013, month=4).matches(F.col("year"), F.col("month"), F.col("day"))).select("id", "sort")


def needs_a_date(spark, d):
    return timeline.needs_a_date(_items(spark, d)).select("id", "date_source")


def month_groups(spark, d):
    return timeline.month_groups(_items(spark, d))


def effective_values(spark, d):
    files = timeline.effective_taken(load(spark, d, "files"), load(spark, d, "taken_overrides"))
    files = timeline.effective_position(files, load(spark, d, "geo_overrides"))
    return files.select("id", "eff_taken", "eff_offset", "eff_lat", "eff_lon")


def faceted_query_and(spark, d):
    q = Query(tags=("en",), types=("photo", "live", "screenshot"), area=(-60.0, -170.0, 70.0, 170.0))
    return compile_query(_library(spark, d), q).select("id")


def free_text_words(spark, d):
    return compile_query(_library(spark, d), Query(text="trip fr")).select("id")


def favourite_query(spark, d):
    return compile_query(_library(spark, d), Query(favourite=True)).select("id")


def people_query(spark, d):
    return compile_query(_library(spark, d), Query(people=(1,), pets=("pet",))).select("id")


def names_query(spark, d):
    return compile_query(_library(spark, d), Query(names=("img 00",), folder="en")).select("id")


def text_query(spark, d):
    return compile_query(_library(spark, d), Query(in_text="the an")).select("id")


def hidden_query(spark, d):
    return compile_query(_library(spark, d), Query(hidden=True)).select("id")


def hiding_folders(spark, d):
    return timeline.hiding_folder(_items(spark, d), load(spark, d, "hidden_folders"))


def tag_facets(spark, d):
    return facets.tag_facets(load(spark, d, "files"), load(spark, d, "file_tags"))


def facets_within(spark, d):
    items = _items(spark, d).filter("media_type = 'photo'")
    return facets.facets_within(items, load(spark, d, "file_tags"), ["en"])


def date_facets(spark, d):
    return facets.date_facets(_items(spark, d))


def date_suggestions(spark, d):
    terms = [dates.Term(year=y) for y in range(2008, 2026)] + [dates.Term(month=m) for m in range(1, 13)]
    return facets.suggest_dates(_items(spark, d), terms)


def conditional_counters(spark, d):
    return facets.counters(load(spark, d, "files"))


def histogram_buckets(spark, d):
    return facets.histogram(load(spark, d, "faces"), F.col("px"), [150, 300, 500, 800], pets=F.col("species") != "person")


def looks_emptied(spark, d):
    return facets.looks_emptied(load(spark, d, "files"))


def recognition_overview(spark, d):
    return facets.recognition_overview(load(spark, d, "files"), load(spark, d, "looked"))


def recognition_errors(spark, d):
    return facets.errors(load(spark, d, "looked"))


def pending_not_looked(spark, d):
    return facets.pending(load(spark, d, "files"), load(spark, d, "looked"), model=1, retry=True)


def ranked_pending(spark, d):
    return facets.ranked_pending(load(spark, d, "files").filter("missing_since IS NULL")).select("id", "rank")


def places_range_join(spark, d):
    return facets.places(load(spark, d, "files").filter("lat IS NOT NULL"), load(spark, d, "places"))


def places_by_cell(spark, d):
    return facets.places_by_cell(load(spark, d, "files").filter("lat IS NOT NULL"), load(spark, d, "places"))


def export_summary(spark, d):
    return facets.export_summary(load(spark, d, "files"))


def pair_counts(spark, d):
    return facets.pair_counts(load(spark, d, "files"))


def selection_tags(spark, d):
    ids = load(spark, d, "files").filter("kind = 'png'").select(F.col("id").alias("file_id"))
    return facets.own_tags_of(load(spark, d, "file_tags"), ids)


def selection_names(spark, d):
    return facets.first_names(load(spark, d, "files").filter("taken IS NULL"))


def text_all_words(spark, d):
    return text.keys_with_all(text.shown(_lines(spark, d)), ["the", "and", "th"])


def text_snippets(spark, d):
    return text.snippets(_lines(spark, d), ["erth", "haan"])


def lines_near_limit(spark, d):
    return text.near_limits(_lines(spark, d), 50).select("id", "key", "distance")


def text_index_search(spark, d):
    lines = _lines(spark, d)
    return text.ids_with(text.trigrams(lines), lines, "nther")


def text_stats(spark, d):
    lines = _lines(spark, d)
    hidden = lines.filter("id % 9 = 0").select("key", "norm").distinct()
    return text.stats(lines.select("key").distinct(), lines, hidden)


def tag_suggestions(spark, d):
    from ..operators import search

    return search.tag_hits(facets.tag_facets(load(spark, d, "files"), load(spark, d, "file_tags")), "al", 8)


def all_drives_timeline(spark, d):
    """Even and odd files as two drives. The SQL takes tags as they are written; the operator folds their names."""
    from ..operators import across

    lib = _library(spark, d)
    tags = lib.tags.filter(F.col("name").isin("en", "favourite"))
    part = lambda n: Library(lib.items.filter(F.col("id") % 3 != n), tags)
    shown = across.timeline({"a": part(0), "b": part(1)}, across.NamedQuery(Query(tags=("en",))))
    if shown is None:
        return spark.createDataFrame([], "drive string, id bigint, loved boolean, n_drives bigint")
    return shown.select("drive", "id", "loved", "n_drives")


def map_points(spark, d):
    items = timeline.effective_position(_items(spark, d), load(spark, d, "geo_overrides"))
    return items.filter("NOT is_hidden AND eff_lat IS NOT NULL AND eff_lon IS NOT NULL").select("id", "eff_lat", "eff_lon")


QUERIES = {f.__name__: f for f in (
    timeline_fallback_dates, timeline_media_types, date_term_filter, needs_a_date, month_groups, effective_values, faceted_query_and, free_text_words, favourite_query, people_query, names_query, text_query, hidden_query, hiding_folders,
    tag_facets, facets_within, date_facets, date_suggestions, conditional_counters, histogram_buckets, looks_emptied, recognition_overview, recognition_errors, pending_not_looked, ranked_pending, places_range_join, places_by_cell,
    export_summary, pair_counts, selection_tags, selection_names, text_all_words, text_snippets, lines_near_limit, text_index_search, text_stats, tag_suggestions, map_points, all_drives_timeline,
)}

#: The timeline in SQL: the same rules written out once more.
_SECS = "epoch(CAST({0}taken AS TIMESTAMP))"
_OFF = "(CASE WHEN {0}taken_offset IS NULL THEN NULL ELSE 7200 END)"
_ITEMS = f"""shown AS (SELECT *, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM files WHERE missing_since IS NULL AND kind <> 'raw'),
cand AS (SELECT c.id AS clip, s.id AS still FROM shown s JOIN shown c ON s.folder = c.folder AND s.stem = c.stem WHERE s.kind IN ('jpeg', 'heic', 'png') AND c.kind = 'video' AND c.duration_ms <= 6000 AND
  CASE WHEN s.taken IS NULL OR c.taken IS NULL THEN abs(s.mtime_ns - c.mtime_ns) <= 10000000000
  WHEN s.taken_offset IS NOT NULL AND c.taken_offset IS NOT NULL THEN abs({_SECS.format('s.')} - {_SECS.format('c.')}) <= 10
  ELSE abs({_SECS.format('s.')} - {_SECS.format('c.')}) <= 50410 AND least(abs({_SECS.format('s.')} - {_SECS.format('c.')}) % 900, 900 - abs({_SECS.format('s.')} - {_SECS.format('c.')}) % 900) <= 10 END),
mine AS (SELECT clip, min(still) AS still FROM cand GROUP BY clip), firsts AS (SELECT still, min(clip) AS clip_id FROM mine GROUP BY still),
rows AS (SELECT f.*, p.clip_id, coalesce(o.taken, f.taken) AS eff, e.year AS ey, e.month AS em, regexp_extract(f.folder, '(20[0-9][0-9]-[01][0-9]) Trip', 1) AS ev, coalesce(f.created_ns, 0) AS cr
  FROM shown f LEFT JOIN firsts p ON p.still = f.id LEFT JOIN taken_overrides o ON o.key = f.full_hash LEFT JOIN date_estimates e ON e.key = f.full_hash WHERE f.id NOT IN (SELECT clip FROM mine)),
items0 AS (SELECT *, folder || '/' || name AS path,
  CASE WHEN ey IS NOT NULL THEN printf('%04d-%02d-00T00:00:00', ey, coalesce(em, 0)) WHEN eff IS NOT NULL THEN eff WHEN ev <> '' THEN ev || '-01'
   ELSE strftime(make_timestamp(CASE WHEN cr > 0 AND (cr <= mtime_ns OR mtime_ns <= 0) THEN cr ELSE mtime_ns END // 1000), '%Y-%m-%dT%H:%M:%S') END AS sort,
  CASE WHEN ey IS NOT NULL THEN 'estimate' WHEN eff IS NOT NULL THEN 'taken' WHEN ev <> '' THEN 'folder' WHEN cr > 0 AND (cr <= mtime_ns OR mtime_ns <= 0) THEN 'created' ELSE 'modified' END AS date_source,
  CASE WHEN ey IS NOT NULL THEN CASE WHEN em IS NULL THEN 'year' ELSE 'month' END WHEN eff IS NOT NULL THEN 'day' WHEN ev <> '' THEN 'month' ELSE 'day' END AS precision FROM rows),
scored AS (SELECT *, CASE WHEN kind NOT IN ('png', 'jpeg') THEN 0 ELSE least(CASE WHEN camera IS NULL THEN 1000 ELSE 40 END, 100, CASE kind WHEN 'png' THEN 15 ELSE 5 END + CASE WHEN camera IS NULL THEN 10 ELSE 0 END + CASE WHEN width < 4000 THEN CASE WHEN camera IS NULL THEN 45 ELSE 25 END ELSE 0 END + shot_pixels // 2) END AS shot_score FROM items0),
items AS (SELECT i.*, CAST(substr(sort, 1, 4) AS INT) AS year, CASE WHEN precision <> 'year' THEN CAST(substr(sort, 6, 2) AS INT) END AS month, CASE WHEN precision = 'day' THEN CAST(substr(sort, 9, 2) AS INT) END AS day,
  CASE WHEN kind = 'video' THEN 'video' WHEN clip_id IS NOT NULL THEN 'live' WHEN coalesce(m.is_shot, shot_score >= 60) THEN 'screenshot' ELSE 'photo' END AS media_type,
  EXISTS (SELECT 1 FROM hidden_folders h WHERE i.folder = h.path OR starts_with(i.folder, h.path || '/')) AS is_hidden FROM scored i LEFT JOIN shot_marks m ON m.key = i.full_hash)"""
_POS = "pos AS (SELECT f.id, f.full_hash, coalesce(f.lat, g.lat) AS eff_lat, coalesce(f.lon, g.lon) AS eff_lon FROM files f LEFT JOIN geo_overrides g ON g.key = f.full_hash)"
_LINES = "li AS (SELECT *, lower(text) AS norm FROM text_lines)"


def _from_items(rest: str, more: str = "") -> str:
    return f"WITH {_ITEMS}{', ' + more if more else ''} {rest}"


SQL = {
    "timeline_fallback_dates": _from_items("SELECT id, path, sort, date_source, precision, year * 10000 + coalesce(month, 0) * 100 + coalesce(day, CASE WHEN precision = 'month' THEN 1 ELSE 0 END) AS day_code FROM items"),
    "timeline_media_types": _from_items("SELECT id, media_type, shot_score, is_hidden, clip_id FROM items"),
    "date_term_filter": _from_items("SELECT id, sort FROM items WHERE year = 2013 AND month = 4"),
    "needs_a_date": _from_items("SELECT id, date_source FROM items WHERE date_source IN ('folder', 'created', 'modified')"),
    "month_groups": _from_items("SELECT year * 100 + coalesce(month, 0) AS month_code, count(*) AS n FROM items GROUP BY 1"),
    "effective_values": f"WITH {_POS} SELECT f.id, coalesce(o.taken, f.taken) AS eff_taken, CASE WHEN o.key IS NOT NULL THEN o.taken_offset ELSE f.taken_offset END AS eff_offset, p.eff_lat, p.eff_lon FROM files f LEFT JOIN taken_overrides o ON o.key = f.full_hash JOIN pos p ON p.id = f.id",
    "faceted_query_and": _from_items("SELECT id FROM items WHERE NOT is_hidden AND media_type IN ('photo', 'live', 'screenshot') AND id IN (SELECT file_id FROM file_tags WHERE lower(name) = 'en') AND full_hash IN (SELECT full_hash FROM pos WHERE eff_lat BETWEEN -60 AND 70 AND eff_lon BETWEEN -170 AND 170)", _POS),
    "free_text_words": _from_items("""SELECT id FROM items i WHERE NOT is_hidden AND (contains(lower(path), 'trip') OR id IN (SELECT file_id FROM file_tags WHERE contains(lower(name), 'trip')) OR full_hash IN (SELECT full_hash FROM per WHERE contains(lower(name), 'trip')))
AND (contains(lower(path), 'fr') OR id IN (SELECT file_id FROM file_tags WHERE contains(lower(name), 'fr')) OR full_hash IN (SELECT full_hash FROM per WHERE contains(lower(name), 'fr')))""", "per AS (SELECT f.full_hash, p.name FROM faces x JOIN files f ON f.id = x.key JOIN people p ON p.id = x.label WHERE NOT p.hidden)"),
    "favourite_query": _from_items("SELECT id FROM items WHERE NOT is_hidden AND id IN (SELECT file_id FROM file_tags WHERE name = 'favourite')"),
    "people_query": _from_items("SELECT id FROM items WHERE NOT is_hidden AND full_hash IN (SELECT f.full_hash FROM faces x JOIN items f ON f.id = x.key WHERE x.label = 1) AND full_hash IN (SELECT f.full_hash FROM faces x JOIN items f ON f.id = x.key WHERE x.species <> 'person')"),
    "names_query": _from_items("SELECT id FROM items WHERE NOT is_hidden AND (folder = 'en' OR starts_with(folder, 'en/')) AND starts_with(name, 'IMG_00')"),
    "text_query": _from_items("SELECT id FROM items WHERE NOT is_hidden AND full_hash IN (SELECT f.full_hash FROM li l JOIN items f ON f.id = l.key GROUP BY f.full_hash HAVING bool_or(contains(norm, 'the')) AND bool_or(contains(norm, 'an')))", _LINES),
    "hidden_query": _from_items("SELECT id FROM items WHERE is_hidden"),
    "hiding_folders": _from_items("SELECT i.id, arg_max(h.path, length(h.path)) AS hiding_folder FROM items i JOIN hidden_folders h ON i.folder = h.path OR starts_with(i.folder, h.path || '/') GROUP BY i.id"),
    "tag_facets": "SELECT t.name, count(DISTINCT file_id) AS n, CASE WHEN bool_and(source = 'user') THEN 'own' WHEN bool_or(source = 'user') THEN 'both' ELSE 'folder' END AS tag_kind, count(DISTINCT CASE WHEN source = 'user' THEN file_id END) AS n_own, max(t.added_at) AS last_used FROM file_tags t JOIN files f ON f.id = t.file_id WHERE f.missing_since IS NULL AND f.kind <> 'raw' GROUP BY t.name",
    "facets_within": _from_items("SELECT name, count(DISTINCT file_id) AS n FROM file_tags WHERE name <> 'en' AND file_id IN (SELECT id FROM items WHERE media_type = 'photo') GROUP BY name"),
    "date_facets": _from_items("SELECT year, NULL AS month, count(*) AS n FROM items GROUP BY year UNION ALL SELECT year, month, count(*) FROM items WHERE month IS NOT NULL GROUP BY year, month"),
    "date_suggestions": _from_items("SELECT term, n FROM (SELECT year - 2008 AS term, count(*) AS n FROM items WHERE year BETWEEN 2008 AND 2025 GROUP BY 1 UNION ALL SELECT 17 + month, count(*) FROM items WHERE month IS NOT NULL GROUP BY 1) ORDER BY term LIMIT 12"),
    "conditional_counters": "SELECT count(*) FILTER (WHERE missing_since IS NULL) AS present, count(*) FILTER (WHERE missing_since IS NOT NULL) AS missing, count(*) FILTER (WHERE missing_since IS NULL AND full_hash IS NULL) AS unhashed, CAST(coalesce(sum(size) FILTER (WHERE missing_since IS NULL), 0) AS BIGINT) AS bytes FROM files",
    "histogram_buckets": "SELECT CAST((px >= 150) AS INT) + CAST((px >= 300) AS INT) + CAST((px >= 500) AS INT) + CAST((px >= 800) AS INT) AS bucket, count(*) AS n, count(*) FILTER (WHERE species <> 'person') AS pets FROM faces GROUP BY 1",
    "looks_emptied": "SELECT 2 * count(*) FILTER (WHERE missing_since IS NOT NULL) > count(*) AS emptied FROM files",
    "recognition_overview": "SELECT count(*) AS contents, count(l.key) AS looked, count(l.error) AS failed FROM (SELECT DISTINCT full_hash FROM files WHERE missing_since IS NULL) f LEFT JOIN looked l ON l.key = f.full_hash",
    "recognition_errors": "SELECT error, count(*) AS n FROM looked WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error LIMIT 5",
    "pending_not_looked": "SELECT full_hash AS key, max(coalesce(taken, '')) AS taken, min(folder || '/' || name) AS path FROM files WHERE missing_since IS NULL AND kind <> 'video' AND NOT EXISTS (SELECT 1 FROM looked l WHERE l.key = full_hash AND l.model = 1 AND l.error IS NULL) GROUP BY full_hash",
    "ranked_pending": "SELECT id, CASE WHEN kind IN ('png', 'jpeg') AND least(CASE WHEN camera IS NULL THEN 1000 ELSE 40 END, CASE kind WHEN 'png' THEN 15 ELSE 5 END + CASE WHEN camera IS NULL THEN 10 ELSE 0 END + CASE WHEN width < 4000 THEN CASE WHEN camera IS NULL THEN 45 ELSE 25 END ELSE 0 END + shot_pixels // 2) >= 60 THEN 0 WHEN camera IS NULL THEN 1 ELSE 2 END AS rank FROM files WHERE missing_since IS NULL",
    "places_range_join": "SELECT p.name AS place, count(*) AS n FROM files f JOIN places p ON f.lat BETWEEN p.south AND p.north AND f.lon BETWEEN p.west AND p.east GROUP BY p.name",
    "places_by_cell": "SELECT p.name AS place, count(*) AS n FROM files f JOIN places p ON f.lat BETWEEN p.south AND p.north AND f.lon BETWEEN p.west AND p.east GROUP BY p.name",
    "export_summary": "SELECT CASE kind WHEN 'raw' THEN 'raw' WHEN 'video' THEN 'clip' ELSE 'photo' END AS role, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1",
    "pair_counts": "WITH g AS (SELECT bool_or(kind = 'raw') AS r, bool_or(kind = 'video') AS v, bool_or(kind IN ('jpeg', 'heic', 'png')) AS p FROM files GROUP BY folder, lower(regexp_replace(name, '\\.[^.]*$', ''))) SELECT count(*) FILTER (WHERE r AND p) AS raw_pairs, count(*) FILTER (WHERE v AND p) AS clip_pairs FROM g",
    "selection_tags": "SELECT t.name, count(DISTINCT file_id) AS n FROM file_tags t WHERE source = 'user' AND file_id IN (SELECT id FROM files WHERE kind = 'png') GROUP BY t.name",
    "selection_names": "SELECT (SELECT count(*) FROM files WHERE taken IS NULL) AS n, list(name ORDER BY name) AS names FROM (SELECT name FROM files WHERE taken IS NULL ORDER BY name LIMIT 20)",
    "text_all_words": f"WITH {_LINES} SELECT key FROM li WHERE score >= 0.7 AND h >= 0.01 GROUP BY key HAVING bool_or(contains(norm, 'the')) AND bool_or(contains(norm, 'and')) AND bool_or(contains(norm, 'th'))",
    "text_snippets": f"WITH {_LINES}, r AS (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY y, x, id) AS r FROM li WHERE contains(norm, 'erth') OR contains(norm, 'haan')) SELECT key, text AS snippet FROM r WHERE r = 1",
    "lines_near_limit": "SELECT id, key, greatest(abs(score - 0.7) / 0.7, abs(h - 0.01) / 0.01) AS distance FROM text_lines ORDER BY distance, key, y, id LIMIT 50",
    "text_index_search": f"WITH {_LINES} SELECT id FROM li WHERE contains(norm, 'nther')",
    "text_stats": f"""WITH {_LINES}, hid AS (SELECT DISTINCT key, norm FROM li WHERE id % 9 = 0), s AS (SELECT * FROM li WHERE score >= 0.7 AND h >= 0.01 AND NOT EXISTS (SELECT 1 FROM hid WHERE hid.key = li.key AND hid.norm = li.norm))
SELECT 'read' AS what, count(DISTINCT key) AS n FROM li UNION ALL SELECT 'with_text', count(DISTINCT key) FROM s UNION ALL SELECT 'stored', count(*) FROM li UNION ALL SELECT 'shown', count(*) FROM s UNION ALL SELECT 'hidden', count(*) FROM hid""",
    "tag_suggestions": "SELECT t.name, count(DISTINCT file_id) AS n FROM file_tags t JOIN files f ON f.id = t.file_id WHERE f.missing_since IS NULL AND f.kind <> 'raw' AND contains(lower(t.name), 'al') GROUP BY t.name HAVING bool_or(source = 'user') ORDER BY n DESC, t.name LIMIT 8",
    "all_drives_timeline": _from_items("""SELECT drive, id, loved, n_drives FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), full_hash ORDER BY drive, path) AS r, bool_or(heart) OVER (PARTITION BY lower(name), full_hash) AS loved, count(drive) OVER (PARTITION BY lower(name), full_hash) - (count(*) OVER (PARTITION BY lower(name), full_hash) - (CASE WHEN bool_or(drive = 'a') OVER (PARTITION BY lower(name), full_hash) THEN 1 ELSE 0 END + CASE WHEN bool_or(drive = 'b') OVER (PARTITION BY lower(name), full_hash) THEN 1 ELSE 0 END)) AS n_drives FROM d) WHERE r = 1""", "d AS (SELECT 'a' AS drive, *, id IN (SELECT file_id FROM file_tags WHERE name = 'favourite') AS heart FROM items WHERE id % 3 <> 0 AND NOT is_hidden AND id IN (SELECT file_id FROM file_tags WHERE name = 'en') UNION ALL SELECT 'b', *, id IN (SELECT file_id FROM file_tags WHERE name = 'favourite') FROM items WHERE id % 3 <> 1 AND NOT is_hidden AND id IN (SELECT file_id FROM file_tags WHERE name = 'en'))"),
    "map_points": _from_items("SELECT i.id, p.eff_lat, p.eff_lon FROM items i JOIN pos p ON p.id = i.id WHERE NOT is_hidden AND p.eff_lat IS NOT NULL AND p.eff_lon IS NOT NULL", _POS),
}
