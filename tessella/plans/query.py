"""A faceted query over the timeline, compiled to one logical plan of filters and semi joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import boxes, dates, strings
from ..operators import timeline

PET_WORDS = {"cat": ("cat", "cats", "katze", "katzen"), "dog": ("dog", "dogs", "hund", "hunde"), "pet": ("pet", "pets", "haustier", "haustiere")}
FAVOURITE, FAVOURITE_WORDS = "favourite", ("favourite", "favourites", "favorite", "favorites", "favorit", "favoriten")
HIDDEN_WORDS = ("hidden", "versteckt")
TYPES = ("photo", "video", "live", "screenshot")


class BadQuery(ValueError):
    """A parameter that a query can't have."""


@dataclass(frozen=True)
class Query:
    """All parts hold at once; within types any may."""

    folder: str | None = None
    tags: tuple[str, ...] = ()
    own_tags_only: bool = False
    text: str = ""
    people: tuple[int, ...] = ()
    groups: tuple[int, ...] = ()
    types: tuple[str, ...] = ()
    pets: tuple[str, ...] = ()
    in_text: str = ""
    names: tuple[str, ...] = ()
    favourite: bool = False
    hidden: bool = False
    area: tuple[float, float, float, float] | None = None
    dates: tuple[dates.Term, ...] = ()
    needs_date: bool = False
    ids: tuple[int, ...] | None = None


def parse(pairs: Sequence[tuple[str, str]]) -> Query:
    """From repeatable parameters; repeats count once and bad values raise BadQuery."""
    many: dict[str, list[str]] = {}
    for k, v in pairs:
        if v not in many.setdefault(k, []):
            many[k].append(v)
    known = {"folder", "tag", "own", "q", "person", "group", "type", "pet", "text", "name", "fav", "hidden", "area", "date", "undated", "id"}
    if set(many) - known:
        raise BadQuery(f"unknown: {sorted(set(many) - known)}")
    try:
        terms = [dates.parse_param(x) for x in many.get("date", [])]
        area = tuple(float(x) for x in many["area"][0].split(",")) if "area" in many else None
        numbers = {k: tuple(int(x) for x in many.get(k, [])) for k in ("person", "group", "id")}
    except ValueError as e:
        raise BadQuery(str(e)) from e
    if None in terms or set(many.get("type", [])) - set(TYPES) or set(many.get("pet", [])) - {"cat", "dog", "pet"}:
        raise BadQuery("bad date, type or pet")
    if area is not None and (len(area) != 4 or not (-90 <= area[0] <= area[2] <= 90 and -180 <= area[1] <= area[3] <= 180)):
        raise BadQuery("bad area")
    return Query(
        folder=many.get("folder", [None])[0], tags=tuple(many.get("tag", [])), own_tags_only="own" in many, text=" ".join(many.get("q", [])), people=numbers["person"], groups=numbers["group"], types=tuple(many.get("type", [])),
        pets=tuple(many.get("pet", [])), in_text=" ".join(many.get("text", [])), names=tuple(many.get("name", [])), favourite="fav" in many, hidden="hidden" in many, area=area, dates=tuple(terms), needs_date="undated" in many,
        ids=numbers["id"] if "id" in many else None,
    )


@dataclass
class Library:
    """The tables that a query reads. items: timeline() with media_type() and hidden(); keyed tables may be absent."""

    items: DataFrame
    tags: DataFrame  # file_id, name, source
    person_keys: DataFrame | None = None  # person_id, name, key, hidden
    group_keys: DataFrame | None = None  # group_id, name, key
    pet_keys: DataFrame | None = None  # species, key
    text_lines: DataFrame | None = None  # key, text_norm
    positions: DataFrame | None = None  # key, lat, lon
    extra: dict = field(default_factory=dict)


def by_key(items: DataFrame, keys: DataFrame) -> DataFrame:
    return items.join(keys.select(F.col("key").alias("full_hash")), "full_hash", "left_semi")


def by_id(items: DataFrame, files: DataFrame) -> DataFrame:
    return items.join(files.select(F.col("file_id").alias("id")), "id", "left_semi")


def words_of(text: str) -> list[str]:
    return [strings.nfc_text(w).lower() for w in text.split()]


def says_hidden(words: list[str]) -> bool:
    return any(w in HIDDEN_WORDS for w in words)


def word_filter(lib: Library, items: DataFrame, word: str) -> DataFrame:
    """Items that a word hits: in the path, a tag's name, a person's name, or as a word for pets, favourites or hidden items."""
    lower = F.lower("name")
    hits = [items.filter(F.lower("path").contains(word)).select("id"), lib.tags.filter(lower.contains(word)).select(F.col("file_id").alias("id"))]
    keyed = []
    if lib.person_keys is not None:
        keyed.append(lib.person_keys.filter(lower.contains(word) & ~F.col("hidden")).select("key"))
    if lib.pet_keys is not None and len(word) >= 3:
        species = [s for s, names in PET_WORDS.items() if any(n.startswith(word) for n in names)]
        if species:
            keyed.append(lib.pet_keys.filter(F.lit("pet" in species) | F.col("species").isin(species)).select("key"))
    if len(word) >= 3 and any(n.startswith(word) for n in FAVOURITE_WORDS):
        hits.append(lib.tags.filter(lower == FAVOURITE).select(F.col("file_id").alias("id")))
    if word in HIDDEN_WORDS:
        hits.append(items.filter("is_hidden").select("id"))
    for k in keyed:
        hits.append(by_key(items, k).select("id"))
    union = hits[0]
    for h in hits[1:]:
        union = union.unionByName(h)
    return items.join(union, "id", "left_semi")


def compile_query(lib: Library, q: Query) -> DataFrame:
    """The items that a query shows. Catalyst orders the filters; each side set becomes a semi join."""
    items, words = lib.items, words_of(q.text)
    if q.hidden:
        items = items.filter("is_hidden")
    elif not says_hidden(words):
        below = (F.col("folder") == q.folder) | F.col("folder").startswith((q.folder or "") + "/") if q.folder else F.lit(False)
        flagged = lib.extra.get("hidden_folders")
        chosen = q.folder is not None and flagged is not None and bool(flagged.filter(F.col("path") == q.folder).limit(1).count())
        items = items.filter(~F.col("is_hidden") | below) if chosen else items.filter(~F.col("is_hidden"))
    if q.folder is not None:
        items = items.filter((F.col("folder") == q.folder) | F.col("folder").startswith(q.folder + "/"))
    if q.types:
        items = items.filter(F.col("media_type").isin(*q.types))
    for part in q.names:
        items = items.filter(strings.plain_fold(F.col("name")).contains(strings.search_fold_text(part)))
    if q.dates:
        dated = timeline.parts(items)
        for t in q.dates:
            dated = dated.filter(t.matches(F.col("year"), F.col("month"), F.col("day")))
        items = dated.select(items.columns)
    if q.needs_date:
        items = timeline.needs_a_date(items)
    if q.ids is not None:
        rows = lib.items.sparkSession.createDataFrame([(i,) for i in q.ids], "id bigint")
        items = items.join(rows, "id", "left_semi")
    for t in q.tags:
        mine = lib.tags.filter(F.lower(F.trim("name")) == t.strip().lower())
        items = by_id(items, mine.filter("source = 'user'") if q.own_tags_only else mine)
    if q.favourite:
        items = by_id(items, lib.tags.filter(F.lower("name") == FAVOURITE))
    for p in q.people:
        items = by_key(items, lib.person_keys.filter(F.col("person_id") == p))
    for g in q.groups:
        items = by_key(items, lib.group_keys.filter(F.col("group_id") == g))
    for s in q.pets:
        items = by_key(items, lib.pet_keys if s == "pet" else lib.pet_keys.filter(F.col("species") == s))
    if q.in_text.strip() and lib.text_lines is not None:
        from ..operators.text import keys_with_all

        items = by_key(items, keys_with_all(lib.text_lines, strings.search_fold_text(q.in_text).split()))
    if q.area is not None:
        south, west, north, east = q.area
        items = by_key(items, lib.positions.filter(boxes.in_area(F.col("lat"), F.col("lon"), south, west, north, east)))
    for w in words:
        items = word_filter(lib, items, w)
    return items


def count(lib: Library, q: Query) -> int:
    return compile_query(lib, q).count()

