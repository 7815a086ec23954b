"""Suggestions for a search box; each count is what its filter would then show."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, strings
from ..plans.query import PET_WORDS, Library, Query, compile_query
from . import facets

TAGS, PEOPLE, GROUPS, DATES = 8, 6, 4, 12


def route(typed: str) -> tuple[str, str]:
    """The section that a prefix asks for, and the rest: date: (or datum:), text:, name:, else all."""
    head, sep, rest = typed.strip().partition(":")
    section = {"date": "date", "datum": "date", "text": "text", "name": "name"}.get(head.strip().lower()) if sep else None
    return (section, rest.strip()) if section else ("all", typed.strip())


def tag_hits(counted: DataFrame, part: str, limit: int = TAGS) -> DataFrame:
    """Tags of the user's own (or both) whose fold holds the part: most files first, then by name."""
    return counted.filter((F.col("tag_kind") != "folder") & F.lower("name").contains(strings.nfc_text(part).lower())).select("name", "n").orderBy(F.desc("n"), "name").limit(limit)


def keyed_hits(items: DataFrame, keyed: DataFrame, name: str, limit: int) -> DataFrame:
    """(name, n) of people, groups or species by the items that show one of their contents."""
    got = items.select("id", F.col("full_hash").alias("key")).join(keyed.select("key", name).distinct(), "key")
    return got.groupBy(name).agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), name).limit(limit)


def person_hits(lib: Library, items: DataFrame, part: str, chosen: tuple[int, ...] = (), limit: int = PEOPLE) -> DataFrame:
    rows = lib.person_keys.filter(~F.col("hidden") & F.lower("name").contains(part.lower()) & ~F.col("person_id").isin(*chosen)) if chosen else lib.person_keys.filter(~F.col("hidden") & F.lower("name").contains(part.lower()))
    return keyed_hits(items, rows, "name", limit)


def group_hits(lib: Library, items: DataFrame, part: str, limit: int = GROUPS) -> DataFrame:
    return keyed_hits(items, lib.group_keys.filter(F.lower("name").contains(part.lower())), "name", limit)


def pet_hits(lib: Library, items: DataFrame, part: str) -> DataFrame:
    """Species by their names in English and German."""
    species = [s for s, names in PET_WORDS.items() if len(part) >= 3 and any(n.startswith(part.lower()) for n in names)]
    rows = lib.pet_keys if "pet" in species else lib.pet_keys.filter(F.col("species").isin(*species) if species else F.lit(False))
    return keyed_hits(items, rows, "species", 2)


def suggest(lib: Library, query: Query, typed: str, counted: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections for what is typed, each a DataFrame of its own; the shown items are compiled once."""
    section, part = route(typed)
    items = compile_query(lib, query)
    out: dict[str, DataFrame] = {}
    if section in ("all", "date"):
        terms = dates.parse_typed(part)
        if terms:
            out["dates"] = facets.suggest_dates(items, terms, DATES)
    if section in ("all", "text") and lib.text_lines is not None and part:
        out["text"] = compile_query(lib, replace(query, in_text=part)).agg(F.count(F.lit(1)).alias("n"))
    if section in ("all", "name") and part:
        out["names"] = compile_query(lib, replace(query, names=(*query.names, part))).agg(F.count(F.lit(1)).alias("n"))
    if section == "all" and part:
        within = facets.facets_within(items, lib.tags.filter("source = 'user'"), list(query.tags)).withColumn("tag_kind", F.lit("own"))
        out["tags"] = tag_hits(counted if counted is not None else within, part)
        if lib.person_keys is not None:
            out["people"] = person_hits(lib, items, part, query.people)
        if lib.group_keys is not None:
            out["groups"] = group_hits(lib, items, part)
        if lib.pet_keys is not None:
            out["pets"] = pet_hits(lib, items, part)
    return out
