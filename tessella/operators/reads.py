"""What a catalogue's pages ask for: the timeline's page, all about one file, a person's faces, keys by person and species, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import strings
from . import timeline

#: A letter for each kind, and for each way that a date without a capture time was found.
KIND_LETTERS = {"jpeg": "j", "png": "p", "heic": "h", "video": "v", "raw": "r"}
SOURCE_LETTERS = {"estimate": "e", "folder": "f", "created": "c", "modified": "m"}
#: Bounds of cluster sizes, with the names of the sizes up to each.
SIZES = ((1, "one"), (2, "two"), (5, "three_to_five"), (20, "six_to_twenty"))
MOST_ROWS = 2000


def _letter(c: Column, letters: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])[c]


def timeline_rows(items: DataFrame, hearts: DataFrame, hidden_folders: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The timeline's items as a page shows them, in its order: id, kind_letter, day_code, version, clip_id, heart, is_hidden, source_letter.
    items: timeline.timeline(); hearts(id): the favourites."""
    rows = timeline.hidden(timeline.parts(items), hidden_folders).join(hearts.select("id").distinct().withColumn("heart", F.lit(True)), "id", "left")
    rows = timeline.in_order(rows)
    if limit is not None:
        rows = rows.offset(offset).limit(limit)
    return rows.select(
        "id", _letter(F.col("kind"), KIND_LETTERS).alias("kind_letter"), "day_code", F.rpad(strings.version_token(F.col("full_hash"), F.lit(0)), 8, "0").alias("version"),
        "clip_id", F.coalesce("heart", F.lit(False)).alias("heart"), "is_hidden", _letter(F.col("date_source"), SOURCE_LETTERS).alias("source_letter"),
    )


def file_details(items: DataFrame, file_id: int, tags: DataFrame, marks: DataFrame, positions: DataFrame, hidden_folders: DataFrame, lines: DataFrame, faces: DataFrame, versions: DataFrame) -> DataFrame:
    """One item with all that is known of it: tags (folders' first), is_shot, eff_lat and eff_lon, hiding_folder, its text's lines in reading
    order, its faces (largest first) with their states, and the files linked with it.

    lines(key, y, x, text), faces(key, id, px, state, person_id), versions(id, other); keys are contents.
    """
    one = timeline.effective_position(timeline.details(items, tags, file_id), positions)
    one = one.join(timeline.hiding_folder(one, hidden_folders), "id", "left").join(marks.select(F.col("key").alias("full_hash"), "is_shot"), "full_hash", "left")
    key = one.select("full_hash")
    mine = lambda rows: rows.withColumnRenamed("key", "full_hash").join(F.broadcast(key), "full_hash")  # noqa: E731  one row
    text = mine(lines).groupBy("full_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda t: t["text"]).alias("lines"))  # one content's lines
    own = F.struct((-F.col("px")).alias("p"), "id", "state", "person_id")
    boxes = mine(faces).groupBy("full_hash").agg(F.transform(F.array_sort(F.collect_list(own)), lambda f: F.struct(f["id"].alias("id"), f["state"].alias("state"), f["person_id"].alias("person_id"))).alias("faces"))  # one content's faces
    linked = versions.filter(F.col("id") == file_id).groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("versions"))
    return one.join(text, "full_hash", "left").join(boxes, "full_hash", "left").join(linked, "id", "left")


def compare_ids(files: DataFrame, pairs: DataFrame, here: str) -> DataFrame:
    """Ids on a drive of files whose content the other drive of its first pair lacks. pairs(main, backup): as they were told."""
    from . import drives

    told = pairs.filter((F.col("main") == here) | (F.col("backup") == here)).orderBy("main", "backup").first()
    if told is None:
        return drives.present(files).limit(0).select("id")
    return drives.only_here(files, here, told["backup"] if told["main"] == here else told["main"]).select("id")


def person_faces(faces: DataFrame, verdict: DataFrame, suggested: DataFrame, person: int, which: str, suggest: float, limit: int = 300, offset: int = 0) -> DataFrame:
    """A page of a person's faces: confirmed by width, suggested and maybe by similarity, or rejected ones. suggested: people.suggestion()."""
    v = verdict.select(F.col("face_id").alias("id"), "decision", F.col("person_id").alias("decided"), "rejected")
    rows = faces.join(v, "id", "left").join(suggested.select("id", F.col("person_id").alias("told"), "sim"), "id", "left")
    mine = {
        "confirmed": (F.col("decision") == "confirmed") & (F.col("decided") == person),
        "suggested": (F.col("told") == person) & (F.col("sim") >= suggest),
        "maybe": (F.col("told") == person) & (F.col("sim") < suggest),
        "rejected": F.array_contains("rejected", F.lit(person)),
    }[which]
    order = F.desc("px") if which == "confirmed" else F.desc(F.coalesce("sim", F.lit(0.0)))
    return rows.filter(mine).orderBy(order, "id").offset(offset).limit(min(limit, MOST_ROWS)).select("id", "key", "px", "sim")


def keys_by_person(decisions: DataFrame) -> DataFrame:
    """(person_id, key): the contents that each person is confirmed on."""
    return decisions.filter("decision = 'confirmed' AND person_id IS NOT NULL").select("person_id", "key").distinct()


def keys_of_people(decisions: DataFrame, people: list[int]) -> DataFrame:
    return keys_by_person(decisions).filter(F.col("person_id").isin(*people)).select("key").distinct()


def keys_of_pets(faces: DataFrame, verdict: DataFrame, drawn: DataFrame, majority: DataFrame) -> DataFrame:
    """(species, key): contents with a pet of each species, and of any as `pet`. Detected pets but those that are told to be none, and
    drawn ones (key, species, person_id); a pet with a name is of its person's majority."""
    v = verdict.select(F.col("face_id").alias("id"), "decision", "person_id")
    found = faces.filter("species <> 'person'").select("id", "key", "species").join(v, "id", "left").filter("decision IS NULL OR decision <> 'not_face'")
    found = found.select("key", "species", F.when(F.col("decision") == "confirmed", F.col("person_id")).alias("person_id"))
    rows = found.unionByName(drawn.select("key", "species", "person_id")).join(majority.filter("species IN ('cat', 'dog')").select("person_id", F.col("species").alias("m")), "person_id", "left")
    return rows.select("key", F.explode(F.array(F.coalesce("m", "species"), F.lit("pet"))).alias("species")).distinct().select("species", "key")


def members_of_group(people: DataFrame, group: int) -> DataFrame:
    return people.filter(F.col("group_id") == group).select("id")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(size, n): how many clusters have one, two, three to five, six to twenty members, or more."""
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    size = F.lit("more")
    for most, name in reversed(SIZES):
        size = F.when(F.col("members") <= most, name).otherwise(size)
    return n.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


def cluster_overview(clusters: DataFrame, people: DataFrame, suggest: dict[str, float]) -> DataFrame:
    """One row: clusters, faces in them, those as similar to someone as their space asks, and people. clusters(cluster, species, sim)."""
    least = F.when(F.col("species") == "person", suggest["faces"]).otherwise(suggest["pets"])
    own = clusters.agg(F.countDistinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("unnamed"), F.count_if(F.col("sim") >= least).alias("suggested"))
    return own.withColumn("people", F.lit(people.count()))


def recognition_stats(looked: DataFrame, faces: DataFrame, verdict: DataFrame, matched: DataFrame, decisions: DataFrame, min_px: int) -> DataFrame:
    """One row: contents looked at, failed and with a face; faces, small ones, those told to be none; decisions whose box no face overlaps."""
    l = looked.agg(F.count(F.lit(1)).alias("looked"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    f = faces.agg(F.countDistinct("key").alias("with_faces"), F.count(F.lit(1)).alias("faces"), F.count_if(F.col("px") < min_px).alias("small"))
    v = verdict.agg(F.count_if(F.col("decision") == "not_face").alias("not_face"), F.count_if(F.col("decision") == "confirmed").alias("confirmed"))
    u = decisions.join(matched.select(F.col("decision_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    return l.crossJoin(f).crossJoin(v).crossJoin(u)  # one row each


def overview(looked: DataFrame, faces: DataFrame, lines: DataFrame) -> DataFrame:
    """(part, photos, finds, model) for faces, pets and text: contents with finds, finds, and the model looked with last."""
    model = looked.filter("error IS NULL").agg(F.max_by("model", F.struct("done_at", "key")).alias("model"))
    part = F.when(F.col("species") == "person", "faces").otherwise("pets")
    found = faces.select(part.alias("part"), F.col("key").cast("string").alias("key")).unionByName(lines.select(F.lit("text").alias("part"), F.col("key").cast("string").alias("key")))
    return found.groupBy("part").agg(F.countDistinct("key").alias("photos"), F.count(F.lit(1)).alias("finds")).crossJoin(F.broadcast(model))  # one row


def unused_crops(crops: DataFrame, faces: DataFrame, verdict: DataFrame, covers: DataFrame) -> DataFrame:
    """Stored crops (key, x, y, w, h) that neither an undecided face nor a cover needs: what may be deleted."""
    decided = verdict.filter("decision IS NOT NULL").select(F.col("face_id").alias("id"))
    box = ["key", "x", "y", "w", "h"]
    kept = faces.join(decided, "id", "left_anti").select(*box).unionByName(faces.join(covers.select(F.col("cover").alias("id")), "id", "left_semi").select(*box))
    return crops.join(kept, box, "left_anti")


def drawn_pending(decisions: DataFrame, drawn: DataFrame, present: DataFrame, model: str | None = None) -> DataFrame:
    """Boxes drawn by hand on present contents that have no embedding of the model (of any, if none is told). drawn(key, x, y, w, h, model)."""
    box = ["key", "x", "y", "w", "h"]
    done = drawn if model is None else drawn.filter(F.col("model") == model)
    return decisions.filter("manual").join(present.select("key").distinct(), "key", "left_semi").join(done.select(*box), box, "left_anti")


def suggest_everywhere(files: DataFrame, tags: DataFrame, people: DataFrame, term: str, eligible: DataFrame, limit: int = 8) -> DataFrame:
    """(section, name, photos): tags, people and folders of the eligible drives whose name has a word that begins with the term; most photos first.
    people(drive, name, photos)."""
    from . import drives

    on = lambda rows: rows.join(F.broadcast(eligible.select("drive").distinct()), "drive", "left_semi")  # noqa: E731  a row a drive
    fold = strings.search_fold_text(term)
    sections = (
        ("tag", drives.tag_hits(on(files), on(tags)).select(F.col("tag").alias("name"), "photos")),
        ("person", on(people).groupBy(F.lower("name").alias("name")).agg(F.sum("photos").alias("photos"))),
        ("folder", drives.folder_names(on(files)).select(F.col("folder_name").alias("name"), "photos")),
    )
    out = None
    for section, rows in sections:
        hit = F.concat(F.lit(" "), strings.plain_fold(F.col("name"))).contains(" " + fold)
        best = rows.filter(hit).orderBy(F.desc("photos"), "name").limit(limit).select(F.lit(section).alias("section"), "name", "photos")
        out = best if out is None else out.unionByName(best)
    return out
