"""Decisions about boxes in pictures, laid over what was detected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import boxes
from ..tables import delete, upsert

LEAST_IOU, IN_PET, IN_BODY = 0.5, 0.7, 0.5


def boxed(df: DataFrame) -> DataFrame:
    """df(x, y, w, h, ...) with a box column."""
    return df.withColumn("box", boxes.box(*(F.col(c) for c in "xywh")))


def match(faces: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, face_id, iou): each decision's face of the same content with the largest overlap of LEAST_IOU or more; of equal ones the
    highest id. A picture has few boxes, so the join on its key is small."""
    f = boxed(faces).select("key", F.col("id").alias("face_id"), F.col("box").alias("fbox"))
    d = boxed(decisions).select("key", F.col("id").alias("decision_id"), F.col("box").alias("dbox"))
    both = d.join(f, "key").withColumn("iou", boxes.iou(F.col("dbox"), F.col("fbox"))).filter(F.col("iou") >= LEAST_IOU)
    return both.groupBy("decision_id").agg(F.max(F.struct("iou", "face_id")).alias("m")).select("decision_id", "m.face_id", "m.iou")


def verdicts(decisions: DataFrame, matched: DataFrame) -> DataFrame:
    """(face_id, decision, person_id, rejected): the latest decision but for rejections, and the people rejected."""
    rows = decisions.join(matched.select(F.col("decision_id").alias("id"), "face_id"), "id")
    stays = F.col("decision") != "rejected"
    return rows.groupBy("face_id").agg(
        F.max(F.when(stays, F.struct("at", "id", "decision", "person_id"))).alias("v"), F.sort_array(F.collect_set(F.when(~stays, F.col("person_id")))).alias("rejected")
    ).select("face_id", "v.decision", "v.person_id", "rejected")


def pet_faces(faces: DataFrame, pets: DataFrame, bodies: DataFrame) -> DataFrame:
    """Faces that lie in a pet's box (IN_PET of them or more) and in no person's (IN_BODY or more). All (id, key, x, y, w, h)."""
    f = boxed(faces).select("id", "key", "box")
    inside = lambda other, least: f.join(boxed(other).select("key", F.col("box").alias("o")), "key").filter(boxes.share_inside(F.col("box"), F.col("o")) >= least).select("id").distinct()
    return inside(pets, IN_PET).join(inside(bodies, IN_BODY), "id", "left_anti")


def suggestion(found: DataFrame, verdict: DataFrame, people: DataFrame, pet: DataFrame, maybe: float) -> DataFrame:
    """Cached suggestions (id, person_id, sim) that still hold: undecided, no pet's face, similar enough, of a person that exists and was not rejected."""
    rows = found.filter(F.col("sim") >= maybe).join(people.select(F.col("id").alias("person_id")), "person_id", "left_semi").join(pet, "id", "left_anti")
    v = verdict.select(F.col("face_id").alias("id"), "decision", "rejected")
    return rows.join(v, "id", "left").filter(F.col("decision").isNull() & ~F.coalesce(F.array_contains("rejected", F.col("person_id")), F.lit(False))).select("id", "person_id", "sim")


def states(faces: DataFrame, verdict: DataFrame, suggested: DataFrame, suggest: float) -> DataFrame:
    """(id, state, person_id): the verdict, else suggested or maybe, else none."""
    v = verdict.select(F.col("face_id").alias("id"), "decision", F.col("person_id").alias("v_person"))
    s = suggested.select("id", F.col("person_id").alias("s_person"), "sim")
    state = F.coalesce("decision", F.when(F.col("sim") >= suggest, "suggested").when(F.col("sim").isNotNull(), "maybe"))
    return faces.select("id").join(v, "id", "left").join(s, "id", "left").select("id", state.alias("state"), F.when(F.col("decision").isNotNull(), F.col("v_person")).otherwise(F.col("s_person")).alias("person_id"))


def unplaced(faces: DataFrame, verdict: DataFrame, suggested: DataFrame, pet: DataFrame) -> DataFrame:
    decided = verdict.filter("decision IS NOT NULL").select(F.col("face_id").alias("id"))
    return faces.select("id").join(decided, "id", "left_anti").join(suggested.select("id"), "id", "left_anti").join(pet, "id", "left_anti")


def person_counts(faces: DataFrame, verdict: DataFrame) -> DataFrame:
    """(person_id, faces, photos, largest): confirmed faces, their contents, and the largest face (of equal ones the lowest id)."""
    mine = verdict.filter("decision = 'confirmed'").select(F.col("face_id").alias("id"), "person_id")
    return mine.join(faces.select("id", "key", "px"), "id").groupBy("person_id").agg(F.count(F.lit(1)).alias("faces"), F.countDistinct("key").alias("photos"), F.max_by("id", F.struct("px", -F.col("id"))).alias("largest"))


def species_majority(rows: DataFrame) -> DataFrame:
    """(person_id, species) from rows(person_id, species): person unless pets outnumber people; ties go to cat, then dog, then pet."""
    c = {s: F.count_if(F.col("species") == s).alias(s) for s in ("person", "cat", "dog", "pet")}
    g = rows.groupBy("person_id").agg(*c.values())
    pets = F.col("cat") + F.col("dog") + F.col("pet")
    return g.select("person_id", F.when(pets <= F.col("person"), "person").when((F.col("cat") >= F.col("dog")) & (F.col("cat") >= F.col("pet")), "cat").when(F.col("dog") >= F.col("pet"), "dog").otherwise("pet").alias("species"))


def effective_species(detected: DataFrame, majority: DataFrame) -> DataFrame:
    """detected(id, species, person_id): the person's majority, where it is cat or dog, overrides the detector."""
    m = majority.filter("species IN ('cat', 'dog')").select("person_id", F.col("species").alias("m"))
    return detected.join(m, "person_id", "left").withColumn("species", F.coalesce("m", "species")).drop("m")


def cluster_cards(clusters: DataFrame, faces: DataFrame, verdict: DataFrame, suggested: DataFrame) -> DataFrame:
    """(cluster, n, small, first_face, suggested_person) of undecided faces: by size, then number; most votes for a person win, ties the lowest id."""
    decided = verdict.filter("decision IS NOT NULL").select(F.col("face_id").alias("id"))
    rows = clusters.join(decided, "id", "left_anti").join(faces.select("id", "px"), "id")
    votes = rows.join(suggested.select("id", "person_id"), "id").groupBy("cluster", "person_id").agg(F.count(F.lit(1)).alias("v")).groupBy("cluster").agg(F.max_by("person_id", F.struct("v", -F.col("person_id"))).alias("suggested_person"))
    cards = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) <= 2).alias("small"), F.max_by("id", F.struct("px", -F.col("id"))).alias("first_face"))
    return cards.join(votes, "cluster", "left")


def people_list(people: DataFrame, groups: DataFrame) -> DataFrame:
    """People by their group's position (those without a group last), name in lower case, id."""
    g = groups.select(F.col("id").alias("group_id"), "position")
    return people.join(g, "group_id", "left").orderBy(F.col("position").asc_nulls_last(), F.lower("name"), "id")


def covers(people: DataFrame, faces: DataFrame, verdict: DataFrame) -> DataFrame:
    """(person_id, cover): the chosen cover if it is still one of the person's faces, else the largest."""
    counted = person_counts(faces, verdict)
    mine = verdict.filter("decision = 'confirmed'").select(F.col("face_id").alias("cover"), "person_id", F.lit(True).alias("__ok"))
    return people.select(F.col("id").alias("person_id"), "cover").join(mine, ["person_id", "cover"], "left").join(counted.select("person_id", "largest"), "person_id", "left").select("person_id", F.when(F.col("__ok"), F.col("cover")).otherwise(F.col("largest")).alias("cover"))


def face_list(faces: DataFrame, verdict: DataFrame, least_px: int = 0, most_px: int | None = None, unmatched: bool = False, sort: str = "size", limit: int = 300, offset: int = 0) -> DataFrame:
    rows = faces.filter(F.col("px") >= least_px)
    if most_px is not None:
        rows = rows.filter(F.col("px") < most_px)
    if unmatched:
        rows = rows.join(verdict.filter("decision IS NOT NULL").select(F.col("face_id").alias("id")), "id", "left_anti")
    order = [F.desc("px")] if sort == "size" else [F.desc("score")]
    return rows.orderBy(*order, "id").offset(offset).limit(min(limit, 2000))


def decide(decisions: DataFrame, target: DataFrame, action: str, person: int | None, at: int) -> DataFrame:
    """face_decisions after an action on target faces (key, x, y, w, h, decision_ids of those matched to each).

    confirm, assign, ignore and not_face replace what stood but rejections of other people; reject adds a rejection and takes back a
    confirmation of that person; undo takes back all but rejections; unreject takes back one rejection.
    """
    mine = target.select(F.explode("decision_ids").alias("id")).join(decisions, "id")
    own = F.col("person_id") == F.lit(person)
    gone = {
        "confirm": mine.filter((F.col("decision") != "rejected") | own),
        "assign": mine.filter((F.col("decision") != "rejected") | own),
        "ignore": mine.filter(F.col("decision") != "rejected"),
        "not_face": mine,
        "reject": mine.filter(own),
        "undo": mine.filter(F.col("decision") != "rejected"),
        "unreject": mine.filter((F.col("decision") == "rejected") & own),
    }[action]
    left = delete(decisions, gone, ["id"])
    made = {"confirm": "confirmed", "assign": "confirmed", "ignore": "ignored", "not_face": "not_face", "reject": "rejected"}.get(action)
    if made is None:
        return left
    top = decisions.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = target.withColumn("id", F.monotonically_increasing_id() + top + 1).withColumn("decision", F.lit(made)).withColumn("person_id", F.lit(person if made in ("confirmed", "rejected") else None).cast("bigint")).withColumn("at", F.lit(at).cast("bigint"))
    for c, kind in decisions.dtypes:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    return left.unionByName(rows.select(decisions.columns))


def merge(decisions: DataFrame, source: int, into: int) -> DataFrame:
    """Decisions after one person is merged into another: a confirmation beats a rejection of the same box, and a rejection is kept once."""
    moved = decisions.withColumn("person_id", F.when(F.col("person_id") == source, into).otherwise(F.col("person_id")))
    w = Window.partitionBy("key", "x", "y", "w", "h", "person_id").orderBy((F.col("decision") == "rejected").cast("int"), F.desc("at"), F.desc("id"))
    ranked = moved.withColumn("__r", F.row_number().over(w))
    return ranked.filter((F.col("__r") == 1) | ((F.col("decision") != "rejected") & (F.col("person_id") != into))).drop("__r")


def follow_content(rows: DataFrame, old_key, new_key, quarters: int) -> DataFrame:
    """Rows of a content that was turned, under its new key with their boxes turned too; the others as they are."""
    b = boxes.turn(boxes.box(*(F.col(c) for c in "xywh")), F.lit(quarters))
    mine = F.col("key") == old_key
    out = rows.withColumn("__b", b).withColumn("__m", mine)
    for c in "xywh":
        out = out.withColumn(c, F.when(F.col("__m"), F.col(f"__b.{c}")).otherwise(F.col(c)))
    return out.withColumn("key", F.when(F.col("__m"), F.lit(new_key)).otherwise(F.col("key"))).drop("__b", "__m")


def forget(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given contents."""
    return {n: d.join(keys, "key", "left_anti") for n, d in tables.items()}


def set_species(marks: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(marks, new, ["key", "x", "y", "w", "h"])
