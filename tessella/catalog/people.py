"""Queries over faces, decisions and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import load
from ..operators import people, vectors
from ..tables import cut

#: The test vectors are hardly alike; these thresholds select some where the real ones would select none.
MAYBE, CLUSTER, COHESION = 0.30, 0.30, 0.20


def _faces(spark, d):
    return load(spark, d, "faces")


def _verdicts(spark, d):
    decisions = load(spark, d, "decisions")
    return people.verdicts(decisions, people.match(_faces(spark, d), decisions))


def best_iou_decision(spark, d):
    return people.match(_faces(spark, d), load(spark, d, "decisions"))


def current_verdicts(spark, d):
    return _verdicts(spark, d).select("face_id", "decision", "person_id", F.array_join(F.col("rejected").cast("array<string>"), ",").alias("rejected"))


def pet_face_containment(spark, d):
    faces = _faces(spark, d)
    pets = faces.filter("species <> 'person'").select("key", "x", "y", (F.col("w") * 1.4).alias("w"), (F.col("h") * 1.4).alias("h"))
    bodies = faces.filter("species = 'person' AND id % 4 = 0").select("key", "x", "y", "w", "h")
    return people.pet_faces(faces, pets, bodies)


def person_counts(spark, d):
    return people.person_counts(_faces(spark, d), _verdicts(spark, d))


def species_majority(spark, d):
    return people.species_majority(_faces(spark, d).select(F.col("label").alias("person_id"), F.when(F.col("id") % 2 == 0, "cat").otherwise(F.col("species")).alias("species")))


def people_list(spark, d):
    groups = spark.createDataFrame([(1, 2), (2, 1)], "id bigint, position int")
    return people.people_list(load(spark, d, "people"), groups).select("id", "name", "position")


def face_list(spark, d):
    return people.face_list(_faces(spark, d), _verdicts(spark, d), least_px=300, unmatched=True).select("id", "px")


def merged_decisions(spark, d):
    return people.merge(load(spark, d, "decisions"), 3, 4).groupBy("person_id", "decision").agg(F.count(F.lit(1)).alias("n"))


def cosine_topk(spark, d):
    base = _faces(spark, d).select("id", "embedding")
    return vectors.top_k(base, base, 5, MAYBE).select("query_id", "rank", "id")


def similar_to_one(spark, d):
    base = _faces(spark, d).select("id", "embedding")
    one = base.filter("id = 0").first()["embedding"]
    return vectors.similar_to(base.filter("id <> 0"), one, 24).select("id", "sim")


def suggested_person(spark, d):
    faces = _faces(spark, d)
    refs = faces.filter("id % 3 = 0").select("id", "embedding", F.col("label").alias("person_id"))
    rejected = faces.filter("id % 3 <> 0").select("id", (F.col("id") % 10).cast("int").alias("person_id"))
    return vectors.suggestions(faces.filter("id % 3 <> 0").select("id", "embedding"), refs, rejected, MAYBE).select("id", "person_id", F.round("sim", 6).alias("sim"))


def constrained_clusters(spark, d):
    faces = _faces(spark, d)
    edges = cut(vectors.neighbour_edges(vectors.top_k(faces.select("id", "embedding"), faces.select("id", "embedding"), 24, CLUSTER)))
    labels = faces.filter("id % 5 = 0").select("id", F.col("label").alias("person_id"))
    return vectors.clusters(faces, edges, labels, CLUSTER, COHESION)


def rotated_suppression(spark, d):
    faces = _faces(spark, d)
    return vectors.suppress(faces.select("id", "key", "score", *[F.col(c).cast("double").alias(c) for c in "xywh"]))


def eligible_vectors(spark, d):
    present = load(spark, d, "files").filter("missing_since IS NULL").select(F.col("id").alias("key"))
    return vectors.eligible(_faces(spark, d), present, 300, ["cat", "dog"]).select("id")


def current_model(spark, d):
    return vectors.current_model(load(spark, d, "looked"))


QUERIES = {f.__name__: f for f in (best_iou_decision, current_verdicts, pet_face_containment, person_counts, species_majority, people_list, face_list, merged_decisions, cosine_topk, similar_to_one, suggested_person, constrained_clusters, rotated_suppression, eligible_vectors, current_model)}


def _inter(a: str, b: str) -> str:
    w = f"greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0)"
    h = f"greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0)"
    return f"({w} * {h})"


_MATCH = f"""b AS (SELECT d.id AS decision_id, f.id AS face_id, {_inter('d', 'f')} / (d.w * d.h + f.w * f.h - {_inter('d', 'f')}) AS iou FROM decisions d JOIN faces f ON f.key = d.key),
m AS (SELECT decision_id, face_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY iou DESC, face_id DESC) AS r FROM b WHERE iou >= 0.5) WHERE r = 1)"""
_VERDICT = f"""{_MATCH}, dm AS (SELECT d.*, m.face_id FROM decisions d JOIN m ON m.decision_id = d.id),
v AS (SELECT face_id, arg_max(decision, dm.at * 1000000 + dm.id) FILTER (WHERE decision <> 'rejected') AS decision, arg_max(person_id, dm.at * 1000000 + dm.id) FILTER (WHERE decision <> 'rejected') AS person_id FROM dm GROUP BY face_id)"""
_DOT = "list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[]))"
SQL = {
    "best_iou_decision": f"WITH {_MATCH} SELECT * FROM m",
    "current_verdicts": f"WITH {_VERDICT} SELECT v.*, coalesce((SELECT string_agg(DISTINCT person_id, ',' ORDER BY person_id) FROM dm WHERE dm.face_id = v.face_id AND decision = 'rejected'), '') AS rejected FROM v",
    "pet_face_containment": f"""WITH p AS (SELECT key, x, y, w * 1.4 AS w, h * 1.4 AS h FROM faces WHERE species <> 'person'), bo AS (SELECT key, x, y, w, h FROM faces WHERE species = 'person' AND id % 4 = 0)
SELECT id FROM faces f WHERE EXISTS (SELECT 1 FROM p WHERE p.key = f.key AND {_inter('f', 'p')} / (f.w * f.h) >= 0.7) AND NOT EXISTS (SELECT 1 FROM bo WHERE bo.key = f.key AND {_inter('f', 'bo')} / (f.w * f.h) >= 0.5)""",
    "person_counts": f"WITH {_VERDICT} SELECT v.person_id, count(*) AS faces, count(DISTINCT f.key) AS photos, arg_max(f.id, f.px * 1000000 - f.id) AS largest FROM v JOIN faces f ON f.id = v.face_id WHERE v.decision = 'confirmed' GROUP BY v.person_id",
    "species_majority": """WITH g AS (SELECT label AS person_id, count(*) FILTER (WHERE s = 'person') AS p, count(*) FILTER (WHERE s = 'cat') AS c, count(*) FILTER (WHERE s = 'dog') AS d FROM (SELECT label, CASE WHEN id % 2 = 0 THEN 'cat' ELSE species END AS s FROM faces) GROUP BY label)
SELECT person_id, CASE WHEN c + d <= p THEN 'person' WHEN c >= d THEN 'cat' ELSE 'dog' END AS species FROM g""",
    "people_list": "SELECT id, name, CASE group_id WHEN 1 THEN 2 WHEN 2 THEN 1 END AS position FROM people",
    "face_list": f"WITH {_VERDICT} SELECT id, px FROM faces WHERE px >= 300 AND id NOT IN (SELECT face_id FROM v WHERE decision IS NOT NULL) ORDER BY px DESC, id LIMIT 300",
    "merged_decisions": """WITH d AS (SELECT *, CASE person_id WHEN 3 THEN 4 ELSE person_id END AS p FROM decisions), r AS (SELECT *, row_number() OVER (PARTITION BY key, x, y, w, h, p ORDER BY decision = 'rejected', d.at DESC, id DESC) AS r FROM d) SELECT p AS person_id, decision, count(*) AS n FROM r WHERE r = 1 OR (decision <> 'rejected' AND p <> 4) GROUP BY 1, 2""",
    "cosine_topk": f"WITH s AS (SELECT q.id AS query_id, f.id, {_DOT.format('q', 'f')} AS sim FROM faces q JOIN faces f ON q.id <> f.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= {MAYBE}) SELECT query_id, rank, id FROM r WHERE rank <= 5",
    "similar_to_one": f"SELECT f.id, {_DOT.format('q', 'f')} AS sim FROM faces q JOIN faces f ON f.id <> 0 WHERE q.id = 0 ORDER BY sim DESC, f.id LIMIT 24",
    "suggested_person": f"""WITH s AS (SELECT q.id, f.label AS person_id, f.id AS ref, {_DOT.format('q', 'f')} AS sim FROM faces q JOIN faces f ON q.id % 3 <> 0 AND f.id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, ref) AS rank FROM s WHERE sim >= {MAYBE}),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS first FROM r WHERE rank <= 32 AND person_id <> id % 10) SELECT id, person_id, round(sim, 6) AS sim FROM o WHERE first = 1""",
    "eligible_vectors": "SELECT id FROM faces WHERE species IN ('cat', 'dog') AND px >= 300 AND key IN (SELECT id FROM files WHERE missing_since IS NULL)",
    "current_model": "SELECT arg_max(model, lpad(CAST(done_at AS VARCHAR), 20, '0') || key) AS model FROM looked WHERE error IS NULL",
}
