"""Logical tables built from the generated test tables, by the same rules in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: By logical table: SQL over the test tables. sha(...) is the 256-bit hash in either dialect.
RULES = {
    # A catalogue of files; folders are two or three levels deep, some of them events.
    "files": """
SELECT doc_id AS id,
  lang || '/' || CASE WHEN doc_id % 3 = 0 THEN '20' || lpad(CAST(10 + doc_id % 10 AS STRING), 2, '0') || '-' || lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0') || ' Trip ' || source ELSE source END AS folder,
  'IMG_' || lpad(CAST(doc_id % 5000 AS STRING), 4, '0') || CASE doc_id % 8 WHEN 0 THEN '.mp4' WHEN 1 THEN '.cr2' WHEN 2 THEN '.png' WHEN 3 THEN '.heic' ELSE '.jpg' END AS name,
  CASE doc_id % 8 WHEN 0 THEN 'video' WHEN 1 THEN 'raw' WHEN 2 THEN 'png' WHEN 3 THEN 'heic' ELSE 'jpeg' END AS kind,
  n_chars AS size, sha(text) AS full_hash, sha(CAST(n_chars AS STRING) || substr(text, 1, 64)) AS quick_hash,
  CASE WHEN doc_id % 7 <> 0 THEN '20' || CAST(10 + doc_id % 15 AS STRING) || '-' || lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(doc_id % 24 AS STRING), 2, '0') || ':' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || ':00' END AS taken,
  CASE WHEN doc_id % 4 = 1 THEN '+02:00' END AS taken_offset,
  CAST((1400000000 + doc_id * 900) AS BIGINT) * 1000000000 AS mtime_ns,
  CASE WHEN doc_id % 2 = 0 THEN CAST((1400000000 + doc_id * 900 + (doc_id % 5 - 2) * 3600) AS BIGINT) * 1000000000 END AS created_ns,
  CASE WHEN doc_id % 6 = 5 THEN 1170 WHEN doc_id % 6 = 4 THEN 1080 ELSE 4000 END AS width, CASE WHEN doc_id % 6 = 5 THEN 2532 WHEN doc_id % 6 = 4 THEN 1920 ELSE 3000 END AS height,
  CASE WHEN doc_id % 8 = 0 THEN (doc_id % 11) * 1000 END AS duration_ms, CASE WHEN doc_id % 4 <> 0 THEN 'Camera ' || CAST(doc_id % 3 AS STRING) END AS camera,
  CASE WHEN doc_id % 13 = 3 THEN 1700000000 + doc_id END AS missing_since, CASE WHEN doc_id % 3 <> 1 THEN 1600000000 + (doc_id * 7919) % 1000003 END AS verified_at, 1500000000 + doc_id AS added_at,
  CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 180 - 90 AS DOUBLE) END AS lat, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 360 - 180 AS DOUBLE) END AS lon, doc_id % 101 AS shot_pixels
FROM documents""",
    # The same files as pictures, with names that cameras, phones and copying give, and hashes that near copies have in common or nearly so.
    "pictures": """
SELECT id, 'roll ' || substr(look, 1, 1) || CASE WHEN id % 7 = 3 THEN '/src3' ELSE '' END AS folder, missing_since, added_at, size, full_hash, CASE WHEN id % 16 = 0 THEN 'video' ELSE 'jpeg' END AS kind,
  CASE id % 12 WHEN 0 THEN 'IMG_' || n || '.jpg' WHEN 1 THEN 'img_e' || n || '.JPG' WHEN 2 THEN 'IMG_' || n || ' (2).jpg' WHEN 3 THEN 'MVIMG_' || n || '.jpg' WHEN 4 THEN '_DSC' || n || '.jpeg' WHEN 5 THEN 'DSC-0' || n || ' copy 2.png'
    WHEN 6 THEN 'IMG-20250726-WA' || n || '.jpg' WHEN 7 THEN 'IMG 00' || n || ' - Kopie.heic' WHEN 8 THEN 'IMG_' || n || '_1.jpg' WHEN 9 THEN 'holiday.jpg' WHEN 10 THEN 'holiday (another copy).jpg' ELSE 'P' || n || '.tiff' END AS name,
  CASE id % 4 WHEN 1 THEN 2000 WHEN 2 THEN 3000 ELSE 4000 END AS width, CASE id % 4 WHEN 1 THEN 1500 WHEN 2 THEN 4000 ELSE 3000 END AS height,
  CASE WHEN id % 3 <> 0 THEN '2015-05-1' || CAST(hexint(substr(look, 2, 1)) % 9 AS STRING) || 'T10:00:0' || CAST(id % 6 AS STRING) END AS taken,
  hexint(substr(look, 1, 13)) * 256 + CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 127 ELSE 85 END AS phash
FROM (SELECT f.*, sha(substr(d.text, 1, 40)) AS look, lpad(CAST(hexint(substr(sha(substr(d.text, 1, 40)), 20, 1)) + 12 AS STRING), 4, '0') AS n FROM files f JOIN documents d ON d.doc_id = f.id) x""",
    "dup_decisions": "SELECT x.id AS a, y.id AS b FROM pictures x JOIN pictures y ON x.phash = y.phash AND x.id < y.id WHERE (x.id + y.id) % 4 = 0",
    # Two drives that hold most contents in common; some files of b lie under other names.
    "drive_files": """
SELECT 'a' AS drive, f.* FROM files f WHERE id % 5 <> 0
UNION ALL SELECT 'b' AS drive, id, folder, CASE WHEN id % 9 = 4 THEN 'moved-' || name ELSE name END AS name, kind, size, CASE WHEN id % 17 = 2 THEN sha(full_hash) ELSE full_hash END AS full_hash, quick_hash, taken, taken_offset, mtime_ns, created_ns, width, height, duration_ms, camera, missing_since, verified_at, added_at, lat, lon, shot_pixels FROM files WHERE id % 5 <> 1""",
    "drive_paths": "SELECT *, folder || '/' || name AS path FROM drive_files",
    "removed_copies": """
SELECT f.id, f.folder || '/' || f.name AS path, f.full_hash, k.full_hash AS kept_hash, 1700000000 + f.id AS removed_at FROM files f JOIN files k ON k.id = f.id + 2 WHERE f.id % 5 = 0""",
    # What a user has said about contents.
    "taken_overrides": "SELECT full_hash AS key, max('2009-05-0' || CAST(1 + id % 9 AS STRING) || 'T12:00:00') AS taken, CAST(NULL AS STRING) AS taken_offset FROM files WHERE id % 19 = 7 GROUP BY full_hash",
    "date_estimates": "SELECT full_hash AS key, CAST(max(1950 + id % 60) AS INT) AS year, CAST(max(CASE WHEN id % 2 = 0 THEN 1 + id % 12 END) AS INT) AS month, CAST(NULL AS INT) AS day FROM files WHERE id % 23 = 5 GROUP BY full_hash",
    "geo_overrides": "SELECT full_hash AS key, CAST(max(id % 80) AS DOUBLE) AS lat, CAST(max(id % 170) AS DOUBLE) AS lon FROM files WHERE id % 10 = 3 GROUP BY full_hash",
    "shot_marks": "SELECT f.full_hash AS key, max(l.quality) = 1 AS is_shot FROM files f JOIN labels l ON f.id = l.doc_id WHERE f.id % 4 = 2 GROUP BY f.full_hash",
    "hidden_folders": "SELECT DISTINCT folder AS path FROM files WHERE id % 200 = 9",
    "file_tags": """
SELECT id AS file_id, lang_tag AS name, 'folder' AS source, CAST(NULL AS BIGINT) AS added_at FROM (SELECT id, substr(folder, 1, 2) AS lang_tag FROM files)
UNION ALL SELECT id AS file_id, 'Album ' || CAST(id % 17 AS STRING) AS name, 'user' AS source, 1600000000 + id AS added_at FROM files WHERE id % 3 = 1
UNION ALL SELECT id AS file_id, 'favourite' AS name, 'user' AS source, 1610000000 + id AS added_at FROM files WHERE id % 29 = 1
UNION ALL SELECT id AS file_id, 'en' AS name, 'user' AS source, 1620000000 + id AS added_at FROM files WHERE id % 31 = 1""",
    "jobs": "SELECT event_id AS id, event_type AS kind, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END AS state, user_id % 7 AS space, 1600000000 + event_id * 30 AS updated_at FROM events",
    # Faces: a box in each content's picture, with its embedding.
    "faces": """
SELECT vec_id AS id, vec_id - vec_id % 8 AS key, embedding, label,
  (vec_id % 7) / 10.0 AS x, (vec_id % 5) / 10.0 AS y, 0.1 + (vec_id % 4) / 20.0 AS w, 0.1 + (vec_id % 3) / 20.0 AS h, 100 + vec_id % 900 AS px, CASE WHEN vec_id % 11 = 0 THEN 'cat' WHEN vec_id % 13 = 0 THEN 'dog' ELSE 'person' END AS species, (vec_id % 100) / 100.0 AS score
FROM embeddings""",
    "decisions": """
SELECT vec_id AS id, vec_id - vec_id % 8 AS key, (vec_id % 7) / 10.0 + 0.01 AS x, (vec_id % 5) / 10.0 + 0.01 AS y, 0.1 + (vec_id % 4) / 20.0 AS w, 0.1 + (vec_id % 3) / 20.0 AS h, label AS person_id,
  CASE WHEN vec_id % 10 = 6 THEN 'rejected' WHEN vec_id % 10 = 9 THEN 'ignored' ELSE 'confirmed' END AS decision, 1600000000 + (vec_id * 7919) % 5003 AS at, CASE WHEN vec_id % 21 = 0 THEN 'cat' END AS species, vec_id % 30 = 0 AS manual
FROM embeddings WHERE vec_id % 3 = 0""",
    "clusters": "SELECT id, label * 3 + id % 3 AS cluster, species, CASE WHEN id % 4 <> 0 THEN score END AS sim, label AS person_id FROM faces",
    "people": "SELECT DISTINCT label AS id, 'Person ' || CAST(label AS STRING) AS name, CASE WHEN label % 3 = 0 THEN NULL ELSE label % 3 END AS group_id, label = 7 AS hidden FROM embeddings",
    "drive_people": "SELECT CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS drive, CASE WHEN vec_id % 4 < 2 THEN 'Person ' ELSE 'PERSON ' END || CAST(label AS STRING) AS name, count(*) AS faces, count(DISTINCT vec_id - vec_id % 8) AS photos, min(label % 5) = 0 AS hidden, CAST(min(label % 3) AS INT) AS grp FROM embeddings GROUP BY 1, 2",
    "phashes": "SELECT vec_id AS id, embedding FROM embeddings",
    "text_lines": "SELECT conv_id * 1000 + turn AS id, conv_id AS key, CAST(turn AS DOUBLE) AS y, CAST(turn % 3 AS DOUBLE) AS x, text, (conv_id * 7 + turn * 13) % 100 / 100.0 AS score, 0.002 + (conv_id + turn) % 20 / 1000.0 AS h FROM conversations WHERE text IS NOT NULL",
    "places": "SELECT n_nationkey AS id, n_name AS name, CAST(-90 + n_nationkey * 5 AS DOUBLE) AS south, CAST(-60 + n_nationkey * 5 AS DOUBLE) AS north, CAST(-180 + n_nationkey * 10 AS DOUBLE) AS west, CAST(-100 + n_nationkey * 10 AS DOUBLE) AS east FROM nation",
    "looked": "SELECT full_hash AS key, max(id % 3) AS model, max(CASE WHEN id % 37 = 1 THEN 'cannot decode' WHEN id % 37 = 2 THEN 'timeout' END) AS error, max(1600000000 + id) AS done_at FROM files WHERE id % 4 <> 3 GROUP BY full_hash",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_HEX = r"\bhexint\(((?:[^()]|\((?:[^()]|\([^()]*(?:\([^()]*\)[^()]*)*\))*\))*)\)"
_HEX_DUCK = r"CAST('0x' || \1 AS BIGINT)"
#: Numbers with a point are doubles in DuckDB's sums and quotients; in Spark they would make exact decimals of them.
_POINT = re.compile(r"(?<![\w.'])([0-9]+\.[0-9]+)(?![\w.'])")
_NAMES = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b")


def uses(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAMES.findall(sql)) if n in RULES or n in BASE]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table (or a test table by its own name) as a DataFrame."""
    if name not in RULES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = RULES[name]
    parts = {n: load(spark, sf_dir, n) for n in uses(sql)}
    text = re.sub(r"\bsha\(", "sha2(", re.sub(_HEX, r"CAST(conv(\1, 16, 10) AS BIGINT)", sql))
    text = re.sub(r"sha2\(((?:[^()]|\([^()]*(?:\([^()]*\)[^()]*)*\))*)\)", r"sha2(\1, 256)", text)
    text = _POINT.sub(r"\1D", text)
    text = _NAMES.sub(lambda m: m[0].replace(m[1], "{" + m[1] + "}") if m[1] in parts else m[0], text)
    return spark.sql(text, **parts)


def oracle(sql: str) -> str:
    """DuckDB SQL with the logical tables that it (or they) use as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in uses(text):
            if n in RULES and n not in order:
                need(RULES[n])
                order.append(n)

    need(sql)
    ctes = [f"{n} AS ({re.sub(r'sha\(', 'sha256(', re.sub(_HEX, _HEX_DUCK, RULES[n])).strip()})" for n in order]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*ctes, body])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
