"""Queries give their SQL's rows on tables whose rows repeat under other ids."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import catalog
from tessella.operators import across, drives, dupes, index
from tessella.plans.query import Library


def plain(v):
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


def both(spark, d, name):
    """Rows of a query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for t in os.listdir(d):
        p = f"{d}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    df = catalog.QUERIES[name](spark, str(d))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    return got, sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())


@pytest.fixture(scope="module")
def repeated(spark, sf, tmp_path_factory):
    """Documents three times; names, folders and contents come again with ids that are a multiple of 30,000 apart."""
    d = tmp_path_factory.mktemp("repeated")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    docs.withColumn("doc_id", F.col("doc_id") + 30_000 * F.col("k")).drop("k").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors that are hardly alike, beyond the number up to which all are compared, some of them copies, one null."""
    d = tmp_path_factory.mktemp("vectors")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2_100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2_000:] = x[rng.integers(0, 40, 100)]
    rows = [(i, v.tolist(), i % 20) for i, v in enumerate(x)] + [(2_100, None, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_missing_marks_of_repeated_paths(spark, repeated):
    got, want = both(spark, repeated, "mark_missing")
    assert got == want and len(want) > 300

def test_reconcile_of_repeated_paths(spark, repeated):
    got, want = both(spark, repeated, "scan_reconcile")
    assert got == want and len(want) > 300

def test_boxes_at_the_limit(spark, tmp_path):
    """Shares of boxes that rounding decides: sums of doubles, as in the SQL."""
    spark.range(3_000).selectExpr("id AS vec_id", "array(1f, 0f) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, tmp_path, "pet_face_containment")
    assert got == want and len(want) > 300

def test_pairs_of_many_equal_hashes(spark, vectors):
    got, want = both(spark, vectors, "hamming_pairs")
    assert got == want and sum(r[2] == "0" for r in want) > 100


@pytest.mark.parametrize("most", [8, 18])
def test_near_values_in_blocks_and_bands(spark, monkeypatch, most):
    monkeypatch.setattr(dupes, "BLOCK", 50)
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 200)
    near = base[:100].copy()
    for _ in range(12):
        near ^= 1 << rng.integers(0, 62, 100)
    values = sorted({int(v) for v in np.r_[base, near]})
    got = sorted((r[0], r[1]) for r in dupes.near_values(spark.createDataFrame([(v,) for v in values], "phash bigint"), most).collect())
    got = sorted(tuple(sorted(x)) for x in got)
    assert got == [(p, q) for i, p in enumerate(values) for q in values[i + 1 :] if ((p ^ q) & (2**64 - 1)).bit_count() <= most] and got

def test_inverted_file_misses_none(spark, vectors):
    got, want = both(spark, vectors, "inverted_file_neighbours")
    assert got == want and len(want) > 1_000


def test_bounds_rule_out_no_neighbour(spark):
    """Close clusters, of vectors that are no unit vectors: most cells are ruled out, and none of the neighbours."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 2_400)] + 0.1 * rng.normal(size=(2_400, 16))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in index.near_all(base.filter("id % 40 = 0"), base, 5, 12.0).collect())
    want = []
    for q in range(0, 2_400, 40):
        s = x @ x[q]
        s[q] = -np.inf
        want += [(q, n + 1, int(i)) for n, i in enumerate(np.argsort(-s, kind="stable")[:5]) if s[i] >= 12.0]
    assert got == want and want

def test_neighbour_lists_miss_none(spark, vectors):
    got, want = both(spark, vectors, "neighbour_lists")
    assert got == want and len(want) > 1_000

def test_shown_once_is_settled(spark):
    """Of copies at one path, which the SQL leaves open, the least id is shown, however the rows are dealt."""
    rows = [(i, "a", "en/x.jpg", "x.jpg", "h", None, None) for i in range(200, 0, -1)]
    files = spark.createDataFrame(rows, "id bigint, drive string, path string, name string, full_hash string, dated_at bigint, missing_since bigint")
    assert [r["id"] for r in drives.shown_once(files.repartition(7)).collect()] == [1]

def test_all_drives_timeline_is_settled(spark):
    """Of copies at one path, which the SQL leaves open, the least id is shown, however the rows are dealt."""
    rows = [(i, "en/x.jpg", "x.jpg", "en", "h", "2015-01-01", False) for i in range(200, 0, -1)]
    items = spark.createDataFrame(rows, "id bigint, path string, name string, folder string, full_hash string, sort string, is_hidden boolean").withColumn("media_type", F.lit("photo"))
    tags = spark.createDataFrame([(5, "favourite", "user")], "file_id bigint, name string, source string")
    got = across.timeline({"a": Library(items.repartition(7), tags), "b": Library(items.limit(0), tags)}, across.NamedQuery()).select("drive", "id", "loved", "n_drives").collect()
    assert [tuple(r) for r in got] == [("a", 1, True, 1)]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Documents twice, the second time with some languages or sources null; some texts null, some languages in capitals. No two copies lie at one path."""
    d = tmp_path_factory.mktemp("odd")
    for t in os.listdir(sf):
        if not t.startswith("documents"):
            os.symlink(f"{sf}/{t}", d / t)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.expr("CASE WHEN doc_id % 10 <> 3 THEN text END")).withColumn("lang", F.expr("CASE WHEN doc_id % 10 = 8 THEN upper(lang) ELSE lang END"))
    again = docs.selectExpr("doc_id + 5000 AS doc_id", "text", "CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang", "CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 > 1 THEN concat(source, 'x') ELSE source END AS source", "n_chars")
    docs.unionByName(again.select(docs.columns)).write.parquet(f"{d}/documents.parquet")
    return d


def test_all_drives_timeline_of_odd_rows(spark, odd):
    """Files without content, folder or path, and tags in capitals, are shown as in the SQL."""
    got, want = both(spark, odd, "all_drives_timeline")
    assert got == want and len(want) > 50

def test_shown_once_of_odd_rows(spark, odd):
    """Of a file with a path and one without, that with a path is shown, as in the SQL."""
    got, want = both(spark, odd, "copies_shown_once")
    assert got == want and len(want) > 200

def test_all_drives_timeline_of_repeated_ids(spark, sf, tmp_path):
    """An id twice, in a hidden folder and in another: each row is hidden by its own folder, as in the SQL."""
    for t in os.listdir(sf):
        if not t.startswith("documents"):
            os.symlink(f"{sf}/{t}", tmp_path / t)
    rows = [f"SELECT id AS doc_id, concat('text ', id, lang) AS text, lang, concat('src', id % 4) AS source, id AS n_chars FROM (SELECT id, element_at(array('en', 'de', 'fr', 'es'), int((id DIV {n}) % 4 + 1)) AS lang FROM range(600))" for n in (4, 7)]
    spark.sql(" UNION ALL ".join(rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, tmp_path, "all_drives_timeline")
    assert got == want and len(want) > 50

def test_all_drives_timeline_without_the_tag(spark, sf, tmp_path):
    """No file has the tag: no rows, under the columns of other tables."""
    for t in os.listdir(sf):
        if not t.startswith("documents"):
            os.symlink(f"{sf}/{t}", tmp_path / t)
    spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id IN (2, 3)").withColumn("lang", F.lit("fr")).write.parquet(f"{tmp_path}/documents.parquet")
    assert both(spark, tmp_path, "all_drives_timeline") == ([], [])
    assert catalog.QUERIES["all_drives_timeline"](spark, str(tmp_path)).dtypes == catalog.QUERIES["all_drives_timeline"](spark, sf).dtypes


def test_links_grow_with_files_and_decisions(spark):
    """Four hundred files of five near hashes and no decision: links are few, one group; with decisions, groups as by all pairs."""
    codes = [0, 1, 3, 127, 85]
    files = spark.range(400).selectExpr("id", "cast(null as bigint) missing_since", "'f' folder", "'x.jpg' name", "concat('h', id % 50) full_hash", f"element_at(array({', '.join(map(str, codes))}), cast(id % 5 + 1 as int)) + 0L phash")
    none = spark.createDataFrame([], "a bigint, b bigint")
    pairs = dupes.open_pairs(files, none)
    assert pairs.count() < 400 * 12
    assert {(r["grp"], r["exact"]) for r in dupes.groups(pairs).collect()} == {(0, False)}


@pytest.mark.parametrize("seed", range(3))
def test_groups_with_many_decisions_are_those_of_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    n = 14
    hashes, contents = [int(x) for x in rng.choice([0, 1, 1 << 20, (1 << 40) - 1], n)], [str(x) for x in rng.integers(0, 9, n)]
    decided = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.85}
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    linked = set()
    for a in range(n):
        for b in range(a + 1, n):
            if (a, b) not in decided and (contents[a] == contents[b] or (hashes[a] ^ hashes[b]).bit_count() <= 8):
                linked |= {a, b}
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    files = spark.createDataFrame([(i, None, "f", "x.jpg", contents[i], hashes[i]) for i in range(n)], "id bigint, missing_since bigint, folder string, name string, full_hash string, phash bigint")
    got = {r["id"]: r["grp"] for r in dupes.groups(dupes.open_pairs(files, spark.createDataFrame(sorted(decided), "a bigint, b bigint"))).collect()}
    assert got == {i: find(i) for i in linked}
