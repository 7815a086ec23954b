import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.operators import catalog_sync, dupes, people, transfer, vectors
from tessella.operators.graph import components
from tessella.plans.query import BadQuery, Query, compile_query, parse


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (5, 6), (None, 3)], "a bigint, b bigint")
    assert rows(components(links)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (8, 8), (9, 8)]
    assert rows(components(links.limit(0))) == []


def test_components_of_a_long_path_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)], "a bigint, b bigint")
    got = dict(rows(components(links)))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 700)} == {500}


def test_near_pairs_is_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    hashes = [(i, b) for i, b in enumerate(base)]
    for i, b in enumerate(base[:20]):
        v = b
        for bit in rng.integers(0, 64, i % 11):
            v ^= 1 << int(bit)
        hashes.append((100 + i, (v + 2**63) % 2**64 - 2**63))
    hashes.append((200, base[0]))
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(a, b) for a, x in hashes for b, y in hashes if a < b and 0 < bits(x, y) <= 8}
    got = rows(dupes.near_pairs(spark.createDataFrame(hashes, "id bigint, phash bigint")))
    equal = {(a, b) for a, b, d in got if d == 0}
    assert {(a, b) for a, b, d in got if d} == want and len(got) == len(want) + len(equal) and (0, 200) in equal


def test_moves_use_each_record_once(spark):
    index = spark.createDataFrame([(1, "a/x.jpg", 5, 10, "h"), (2, "a/y.jpg", 5, 20, "h"), (3, "a/z.jpg", 5, 30, "h2")], "id bigint, path string, size bigint, mtime_ns bigint, quick_hash string").selectExpr("*", "cast(null as bigint) missing_since")
    found = spark.createDataFrame([("b/y.jpg", 5, 99, "h"), ("b/q.jpg", 5, 10, "h"), ("b/r.jpg", 5, 1, "h")], "path string, size bigint, mtime_ns bigint, quick_hash string")
    changes = catalog_sync.reconcile(index, found)
    assert rows(catalog_sync.match_moves(index, changes, found)) == [("b/q.jpg", 1), ("b/r.jpg", 2)] or rows(catalog_sync.match_moves(index, changes, found)) == [("b/q.jpg", 1), ("b/y.jpg", 2)]


def test_prune_folders(spark):
    folders = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 2, 0), (4, 1, 9)], "id bigint, parent_id bigint, last_seen bigint")
    files = spark.createDataFrame([(10, 4)], "id bigint, folder_id bigint")
    assert rows(catalog_sync.prune_folders(folders, files, 9).select("id")) == [(1,), (4,)]


def test_agglomerate_keeps_labels_apart_and_splits():
    v = {i: np.array([1.0, 0.0]) for i in range(6)}
    edges = [(1.0, i, i + 1) for i in range(5)]
    parts = vectors.agglomerate(list(range(6)), v, edges, {0: 1, 5: 2}, 0.5)
    assert not any(0 in p and 5 in p for p in parts) and sorted(x for p in parts for x in p) == list(range(6))
    assert max(map(len, vectors.split(list(range(6)), edges, 0.99, most=2))) <= 2


def test_clusters(spark):
    faces = spark.createDataFrame([(i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(5)], "id bigint, embedding array<double>")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0)], "a bigint, b bigint, sim double")
    labels = spark.createDataFrame([], "id bigint, person_id bigint")
    assert rows(vectors.clusters(faces, edges, labels, 0.5, 0.5)) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    base = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    got = {}
    for q, r, i, _ in rows(vectors.top_k(base, base, 3, block=16)):
        got.setdefault(q, []).append((r, i))
    s = x @ x.T
    np.fill_diagonal(s, -9)
    for q in range(60):
        assert [i for _, i in sorted(got[q])] == list(np.argsort(-s[q])[:3])


def test_transfer_is_idempotent(spark):
    files = spark.createDataFrame([(1, "q", 5, "f"), (2, "q", 5, "f"), (3, "r", 5, "g")], "id bigint, quick_hash string, size bigint, full_hash string")
    tags = spark.createDataFrame([(1, "A"), (3, "b")], "file_id bigint, name string")
    none = tags.limit(0)
    added = transfer.new_tags(files, files, tags, none)
    assert rows(added) == [(1, "a"), (2, "a"), (3, "b")]
    assert transfer.new_tags(files, files, tags, added.withColumnRenamed("tag", "name")).count() == 0


def test_new_decisions_skip_overlaps(spark):
    schema = "key bigint, id bigint, x double, y double, w double, h double, species string"
    new = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.5, None), (1, 2, 0.01, 0.0, 0.5, 0.5, None), (1, 3, 0.0, 0.0, 0.5, 0.5, "cat"), (2, 4, 0.0, 0.0, 0.5, 0.5, None)], schema)
    old = spark.createDataFrame([(2, 9, 0.0, 0.0, 0.5, 0.5, None)], schema)
    assert rows(transfer.new_decisions(new, old).select("id")) == [(1,), (3,)]


def test_export_names_are_unique(spark):
    files = spark.createDataFrame([(1, "a.jpg", "x", "2"), (2, "A.jpg", "y", "1"), (3, "a_2.jpg", "z", "0"), (4, "b.jpg", "z", None)], "id bigint, name string, path string, taken string")
    got = dict(rows(transfer.export_names(files, ["B.jpg"])))
    assert len({v.lower() for v in got.values()} | {"b.jpg"}) == 5


def test_merge_people_confirmation_beats_rejection(spark):
    d = spark.createDataFrame([(1, "k", 0.0, 0.0, 1.0, 1.0, 1, "confirmed", 5), (2, "k", 0.0, 0.0, 1.0, 1.0, 2, "rejected", 9), (3, "k2", 0.0, 0.0, 1.0, 1.0, 1, "rejected", 1), (4, "k2", 0.0, 0.0, 1.0, 1.0, 2, "rejected", 2)], "id bigint, key string, x double, y double, w double, h double, person_id bigint, decision string, at bigint")
    assert rows(people.merge(d, 1, 2).select("id", "person_id", "decision")) == [(1, 2, "confirmed"), (4, 2, "rejected")]


def test_decide(spark):
    d = spark.createDataFrame([(1, "k", 7, "rejected", 1), (2, "k", 8, "confirmed", 2)], "id bigint, key string, person_id bigint, decision string, at bigint")
    target = spark.createDataFrame([("k", [1, 2])], "key string, decision_ids array<bigint>")
    assert rows(people.decide(d, target, "confirm", 9, 5).select("person_id", "decision")) == [(7, "rejected"), (9, "confirmed")]
    assert rows(people.decide(d, target, "undo", None, 5).select("id")) == [(1,)]
    assert rows(people.decide(d, target, "unreject", 7, 5).select("id")) == [(2,)]


def test_parse_query():
    q = parse([("tag", "a"), ("tag", "a"), ("person", "3"), ("date", "2001"), ("area", "0,0,1,1")])
    assert q.tags == ("a",) and q.people == (3,) and q.area == (0, 0, 1, 1)
    for bad in ([("type", "x")], [("person", "x")], [("area", "5,0,1,1")], [("nope", "1")]):
        with pytest.raises(BadQuery):
            parse(bad)


def test_a_facet_counts_what_its_filter_shows(spark, sf):
    from tessella.catalog import shown
    from tessella.operators import facets

    lib = shown._library(spark, sf)
    lib.items = lib.items.cache()
    visible = compile_query(lib, Query())
    for r in facets.facets_within(visible, lib.tags).orderBy("name").limit(4).collect():
        assert compile_query(lib, Query(tags=(r["name"],))).count() == r["n"]


def test_schemas():
    assert all(schemas.schema(t).names for t in schemas.TABLES)


def test_edits(spark):
    from tessella.operators import edits

    tags = spark.createDataFrame([(1, "Sea", "user", 1), (2, "sea", "folder", None)], "file_id bigint, name string, source string, added_at bigint")
    files = spark.createDataFrame([(1,), (2,), (2,)], "file_id bigint")
    more = edits.add_tag(tags, files, " SEA ", 9)
    assert rows(more.filter("source = 'user'").select("file_id")) == [(1,), (2,)]
    assert rows(edits.remove_tag(more, files, "sea").select("file_id", "source")) == [(2, "folder")]
    moved = edits.rename_folder(spark.createDataFrame([("a",), ("a/b",), ("ab",)], "path string"), "a", "z")
    assert rows(moved) == [("ab",), ("z",), ("z/b",)]
    over = spark.createDataFrame([("k", "2001-01-01T00:00:00", None, 1)], "key string, taken string, taken_offset string, at bigint")
    now, undo = edits.apply_dates(over, spark.createDataFrame([("k", "2002-01-01T00:00:00", None), ("l", "2003-01-01T00:00:00", "+01:00")], "key string, taken string, taken_offset string"), 5)
    assert rows(now.select("key", "taken")) == [("k", "2002-01-01T00:00:00"), ("l", "2003-01-01T00:00:00")]
    assert dict(rows(undo.select("key", "taken"))) == {"k": "2001-01-01T00:00:00", "l": None}
    with pytest.raises(ValueError):
        edits.apply_dates(over, spark.createDataFrame([("k", "x", None)], "key string, taken string, taken_offset string"), 5)


def test_same_photo_numbers_edits_and_turned_copies(spark):
    cols = "grp bigint, id bigint, folder string, name string, kind string, phash bigint, full_hash string, width int, height int, taken string, size bigint, added_at bigint"
    made = [("a", "IMG_0001.jpg", 400, 300), ("a", "IMG_0002.jpg", 200, 150), ("a", "IMG_E0001.jpg", 300, 225), ("a", "IMG_0001 (2).heic", 150, 200), ("a", "x.jpg", 300, 400), ("b/out", "y.png", 800, 600)]
    rows = spark.createDataFrame([(1, i, f, n, "photo", 5, f"h{i}", w, h, None, 10, i) for i, (f, n, w, h) in enumerate(made)], cols)
    pairs = {(r[0], r[1]) for r in rows.alias("a").join(rows.alias("b"), F.col("a.id") < F.col("b.id")).filter(dupes.same_photo("a", "b")).select("a.id", "b.id").collect()}
    assert pairs == {(0, 3), (0, 5), (1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)}
    none = spark.createDataFrame([], "a bigint, b bigint")
    best = {r["id"]: r["photo"] for r in dupes.photo_rows(rows, none).collect()}
    assert best == {i: 5 for i in range(6)}
    best = {r["id"]: r["photo"] for r in dupes.photo_rows(rows, none, ["out"]).collect()}
    assert best == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 0}


def test_camera_and_copy_names(spark):
    told = {
        "IMG_6621.HEIC": ("img", False, 6621), "IMG_E6621.HEIC": ("img", True, 6621), "_DSC0012.jpg": ("dsc", False, 12), "MVIMG_0012 (2).jpg": ("mvimg", False, 12), "img 0012 - Copy.jpg": ("img", False, 12),
        "DSC-E123.jpg": ("dsc", True, 123), "IMG-20250726-WA0001.jpg": None, "PXL_20250101_120000123.jpg": None, "IMGX0012.jpg": None, "MVI_0012.jpg": None, "P123.tif": ("p", False, 123), "img_12.jpg": None,
    }
    names = spark.createDataFrame([(n,) for n in told], "name string")
    got = {r["name"]: r["c"] and tuple(r["c"]) for r in names.select("name", dupes.camera_name(F.col("name")).alias("c")).collect()}
    assert got == told
    own = ["x.jpg", "x - Copy.jpg", "x - Kopie (2).jpg", "x copy 2.jpg", "x (1).jpg", "x(1).jpg", "x (another copy).jpg", "x (3rd copy).png", "x (Ann's conflicted copy 2024-01-01).jpg", "x-1.jpg", "x_2.jpg", "x 2.jpg", "x копия.jpg", "y copy.jpg", "x3.jpg", "(copy).jpg"]
    copied = dupes.copy_named(spark.createDataFrame([(1, i, n) for i, n in enumerate(own)], "grp int, id int, name string"))
    assert sorted(own[r["id"]] for r in copied.collect()) == sorted(own[1:13])


def test_open_pairs_with_decisions(spark):
    """Components are those of all undecided pairs, also where a decision names the least of a class."""
    files = spark.createDataFrame([(i, None, f"h{i}", "f", f"n{i}.jpg", 7) for i in range(1, 6)], "id bigint, missing_since bigint, full_hash string, folder string, name string, phash bigint")
    for decided in ([(1, 2)], [(1, 2), (1, 3), (1, 4), (1, 5)], [(1, 2), (3, 4), (1, 5)], [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]):
        got = {r["id"]: r["grp"] for r in dupes.groups(dupes.open_pairs(files, spark.createDataFrame(decided, "a bigint, b bigint"))).collect()}
        root = {i: i for i in range(1, 6)}
        for _ in range(5):
            for a in range(1, 6):
                for b in range(a + 1, 6):
                    if (a, b) not in decided:
                        root[a] = root[b] = min(root[a], root[b])
        size = list(root.values())
        assert got == {i: g for i, g in root.items() if size.count(g) > 1}


def test_split_unites_plainly():
    edges = [(0.9, i, i + 1) for i in range(0, 9)] + [(0.95, 0, 1), (0.95, 1, 2)]
    assert sorted(map(sorted, vectors.split(list(range(10)), edges, 0.89, most=4))) == [[0, 1, 2], *[[i] for i in range(3, 10)]]


def test_picture_hash(spark):
    rng = np.random.default_rng(0)
    grey = rng.random((32, 32))
    h = vectors.picture_hash(grey)
    assert -(2**63) <= h < 2**63 and bin((h ^ vectors.picture_hash(grey * 0.9 + 0.01)) & (2**64 - 1)).count("1") <= 2
    # A bright left half: the lowest horizontal frequency, the second lowest bit, is set.
    assert vectors.picture_hash(np.tile(np.r_[np.ones(16), np.zeros(16)], (32, 1))) & 2
    got = vectors.picture_hashes(spark.createDataFrame([(1, grey.ravel().tolist()), (2, None), (3, [1.0])], "id int, grey array<double>")).orderBy("id").collect()
    assert [(r["phash"], r["flat"]) for r in got] == [(h, vectors.flatness(grey)), (None, None), (None, None)]


def test_moves_with_full_hashes_and_forms(spark):
    index = spark.createDataFrame([(1, "a/x.jpg", "a/x.jpg", 5, 10, "q", "f1", None), (2, "a/y.jpg", "a/y.jpg", 5, 20, "q", "f2", None), (3, "b/o\u0308.jpg", "b/\u00f6.jpg", 7, 1, "r", None, None)], "id bigint, raw_path string, path string, size bigint, mtime_ns bigint, quick_hash string, full_hash string, missing_since bigint")
    found = spark.createDataFrame([("c/new.jpg", "c/new.jpg", 5, 99, "q", "f2"), ("c/y.jpg", "c/y.jpg", 5, 20, "q", "other"), ("b/\u00f6.jpg", "b/\u00f6.jpg", 7, 1, "r", None)], "raw_path string, path string, size bigint, mtime_ns bigint, quick_hash string, full_hash string")
    changes = catalog_sync.reconcile(index, found)
    assert dict(rows(changes.select("path", "change")))["b/\u00f6.jpg"] == "renamed_unicode"
    # The first path takes the record of its full hash; the second, plain by name and time, then has only one that its full hash forbids.
    assert rows(catalog_sync.match_moves(index, changes, found)) == [("c/new.jpg", 2)]


def test_trash(spark):
    from tessella.operators import removal

    files = spark.createDataFrame([(1, "a", "x.jpg"), (2, "a", "x.cr2"), (3, "a", "y.jpg")], "id bigint, folder string, name string")
    tags = spark.createDataFrame([(1, "Sea", "user"), (3, "Sea", "user")], "file_id bigint, name string, source string")
    trash = spark.createDataFrame([], "id bigint, folder string, name string, tags array<struct<name:string,source:string>>, batch bigint")
    left, own, gone = removal.to_trash(files, tags, trash, spark.createDataFrame([(1,)], "id bigint"), 9)
    assert rows(left.select("id")) == [(3,)] and rows(own.select("file_id")) == [(3,)] and rows(gone.select("id", "batch")) == [(1, 9), (2, 9)]
    back, told, rest = removal.restore(left, own, gone, 9)
    assert rows(back.select("id")) == [(1,), (2,), (3,)] and rows(told.select("file_id", "name")) == [(1, "Sea"), (3, "Sea")] and rest.count() == 0
    kept, out = removal.empty_trash(gone, 9)
    assert kept.count() == 2 and out.count() == 0 and removal.empty_trash(gone)[0].count() == 0


def test_removal_conflicts(spark):
    from tessella.operators import removal

    files = spark.createDataFrame([(1, 7, "h", None, 10, 10, 1, "a", "2001-01-01T00:00:00"), (2, 7, "h", None, 10, 10, 2, "b", "2005-01-01T00:00:00"), (3, 8, "z", None, 10, 10, 3, "c", None)], "id bigint, grp bigint, full_hash string, phash bigint, width int, height int, added_at bigint, path string, taken string")
    tags = spark.createDataFrame([(2, "Sea", "user")], "file_id bigint, name string, source string")
    plan = removal.removal_plan(files, tags, spark.createDataFrame([(1,)], "id bigint"), spark.createDataFrame([(2,), (3,)], "id bigint"))
    assert rows(plan["heirs"]) == [(2, 1)] and rows(plan["tags"]) == [(1, "Sea")] and plan["dates"].count() == 0
    assert sorted(rows(plan["conflicts"])) == [(1, "date"), (3, "no_heir")]


def test_inverted_file_recall(spark):
    """Cells as many as the root of the vectors: neighbours of 0.55 or more are found."""
    from tessella.operators import index

    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 64))[rng.integers(0, 150, 3000)] + 0.5 * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    cells = index.learn_cells(base)
    assert len(cells.centres) == round(3000**0.5) and cells.probed == 12
    got = {(r["query_id"], r["id"]) for r in index.near(base.filter("id % 30 = 0"), base, 24, 0.55, cells).collect()}
    want = set()
    for q in range(0, 3000, 30):
        s = x @ x[q]
        s[q] = -1
        want |= {(q, int(i)) for i in np.argsort(-s, kind="stable")[:24] if s[i] >= 0.55}
    assert len(got & want) >= 0.99 * len(want)
