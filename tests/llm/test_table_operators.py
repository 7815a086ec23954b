"""The operators over tables: against brute force, and on odd, empty and skewed tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import mih, mixing, neardup, sharding


def texts_with_copies(seed=1, groups=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    rows, truth, n = [], {}, 0
    for g in range(groups):
        base = [word() for _ in range(rng.randint(30, 200))]
        for c in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(int(len(own) * 0.03 * (c % 3))):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            truth[n] = g
            n += 1
    return rows, truth


def brute_classes(rows):
    words = neardup.Words()
    hashed = {i: words.hashes(neardup.WORD.findall(t.lower())).astype(np.uint32) for i, t in rows}
    root = {i: i for i in hashed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(hashed)
    for a in ids:
        for b in ids:
            if a < b and neardup.similar(hashed[a], hashed[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_neardup_is_brute_force(spark):
    rows, _ = texts_with_copies()
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert got == brute_classes(rows)


def test_neardup_large_group(spark):
    """More copies than a bucket pairs, none of them equal."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert {r["class_id"] for r in neardup.classes(df).collect()} == {0}


def test_neardup_odd_rows(spark):
    rows = [(5, None), (6, None), (7, ""), (8, ""), (9, "!!"), (10, "!!"), (11, "a b c"), (12, "A, b c"), (13, "a b c"), (13, "a b c"), (None, "a b c"), (14, "x " * 30_000), (15, "x " * 30_000), (16, "a b d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class_id", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(df).filter("doc_id IS NOT NULL").collect())
    assert got == [(5, 5), (6, 6), (7, 7), (8, 7), (9, 9), (10, 9), (11, 11), (12, 11), (13, 11), (13, 11), (14, 14), (15, 14), (16, 16)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 5, 6, 7, 9, 11, 14, 16]
    assert neardup.classes(df.limit(0)).count() == 0


def test_mih_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[700:760] = x[0]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in mih.nearest_vectors(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(sc - x[v] @ x[q]) < 1e-9 for _, v, sc in rows)
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))
        hits += len({v for _, v, _ in rows} & set(want.tolist()))
        total += 20
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[0])] == list(range(700, 720))


def test_mih_pigeonhole():
    """Every code within the radius is probed, and nothing but buckets within reach."""
    drawn = np.random.default_rng(1).integers(0, 1 << 16, (600, 4)).astype(np.uint16)
    drawn[50] = drawn[0]
    drawn[51:300] = drawn[0] ^ (1 << np.random.default_rng(2).integers(0, 16, (249, 4))).astype(np.uint16)
    index = mih.Index(drawn)
    for reach in (0, 1, 3):
        differ = mih.values_within(reach)
        for q in drawn[:10]:
            found, apart = index.probe(q, differ), mih.POPCOUNT[drawn ^ q]
            assert set(np.flatnonzero(apart.sum(1, dtype=int) <= 4 * (reach + 1) - 1)) <= set(found)
            assert (found == np.flatnonzero((apart <= reach).any(1))).all()


def test_mih_probes_few_rows():
    """Vectors around centres: at most a fifth of the rows are probed, and nine in ten true neighbours found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(100, 48))[rng.integers(0, 100, 8000)] + 0.9 * rng.normal(size=(8000, 48))
    codes = mih.learn(x[:3000], float(np.linalg.norm(x, axis=1).max()))
    index, differ = mih.Index(codes.code(x, False)), mih.values_within(codes.reach)
    hits = probed = 0
    for q in range(0, 8000, 160):
        found = index.probe(codes.code(x[q : q + 1], True)[0], differ)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(found))
        probed += len(found)
    assert hits >= 0.9 * 50 * 20 and probed <= 0.2 * 50 * 8000


def test_mih_query_is_brute_force(spark, sf):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids, got = np.array(sorted(x)), {}
    for r in mih.op3_multi_index_hashing(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    all_of = np.stack([x[i] for i in ids])
    hits = 0
    for q in got:
        s = all_of @ x[q]
        s[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert set(got) == {i for i in x if i % 20 == 0} and hits >= 0.9 * 20 * len(got)


def test_mih_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, []), (None, [1.0, 1.0]), (9, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mih.nearest_vectors(df, nearest=5).collect())
    assert got == [(1, 1, 9, 5.0), (1, 2, 7, 1.0), (7, 1, 9, 5.0), (7, 2, 1, 1.0), (9, 1, 1, 5.0), (9, 2, 7, 5.0)]
    uneven = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [1.0, 1.0, 9.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mih.nearest_vectors(uneven, nearest=5).collect())
    assert got == [(1, 1, 2, 3.0), (1, 2, 3, 3.0), (2, 1, 1, 3.0), (2, 2, 3, 3.0), (3, 1, 1, 3.0), (3, 2, 2, 3.0)]
    assert mih.nearest_vectors(df.limit(0)).count() == 0


def test_rake_fits_the_margins():
    rng = np.random.default_rng(2)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    tokens = rng.integers(100, 5000, len(codes)).astype(float)
    shares = [np.full(4, 0.25), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    w, fitted = mixing.rake(codes, tokens, shares)
    assert fitted and (w >= 0).all() and (w <= 1).all()
    for d, s in enumerate(shares):
        sums = np.bincount(codes[:, d], w * tokens)
        assert np.abs(sums / sums.sum() - s).max() < 5e-3


def test_mixing(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs)
    sums = {r["__lang"]: (r["all"], r["got"]) for r in rows.groupBy("__lang").agg(F.sum("__tokens").alias("all"), F.sum(F.when(F.col("__selected"), F.col("__tokens")).otherwise(0)).alias("got")).collect()}
    share = {k: v[0] ** 0.8 for k, v in sums.items()}
    whole, got = sum(share.values()), sum(v[1] for v in sums.values())
    assert all(abs(v[1] / got - share[k] / whole) < 0.04 for k, v in sums.items()) and rows.count() == docs.count()


def test_mixing_over_frames_is_mixing_on_the_driver(spark, sf):
    rows = mixing.weighed(spark.read.parquet(f"{sf}/documents.parquet"))
    few, a, fits = mixing.probabilities(rows)
    many, b, fits_too = mixing.probabilities(rows, max_cells=1)
    assert a and not b and fits == fits_too
    x = {tuple(r[d] for d in mixing.DIMENSIONS): r["w"] for r in few.collect()}
    y = {tuple(r[d] for d in mixing.DIMENSIONS): r["w"] for r in many.collect()}
    assert x.keys() == y.keys() and np.median([abs(x[k] - y[k]) for k in x]) < 0.05


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "en", "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s"), (None, "a | b", "de", "t")], "doc_id bigint, text string, lang string, source string").withColumn("weight", F.lit(0))
    assert mixing.mix(docs).count() == 5 and mixing.keep_drawn(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = mixing.keep_drawn(docs, targets={"source": {"s": 1.0}, "lang": {"en": 1.0}, "topic": {"general": 1.0}}).collect()
    assert {r["source"] for r in kept} == {"s"}


def test_mixing_tells_what_does_not_fit(spark):
    """Margins that contradict one another, with columns that are named as the operator's own."""
    docs = spark.createDataFrame([(i, "a b c", *(("s", "x") if i % 2 else ("t", "y")), "mine", 4) for i in range(40)], "doc_id bigint, text string, source string, lang string, __topic string, __tokens int")
    plain = docs.drop("__topic", "__tokens")
    targets = {"source": {"s": 0.9, "t": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    assert {r["__fitted"] for r in mixing.mix(plain, targets=targets).collect()} == {False}
    assert {r["__fitted"] for r in mixing.mix(plain, targets={"source": {"s": 0.5, "t": 0.5}}).collect()} == {True}
    kept = mixing.keep_drawn(docs)
    assert kept.columns == docs.columns and {(r["__topic"], r["__tokens"]) for r in kept.collect()} == {("mine", 4)}


def test_mixing_query_is_brute_force(spark, sf):
    """The query's weights are those of raking the whole table's cells one after another, and its draws those of the hash."""
    got = mixing.op5_mixing_ipf(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r["n_tokens"] == len((docs[r["doc_id"]]["text"] or "").split()) for r in got if (docs[r["doc_id"]]["text"] or "").isascii())
    cells = {}
    for r in got:
        cells.setdefault((r["source"], r["lang"], r["topic"]), [0, r["weight"]])[0] += r["n_tokens"]
    total = sum(n * w for n, w in cells.values())
    for d, name in enumerate(mixing.DIMENSIONS):
        own, now = {}, {}
        for key, (n, w) in cells.items():
            own[key[d]] = own.get(key[d], 0) + n
            now[key[d]] = now.get(key[d], 0) + n * w
        share = {k: v ** mixing.TEMPER[name] for k, v in own.items()}
        whole = sum(share.values())
        assert all(abs(now[k] / total - share[k] / whole) < 3e-3 for k in own), name
    assert all(r["fitted"] for r in got)
    u = lambda i: int(hashlib.md5(f"mixing:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
    assert all(r["selected"] == (u(r["doc_id"]) < r["weight"]) for r in got)


def test_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=400_000, fanout=3, smallest=1000)
    df = spark.range(9000).withColumn("x", F.sha2(F.col("id").cast("string"), 256))
    for i in range(7):
        store.append(df.filter(F.col("id") % 7 == i).repartition(3))
        store.compact(df.schema)
    assert sorted(r["id"] for r in store.read().collect()) == list(range(9000))
    assert len(store.runs()) < 7 and store.read(1).count() == df.filter("id % 7 = 0").count()
    before = {f["path"] for r in store.runs() for f in r.files}
    store.append(df.limit(0))
    assert store.expire() > 0 and store.read().count() == 9000 and before == {f["path"] for r in store.runs() for f in r.files}


def test_shards_conflict(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.read(schema=spark.range(1).schema).count() == 0
    store.append(spark.range(3))
    with pytest.raises(sharding.Conflict):
        store.commit(0, [])
    assert store.version() == 1 and store.read().count() == 3


def test_shards_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 300_000)], "doc_id bigint, text string").withColumn("path", F.lit("clash"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    sharding.deal(store, docs, 3)
    assert store.read().count() == 4


def test_shards_of_an_empty_table(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.deal(store, empty, 3) == 0 and store.read(schema=empty.schema).count() == 0


def test_shards_query_is_brute_force(spark, sf):
    """Every document lies in one shard of the last version, and the shards' rows and bytes are those told."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.op6_size_tiered_shards(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    shards = {}
    for r in got:
        shards.setdefault((r["run"], r["shard"], r["shard_rows"], r["shard_bytes"]), []).append(r["doc_id"])
    assert len({k[:2] for k in shards}) == len(shards) and all(k[2] == len(v) and k[3] > 0 for k, v in shards.items())
    assert len({k[0] for k in shards}) < sharding.ARRIVALS


ODD_DOCS = [(1, None, "en", "s"), (2, "", None, "s"), (3, " \n", "en", None), (4, "word " * 30_000, "en", "s"), (None, "no id " * 10, "en", "s"), (5, "same text here again", "en", "s"), (5, "same text here again", "en", "s"), (6, "same text here again", "de", "t")]


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_on_odd_tables(spark, sf, at):
    """Nulls, empty and long texts, repeated rows, ties, columns of clashing names, and an empty table."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.createDataFrame(ODD_DOCS, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for made in ("score", "__score", "class_id", "__tokens", "key", "id"):
        docs = docs.withColumn(made, F.lit("clash"))
    got = stage(spark, docs, sf)
    if at < 4:
        assert got.columns == docs.columns and all(r["__score"] == "clash" for r in got.collect()), name
        assert {(r["doc_id"], r["text"]) for r in got.collect()} <= {(i, t) for i, t, *_ in ODD_DOCS}
    else:
        assert got.count() == len(ODD_DOCS)
    assert stage(spark, docs.limit(0), sf).count() == 0
    if at == 2:
        assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 1, 2, 3, 4, 5]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:2]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and 0 < got.count() < docs.count(), name
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_mixing_over_frames_has_the_drivers_rounds(spark, monkeypatch):
    """Equal weights after few rounds, and 1 on tables without tokens."""
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.04)
    monkeypatch.setattr(mixing, "SHRINK", 0.7)
    monkeypatch.setattr(mixing, "SHRINKS", 3)
    counts = [("a", "x", 90), ("a", "y", 5), ("b", "x", 5), ("b", "y", 60)]
    docs = spark.createDataFrame([(i, "w " * n, s, g, "t") for i, (s, g, n) in enumerate(counts)], "doc_id bigint, text string, source string, lang string, topic string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.45, "y": 0.55}, "topic": {"t": 1.0}}
    for table, told in ((docs, targets), (docs.withColumn("text", F.lit("")), None)):
        rows = mixing.weighed(table)
        (few, a, _), (many, b, _) = mixing.probabilities(rows, targets=told), mixing.probabilities(rows, targets=told, max_cells=1)
        x, y = ({tuple(r[d] for d in mixing.DIMENSIONS): r["w"] for r in f.collect()} for f in (few, many))
        assert a and not b and x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x)
        if told is None:
            assert set(x.values()) == {1.0}


def test_large_bucket_tells_links_not_pairs(spark):
    """A bucket of texts that are all alike, and of unlike ones that only words can tell apart, in several blocks: fewer links than rows."""
    base, n = [f"w{i}" for i in range(60)], neardup.ALIGNED + 40
    texts = [(i, " ".join([*base[: i % 50], f"x{i}", *base[i % 50 + 1 :]])) for i in range(n)]
    texts += [(1000 + i, " ".join(base[:40] + [f"y{i}x{j}" for j in range(20)])) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bags = neardup.signatures(docs).select(F.col("doc_id").alias("id"), "size", "bag")
    both = bags.select("id").join(spark.createDataFrame([(1,), (2,)], "bucket bigint"))
    rows = both.withColumn("comp", F.col("id")).withColumn("n", F.lit(len(texts)).cast("bigint"))
    links = [(r["a"], r["b"]) for r in neardup.large_links(rows, bags, docs, neardup.SIMILARITY).collect()]
    assert all(b < 1000 for _, b in links) and len(links) < 4 * n
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root) == {0}


def test_pairs_meet_in_their_least_bucket():
    early = neardup.met_before(5, [np.array([3, 5, 9]), np.array([5, 9, 3]), np.array([5, 9]), np.array([4, 5])])
    assert early[0, 1] and early[1, 0] and not early[0, 2] and not early[0, 3] and not early[2, 3]
    rng = np.random.default_rng(1)
    words = [rng.integers(1, 1 << 60, 50, dtype=np.uint64) for _ in range(3)]
    own = [words[0], words[0].copy(), words[0].copy(), words[1], words[2]]
    own[1][:5], own[2][5:10] = words[1][:5], words[1][5:10]
    ids, part, none = np.array([4, 7, 2, 9, 11]), np.zeros(5, int), np.zeros((5, 5), bool)
    assert len(neardup.links_in(ids, ids, own, part, none, 0.8)) == 2
    none[:3, :3] = True
    assert neardup.links_in(ids, ids, own, part, none, 0.8) == []


def test_rows_in_blocks_grow_with_the_bucket(spark):
    """One component of 2,000 rows and five rows beside it, in twelve buckets: a row is in about one block;
    each two rows of unlike components meet. Where no component is large, each two meet all the same."""
    def pairs(t: pa.Table) -> pa.RecordBatch:
        ids, comp, part = (t.column(n).to_pylist() for n in ("id", "comp", "part"))
        out = {(t.column("bucket")[0].as_py(), min(i, j), max(i, j)) for i, c, p in zip(ids, comp, part) for j, d, q in zip(ids, comp, part) if c != d and (p != q or not any(part))}
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["bucket", "a", "b"])

    def all_rows(t: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([t.column("id").combine_chunks()], names=["id"])

    main = spark.range(12).selectExpr("id AS bucket").crossJoin(spark.range(2_005).selectExpr("id", "if(id < 2000, 0, id) AS comp", "2005L AS n"))
    assert neardup.by_block(main, 64, all_rows, "id bigint").count() < 1.3 * 12 * 2_005
    some = spark.range(150).selectExpr("0L AS bucket", "id", "cast(if(id < 70, 0, id div 2) AS bigint) AS comp", "150L AS n").unionByName(spark.range(40).selectExpr("1L AS bucket", "id", "id AS comp", "40L AS n"))
    got = sorted(tuple(r) for r in neardup.by_block(some, 16, pairs, "bucket bigint, a bigint, b bigint").distinct().collect())
    comp = [0 if i < 70 else i // 2 for i in range(150)]
    assert got == [(0, i, j) for i in range(150) for j in range(i + 1, 150) if comp[i] != comp[j]] + [(1, i, j) for i in range(40) for j in range(i + 1, 40)]


def test_buckets_of_one_main_component_are_dealt_once(spark, monkeypatch):
    """Thirty buckets of the same sixty texts: each id is dealt in few blocks, not in each bucket. Of texts in unlike buckets none meet."""
    sizes, dealt = [], neardup.in_cells

    def counted(rows):
        out = dealt(rows)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup, "in_cells", counted)
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)], "doc_id bigint, text string")
    bags = neardup.signatures(docs).select(F.col("doc_id").alias("id"), "size", "bag")
    # One component and ten texts beside it; the same where each bucket holds two of the ten.
    rows = spark.sql("SELECT b.id AS bucket, i.id, if(i.id < 50, 0, i.id) AS comp, 60L AS n FROM range(30) b CROSS JOIN range(60) i")
    for few, buckets in ((rows, 30), (rows.filter("id < 50 OR id % 5 = bucket % 5"), 30), (rows.filter("id < 50 OR id % 5 = bucket AND bucket < 3"), 3)):
        sizes.clear()
        links = neardup.large_links(few, bags, docs, neardup.SIMILARITY).collect()
        assert len(sizes) == 2 and max(sizes) <= 60
        joined = {x for r in links for x in (r["a"], r["b"]) if x >= 50}
        assert joined == {i for i in range(50, 60) if buckets == 30 or i % 5 < 3}
    # Texts that share no bucket are not looked at, though their buckets are merged.
    apart = rows.filter("id < 25 AND bucket = 0 OR id >= 25 AND id < 50 AND bucket = 1 OR id = 50 AND bucket = 0 OR id = 51 AND bucket = 1")
    links = neardup.large_links(apart, bags, docs, neardup.SIMILARITY).collect()
    assert sorted((r["a"] // 25, r["b"]) for r in links) == [(0, 50), (1, 51)]


def test_buckets_are_merged_where_that_makes_fewer_rows(spark):
    """Buckets of one main component whose rows are all others make more rows in blocks together than apart."""
    rows = spark.sql("SELECT b.id AS bucket, 100 * b.id + i.id AS id, if(i.id < 50, -1, 100 * b.id + i.id) AS comp FROM range(20) b CROSS JOIN range(60) i")
    other = spark.sql("SELECT 100 + b.id AS bucket, 9000 + i.id AS id, if(i.id < 50, -2, 9000 + i.id) AS comp FROM range(20) b CROSS JOIN range(60) i")
    like = spark.sql("SELECT 200 AS bucket, 9900 + id AS id, -3 AS comp FROM range(60)")
    got = neardup.merged(rows.unionByName(other).unionByName(like), 64).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in got} == {b: 60 for b in [*range(20), 100]}
