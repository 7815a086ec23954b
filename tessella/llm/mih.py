"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, projected on learned axes and turned by learned rotations
(iterative quantisation from unlike starts), a bit for each sign. A code is cut into substrings of
16 bits, and each substring is an index of its own: the rows in order of its value, with where each
value's bucket begins. By the pigeonhole principle a code within Hamming radius
substrings * (reach + 1) - 1 of a query's has a substring within `reach` of the query's; so probing,
in every index, the buckets of all values within reach finds every code within that radius. What
the buckets hold is ranked by its exact inner products. How many substrings and what reach find
COVERED of the true neighbours with the fewest rows probed is learned from a sample.

For inner products of vectors of unlike length, one more coordinate makes all candidates equally
long before they are coded, so that the largest product is the smallest angle.

Each row lies in one block, of bounded size, with indexes of its own; the queries go to every block
and stream past its indexes. A query finds the same rows however many blocks there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, table, unit_hash

NEAREST = 20
SUBSTRING = 16
MOST_SUBSTRINGS = 128
#: Vectors that the codes are learned from, picked by a hash of the id; every row is indexed.
SAMPLE = 12_000
SAMPLE_QUERIES, SAMPLE_TURNED, SAMPLE_PROBED = 200, 2_000, 2_000
#: Share of the sample's true neighbours that probing must find. Those in the whole table are nearer, so more of them are found.
COVERED = 0.93
#: Rows of a block: as few as keep all cores busy, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 4096, 1 << 17


def _popcounts() -> np.ndarray:
    n = np.zeros(1 << SUBSTRING, np.uint8)
    for i in range(SUBSTRING):
        n += ((np.arange(1 << SUBSTRING) >> i) & 1).astype(np.uint8)
    return n


POPCOUNT = _popcounts()


class Codes:
    """How vectors are coded (longest of the candidates, centre, axes with rotations) and probed (substrings, reach)."""

    def __init__(self, longest: float, centre: np.ndarray, axes: np.ndarray):
        self.longest, self.centre, self.axes = longest, centre, axes
        self.substrings, self.reach = 1, SUBSTRING

    @property
    def radius(self) -> int:
        """Every code within it is found."""
        return self.substrings * (self.reach + 1) - 1

    def raised(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return np.concatenate([x, np.zeros((len(x), 1))], 1)
        x = x / max(self.longest, 1e-300)
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))], 1)

    def code(self, x: np.ndarray, query: bool) -> np.ndarray:
        """[row, substring] of 16 bits each."""
        axes = self.axes[:, : self.substrings * SUBSTRING]
        bits = (self.raised(x, query) - self.centre) @ axes > 0
        return np.packbits(bits.reshape(len(bits), -1, SUBSTRING), axis=2).reshape(len(bits), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


def learn(sample: np.ndarray, longest: float, nearest: int = NEAREST, seed: int = 11) -> Codes:
    codes = Codes(longest, np.zeros(1), np.zeros((1, 1)))
    x = codes.raised(sample, False)
    codes.centre = x.mean(0)
    x = x - codes.centre
    values, vectors = np.linalg.eigh(x.T @ x / max(len(x), 1))
    axes = vectors[:, values > max(values.max(), 0) * 1e-6][:, ::-1]
    if not axes.shape[1]:
        axes = np.eye(x.shape[1])
    flat = x[:SAMPLE_TURNED] @ axes
    rng = np.random.default_rng(seed)
    turned = []
    for _ in range(-(-MOST_SUBSTRINGS * SUBSTRING // axes.shape[1])):
        r = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(3):
            u, _, v = np.linalg.svd(np.sign(flat @ r).T @ flat)
            r = (u @ v).T
        turned.append(axes @ r)
    codes.axes = np.concatenate(turned, 1)[:, : MOST_SUBSTRINGS * SUBSTRING]
    codes.substrings = MOST_SUBSTRINGS
    q = sample[: min(SAMPLE_QUERIES, len(sample))]
    products = q @ sample.T
    products[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-products, 1)[:, : min(nearest, max(len(sample) - 1, 1))]
    a, b = codes.code(q, True), codes.code(sample, False)
    near = POPCOUNT[a[:, None, :] ^ b[true]].reshape(-1, MOST_SUBSTRINGS)
    far = POPCOUNT[a[:50, None, :] ^ b[None, :SAMPLE_PROBED]].reshape(-1, MOST_SUBSTRINGS)
    best = (2.0, 1, SUBSTRING)
    for reach in range(SUBSTRING // 3):
        found = np.logical_or.accumulate(near <= reach, 1).mean(0)
        m = int((found < COVERED).sum()) + 1
        if m <= MOST_SUBSTRINGS:
            best = min(best, (float((far[:, :m] <= reach).any(1).mean()), m, reach))
    codes.substrings, codes.reach = best[1:]
    return codes


def values_within(reach: int) -> np.ndarray:
    """What a substring may differ by: all numbers of SUBSTRING bits with at most `reach` set."""
    return np.flatnonzero(POPCOUNT <= reach).astype(np.uint16)


class Index:
    """The substring indexes of a block of codes."""

    def __init__(self, codes: np.ndarray):
        n, m = codes.shape
        self.n, self.m = n, m
        self.rows = np.concatenate([np.argsort(codes[:, s], kind="stable") for s in range(m)]).astype(np.int32)
        self.starts = np.stack([np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << SUBSTRING))]) + s * n for s in range(m)]).astype(np.int64)

    def probe(self, code: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """The rows in the buckets of every value that differs from the code's by one of the numbers, in any substring."""
        values = (code[:, None] ^ differ).astype(np.int64)
        sub = np.arange(self.m)[:, None]
        lo, hi = self.starts[sub, values].ravel(), self.starts[sub, values + 1].ravel()
        held = hi > lo
        lo, size = lo[held], (hi - lo)[held]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        hit = np.zeros(self.n, bool)
        hit[self.rows[at]] = True
        return np.flatnonzero(hit)


class Block:
    """A block of candidates that queries stream past."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, nearest: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes, self.nearest = ids[order], codes, nearest
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.rough = (vectors[order] / codes.longest).astype(np.float32)
        #: What the rough product of unit lengths may be wrong by.
        self.wrong = 4.0 * vectors.shape[1] * 2.0**-23
        self.index = Index(codes.code(vectors[order], False))
        self.differ = values_within(codes.reach)

    def search(self, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id, score of each query's nearest in the block."""
        coded = self.codes.code(q, True)
        out = []
        for i in range(len(q)):
            found = self.index.probe(coded[i], self.differ)
            found = found[self.ids[found] != q_ids[i]]
            if len(found) < self.nearest:  # too few to choose from: all rows are within a reach of all bits
                found = np.flatnonzero(self.ids != q_ids[i])
            if len(found) > 4 * self.nearest:
                rough = self.rough[found] @ (q[i] / np.linalg.norm(q[i])).astype(np.float32)
                found = found[rough >= np.partition(rough, -self.nearest)[-self.nearest] - self.wrong]
            score = np.zeros(len(found))
            for d in range(len(self.columns)):  # one coordinate after another, so that equal vectors get equal sums
                score += self.columns[d, found] * q[i, d]
            best = np.lexsort((self.ids[found], -score))[: self.nearest]
            out.append((np.full(len(best), q_ids[i]), self.ids[found][best], score[best]))
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, float)))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows whose vector takes part, as doubles; equal rows once. Vectors that are null,
    empty or zero or hold null or non-finite components don't, nor do rows without an id."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False))).distinct()


def nearest_vectors(df: DataFrame, queries: DataFrame | None = None, nearest: int = NEAREST, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest candidates by inner product, nearest first,
    ties to the smaller id. queries (rows of df's form) are all rows by default; a candidate with the
    query's id is left out. Components that a vector lacks beside longer ones count as 0; an id with
    several vectors is as near as its nearest; an empty table gives no rows."""
    spark = df.sparkSession
    base = cut(usable(df, key, vector))
    asked = base if queries is None else usable(queries, key, vector)
    told = base.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    if not told["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = told["n"]
    dim = max(told["d"], asked.agg(F.max(F.size("v"))).first()[0] or 0)
    wide = lambda rows: rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))).alias("v"))
    base, asked = wide(base), wide(asked)
    drawn = base.filter(unit_hash(F.col("vec_id"), "mih") < sample / n).collect()
    codes = learn(np.array([r["v"] for r in sorted(drawn)] or [[1.0] * dim], float), told["longest"], nearest)
    sent = spark.sparkContext.broadcast(codes)
    size = min(max(-(-n // (4 * spark.sparkContext.defaultParallelism)), LEAST_BLOCK), MOST_BLOCK)
    blocks = -(-n // size)
    left = base.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches):
        told, now, block, ids, vectors = sent.value, None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, asks, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(-1, dim)
            turns = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(numbers)], strict=True):
                if numbers[lo] != now:
                    now, block, ids, vectors = numbers[lo], None, [], []
                if not asks[lo]:
                    ids.append(own[lo:hi])
                    vectors.append(x[lo:hi])
                elif ids:
                    if block is None:
                        block = Block(np.concatenate(ids), np.concatenate(vectors), told, nearest)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in block.search(own[lo:hi], x[lo:hi])], names=["query_id", "vec_id", "score"])

    # A block's candidates come before the queries.
    found = left.unionByName(right).repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # An id with several vectors may meet a candidate more than once; its best counts.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_vectors(rows, rows.filter("vec_id % 20 = 0"))
