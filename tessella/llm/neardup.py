"""Near-duplicates by order MinHash, verified by banded alignment.

A text's words (lower-cased runs of letters and digits) are labelled with their occurrence numbers.
Each of SKETCHES hash functions picks the PICKS least labelled words (k-mers of K words in general);
put in the order they have in the text, they are one value of the text's sketch, so a value is six
words in text order. Two texts agree in a value with a chance that falls with their edit distance,
as both the words and their order count. Texts that agree in a value are candidates; a link is a
pair whose word edit distance, found by a banded alignment, is at most (1 - SIMILARITY) of the
longer text. Classes are the connected components of the links.

One-word k-mers with six picks, not longer k-mers with fewer: an edit spoils one word but K k-mers,
and the order of six picks tells unlike texts apart as well as the order inside longer k-mers does.

Copies. Texts with the same words are one node from the start, so copies are never paired.

Short texts. Two texts within m edits, of n words the longer, have n - m words in common. With the
words of each in one order for all texts (rare ones first), they share one of the first m + 1; a
text of up to SHORT words is put under these too, so no pair of such texts is lost, wherever the
edits lie.

Buckets. One bucket in FIRST links most classes: all pairs of a bucket of up to PAIRED nodes, in a
larger one each node with the least of its part and those with the bucket's least. That is only an
order of work, no cap: then every two nodes of unlike classes that share any value are compared.
Pairs whose lengths or word counts alone ask for too many edits are left out before any words are
fetched, which loses none. In a large bucket no list of pairs is made, as that grows with the square of the bucket: the bucket is
dealt in blocks, a block first tells which of its rows have a pair that may be similar, then gets the words of those, aligns the
pairs inside and tells links only, at most one less than it has rows. A pair that meets in several buckets is looked at in the least of
them, so a row is told in few. Rows of the bucket's main component are dealt in parts that meet the other rows, not one another: rows in
blocks grow with the bucket, times the parts (of BLOCK rows) that the rows outside its main component fill. Large buckets of one main
component are merged first, which holds each id once, where that makes fewer rows in blocks; only pairs that share a bucket are looked at.
Large buckets are dealt over tasks by (bucket, part) in every step: joins, stars and blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components
from ..tables import release, small
from .common import cut, free_name, map_text, table

K = 1
SIMILARITY = 0.8
SKETCHES = 80
PICKS = 6
#: Buckets of up to so many rows make their pairs in one row, larger ones in blocks.
PAIRED = 6
#: A bucket of more than PART rows is dealt over tasks. On tables of more than PART * MOST_LARGE rows it is more than a MOST_LARGE-th
#: of them, so that there are never more than MOST_LARGE such buckets to tell the tasks.
PART, MOST_LARGE = 256, 10_000
#: Ids that are broadcast to pick texts by, some tens of MB; more are joined by shuffling.
MOST_IDS = 1_000_000
#: Rows of a large bucket that are dealt together, the same with their words, and hash values that words are counted by.
BLOCK, ALIGNED, DIMS = 512, 128, 128
#: One bucket in so many is looked at first.
FIRST = 10
#: Texts of up to so many words are also sought by words, which finds all their pairs.
SHORT = 40
#: Hash values that the words of short texts are counted by.
COUNTED = 1 << 14
#: Bytes kept of a word's hash: two words of a pair of texts are taken for one with a chance of about 1 in 10 ** 9.
WORD_BYTES = 6
CACHE_WORDS = 300_000
CHUNK = 4096
WORD = re.compile(r"[^\W_]+")
_odd = np.random.default_rng(20240607).integers(1, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes of words that don't depend on the process; the latest are kept."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode())
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def kmers(h: np.ndarray) -> np.ndarray:
    """A hash for each k-mer in text order; one for the whole of a shorter text."""
    k = min(K, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out + h[i : i + n] + _GOLD)
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """The SKETCHES values of a text with the given word hashes; none for a text without a word."""
    if not len(h):
        return np.zeros(0, np.int64)
    own = kmers(h) if K > 1 else h
    order = np.argsort(own, kind="stable")
    run = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    first = np.maximum.accumulate(np.where(run, np.arange(len(own)), 0))
    label = np.empty(len(own), np.uint64)
    label[order] = (np.arange(len(own)) - first).astype(np.uint64)
    labelled = mixed(own + label * _GOLD)
    rows, most = np.arange(SKETCHES), np.iinfo(np.uint64).max
    picks = min(PICKS, len(own))
    best, place = np.zeros((SKETCHES, 0), np.uint64), np.zeros((SKETCHES, 0), np.int64)
    for lo in range(0, len(own), CHUNK):
        values = _odd[:, None] * labelled[lo : lo + CHUNK]
        least, where = [], []
        for _ in range(min(picks, values.shape[1])):
            i = values.argmin(1)
            least.append(values[rows, i])
            where.append(i + lo)
            values[rows, i] = most
        best, place = np.concatenate([best, np.stack(least, 1)], 1), np.concatenate([place, np.stack(where, 1)], 1)
        if lo:
            kept = np.argsort(best, 1, kind="stable")[:, :picks]
            best, place = np.take_along_axis(best, kept, 1), np.take_along_axis(place, kept, 1)
    place.sort(1)
    out = rows.astype(np.uint64)
    for p in range(picks):
        out = mixed(out * _GOLD + own[place[:, p]])
    return out.view(np.int64)


def pack(h: np.ndarray) -> bytes:
    """Word hashes as numbers of WORD_BYTES bytes."""
    return np.ascontiguousarray(h).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").ravel()


def bag_of(h: np.ndarray) -> bytes:
    """How many words, and how many pairs of neighbouring words, fall on each of DIMS hash values; 255 for more."""
    pairs = mixed(h[:-1] * _GOLD + h[1:])
    return np.minimum(np.concatenate([np.bincount((x % np.uint64(DIMS)).astype(np.int64), minlength=DIMS) for x in (h, pairs)]), 255).astype(np.uint8).tobytes()


def key_of(text: str | None, words: list[str]) -> bytes | None:
    """Equal for texts with the same words; for texts without a word, for equal texts; null for null."""
    return None if text is None else xxhash.xxh3_128_digest(b"w" + " ".join(words).encode() if words else b"t" + text.encode("utf-8", "replace"))


def keyed(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with `key`, as signatures() has it."""
    return map_text(df, lambda: lambda texts: {"key": pa.array([key_of(t, WORD.findall((t or "").lower())) for t in texts], pa.binary())}, "key binary", text, keep)


def signatures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with `key`, their key_of(), `sketch` (empty without a word), `size` (the number of words),
    `short` (their packed hashes, of texts of up to SHORT words) and `bag`, their bag_of()."""

    def make():
        words = Words()

        def work(texts: list) -> dict:
            keys, sketches, ends, sizes, short, bags = [], [], [0], [], [], []
            for t in texts:
                own = WORD.findall((t or "").lower())
                keys.append(key_of(t, own))
                h = words.hashes(own)
                sketches.append(sketch(h))
                sizes.append(len(own))
                short.append(pack(h) if len(own) <= SHORT else None)
                bags.append(bag_of(h))
                ends.append(ends[-1] + len(sketches[-1]))
            flat = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64))
            return {"key": pa.array(keys, pa.binary()), "sketch": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), "size": pa.array(sizes, pa.int32()), "short": pa.array(short, pa.binary()), "bag": pa.array(bags, pa.binary())}

        return work

    return map_text(df, make, "key binary, sketch array<bigint>, size int, short binary, bag binary", text, keep)


def packed(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Kept columns with `words`, the text's word hashes, packed."""

    def make():
        words = Words()
        return lambda texts: {"words": [pack(words.hashes(WORD.findall((t or "").lower()))) for t in texts]}

    return map_text(df, make, "words binary", text, keep)


def bounded_distance(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences if it is at most `most`, else something larger.

    A banded alignment: only cells within `most` of the diagonal are looked at, a row of them at a
    time as the bits of two integers (which steps down a column of the band add or take 1).
    """
    if len(a) < len(b):
        a, b = b, a
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m, n = len(a), len(b)
    if not n:
        return m
    if m - n > most:
        return most + 1
    if m <= most:
        most = m - 1
        if most < m - n:
            return m
    width = 2 * most + 1
    full = (1 << width) - 1
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    up, down = full & ~((1 << most) - 1), 0
    distance, top = most, 1 << 2 * most
    for i, x in enumerate(b):
        hits = at.get(x, 0)
        hits = (hits >> (i - most) if i >= most else hits << (most - i)) & full
        level = (((hits & up) + up) ^ up | hits | down) & full
        right_up = down | full & ~(level | up)
        right_down = level & up
        if i + most < m:
            distance += not level & top
        else:
            bit = 1 << (m - 1 - i + most)
            distance += bool(right_up & bit) - bool(right_down & bit)
        level >>= 1
        up = right_down | full & ~(level | right_up)
        down = level & right_up
    return distance


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance of two arrays of word hashes is at most 1 - similarity of the longer one's length."""
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    if longest - min(len(a), len(b)) > most:
        return False
    # Words that one side has more often than the other cost an edit each.
    both = np.concatenate([a, b])
    _, back = np.unique(both, return_inverse=True)
    size = back.max() + 1 if len(back) else 1
    common = np.minimum(np.bincount(back[: len(a)], minlength=size), np.bincount(back[len(a) :], minlength=size)).sum()
    if longest - common > most:
        return False
    return bounded_distance(back[: len(a)].tolist(), back[len(a) :].tolist(), most) <= most


def ids_of(pairs: DataFrame) -> DataFrame:
    """(id) of the ends of pairs(a, b)."""
    return small(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), MOST_IDS)


def words_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) of docs(doc_id, text) whose ids are in small(ids): each text of an id once. Where the ids are few, no text is shuffled."""
    words = packed(docs.withColumnRenamed("doc_id", "id").filter("text IS NOT NULL").join(ids, "id", "left_semi"))
    # Dealt by id alone, so that the joins by id need no further shuffle.
    return cut(words).repartition("id").dropDuplicates(["id", "words"])


def screened(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but for those that by their lengths and bags(id, size, bag) cannot be similar."""
    pairs = cut(pairs)
    bags = bags.join(ids_of(pairs), "id", "left_semi")
    side = lambda n: bags.select(F.col("id").alias(n), F.col("size").alias(f"n{n}"), F.col("bag").alias(f"w{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "wa", "wb")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                size = np.concatenate([batch.column(i).to_numpy() for i in (2, 3)]).astype(np.int64)
                bag = np.concatenate([np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 2 * DIMS) for i in (4, 5)])
                fine = possible(size, bag, np.arange(n), np.arange(n, 2 * n), similarity) >= 0
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fine))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of docs(doc_id, text) whose words align."""
    pairs = cut(pairs)
    words = words_of(docs, ids_of(pairs))
    left = words.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(batches):
        for batch in batches:
            wa, wb = batch.column(2), batch.column(3)
            mask = [similar(unpack(x.as_py()), unpack(y.as_py()), similarity) for x, y in zip(wa, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(mask, pa.bool_()))

    found = cut(both.mapInArrow(run, "a bigint, b bigint").distinct())
    del words, left, right, both
    release(docs.sparkSession)
    return found


def dealt_join(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows(bucket, id, ...) joined with sizes(bucket, n, ...), with `part`. Buckets of many rows are dealt in parts of about PART rows
    (more on a bucket beyond PART squared, so that it has as many parts as a part has rows), so that none is one task's work. Their number
    is a power of two, so that rows that meet in one bucket's part mostly meet in those of other buckets."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / F.greatest(F.lit(PART), F.sqrt("n"))))).cast("int")
    told = sizes.withColumn("parts", F.when(F.col("n") > max(PART, total / MOST_LARGE), parts).otherwise(1))
    large = F.broadcast(told.filter("parts > 1").select("bucket", F.col("parts").alias("into")))  # bounded: MOST_LARGE buckets
    dealt = rows.join(large, "bucket", "left").withColumn("part", F.when(F.col("into").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("into")).cast("int"))).drop("into")
    return dealt.join(told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), ["bucket", "part"])


def told(rows: DataFrame) -> DataFrame:
    """rows(bucket, id, comp, ...) of the buckets that hold unlike components, with n, the bucket's rows, its least row and its part."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "comp", "size")).alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return cut(dealt_join(rows, cut(sizes.select("bucket", "n", "least"))))


def ordered(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of unlike components whose lengths allow them to be similar."""
    unlike = pairs.filter("x.id <> y.id AND x.comp <> y.comp").filter(F.least("x.size", "y.size") >= F.lit(similarity - 1e-6) * F.greatest("x.size", "y.size"))
    return unlike.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def small_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of unlike components in the told() buckets of up to PAIRED rows."""
    few = rows.filter(F.col("n") <= PAIRED).groupBy("bucket").agg(F.sort_array(F.collect_set(F.struct("id", "comp", "size"))).alias("own"))  # bounded: PAIRED rows
    return ordered(few.select(F.explode(F.expr("flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> struct(x, y))))")).alias("p")).select("p.x", "p.y"), similarity)


def star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """In the larger told() buckets the pairs of each row with the least of its part, and of those with the bucket's least."""
    many, row = rows.filter(F.col("n") > PAIRED), F.struct("id", "comp", "size")
    centres = many.groupBy("bucket", "part").agg(F.min(row).alias("centre"), F.first("least").alias("least"))
    own = many.join(centres.select("bucket", "part", "centre"), ["bucket", "part"]).select(F.col("centre").alias("x"), row.alias("y"))
    return ordered(own.unionByName(centres.select(F.col("least").alias("x"), F.col("centre").alias("y"))), similarity)


def possible(size: np.ndarray, bag: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that a pair needs at least, by lengths and bags; -1 where that is more than similar() allows. Each edit changes the words of a
    bag by one either way, and the pairs by two."""
    least = np.empty(len(x), np.int64)
    for lo in range(0, len(x), CHUNK):
        i, j = x[lo : lo + CHUNK], y[lo : lo + CHUNK]
        off = bag[i].astype(np.int16) - bag[j]
        more, less = np.where(off > 0, off, 0).reshape(-1, 2, DIMS).sum(2), np.where(off < 0, -off, 0).reshape(-1, 2, DIMS).sum(2)
        each = np.maximum(more, less)
        least[lo : lo + CHUNK] = np.maximum(each[:, 0], (each[:, 1] + 1) // 2)
    longest = np.maximum(size[x], size[y])
    least = np.maximum(least, longest - np.minimum(size[x], size[y]))
    return np.where(least <= ((1 - similarity) * longest + 1e-9).astype(np.int64), least, -1)


def met(ids: np.ndarray, comp: np.ndarray, size: np.ndarray, bag: np.ndarray, part: np.ndarray, similarity: float, early: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block's rows that can be similar, of unlike components, as places of both and the edits they need at least.
    Rows of part 0 are compared with those of part 1, or with one another if there is no part 1; those in `early` are not."""
    order = np.lexsort((ids, size))
    ids, comp, size, bag, part = ids[order], comp[order], size[order], bag[order], part[order]
    across, xs, ys, bounds = bool(part.any()), [], [], []
    # Rows are in order of their lengths: those that a row can be similar to follow it closely.
    last = np.searchsorted(size, size / similarity + 1e-6, "right")
    for i in range(len(ids)):
        j = np.arange(i + 1, last[i])
        j = j[(comp[j] != comp[i]) & (ids[j] != ids[i])]
        if across:
            j = j[part[j] != part[i]]
        if early is not None:
            j = j[~early[order[i], order[j]]]
        if len(j):
            bound = possible(size, bag, np.full(len(j), i), j, similarity)
            fine = bound >= 0
            xs.append(np.full(fine.sum(), order[i]))
            ys.append(order[j[fine]])
            bounds.append(bound[fine])
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys, bounds))


def sharing(buckets: list[np.ndarray]) -> np.ndarray:
    """Which two rows share a bucket, by the buckets of each."""
    n = len(buckets)
    row, flat = np.repeat(np.arange(n), [len(x) for x in buckets]), np.concatenate(buckets)
    names, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    # A bucket of one row is shared with none.
    column, row = (np.cumsum(times > 1) - 1)[column[times[column] > 1]], row[times[column] > 1]
    names = names[times > 1]
    out = np.zeros((n, n), bool)
    for lo in range(0, len(names), CHUNK):
        own = (column >= lo) & (column < lo + CHUNK)
        held = np.zeros((n, min(CHUNK, len(names) - lo)), np.float32)
        held[row[own], column[own] - lo] = 1
        out |= held @ held.T > 0
    return out


def met_before(bucket: int, buckets: list[np.ndarray]) -> np.ndarray:
    """Which two rows of a block share a bucket less than its own, by the buckets of each."""
    return sharing([x[x < bucket] for x in buckets])


def links_in(ids: np.ndarray, comp: np.ndarray, words: list[np.ndarray], part: np.ndarray, early: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a block that join all components which its pairs join: the most promising pairs are aligned first, and none of one component."""
    size, bag = np.array([len(w) for w in words]), np.stack([np.frombuffer(bag_of(w), np.uint8) for w in words])
    x, y, bound = met(ids, comp, size, bag, part, similarity, early)
    root = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for at in np.argsort(bound, kind="stable").tolist():
        i, j = int(x[at]), int(y[at])
        p, q = top(int(comp[i])), top(int(comp[j]))
        if p != q and similar(words[i], words[j], similarity):
            root[p] = q
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def merged(rows: DataFrame, block: int) -> DataFrame:
    """rows(bucket, id, comp) of the buckets that hold unlike components, those of one main component as one bucket (under the least name) where
    that makes no more rows in blocks than they make apart. Each two rows that share a bucket still do; rows of merged ones may share no other."""
    counts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = counts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("most"))
    mains = cut(sizes.select("bucket", F.col("most.comp").alias("main"), F.col("most.k").alias("k"), (F.col("n") - F.col("most.k")).alias("m")).filter("m > 0"))
    parts = lambda k: F.ceil(F.col(k) / block)
    # As in_cells() deals k rows of a main component and m others.
    cost = F.when(F.col("k") + F.col("m") <= block, F.col("k") + F.col("m")).otherwise(F.col("k") * parts("m") + F.col("m") * (parts("k") + parts("m")))
    named = cut(rows.join(small(mains.select("bucket", "main"), MOST_IDS), "bucket"))
    once = cut(named.select("main", "id", "comp").distinct())
    inside = F.col("comp") == F.col("main")
    together = once.groupBy("main").agg(F.count(F.when(inside, 1)).alias("k"), F.count(F.when(~inside, 1)).alias("m")).select("main", cost.alias("together"))
    apart = mains.groupBy("main").agg(F.min("bucket").alias("least"), F.sum(cost).alias("apart"))
    chosen = small(cut(apart.join(together, "main").filter("together <= apart").select("main", "least")), MOST_IDS)
    return once.join(chosen, "main").select(F.col("least").alias("bucket"), "id", "comp").unionByName(named.join(chosen, "main", "left_anti").select("bucket", "id", "comp"))


def with_main(rows: DataFrame, block: int) -> DataFrame:
    """rows(bucket, id, comp) with what in_cells() deals a bucket of more than `block` rows by: the number of its components, its main one, that of
    most rows, and the parts that the rows of this one and all others fill; nulls in other buckets."""
    counts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = counts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter(F.col("n") > block)
    parts = lambda k: F.ceil(k / block).cast("int")
    large = sizes.select("bucket", "comps", F.col("main.comp").alias("main"), parts(F.col("main.k")).alias("into"), parts(F.col("n") - F.col("main.k")).alias("others")).filter("comps > 1")
    return rows.join(small(cut(large), MOST_IDS), "bucket", "left")


def in_cells(dealt: DataFrame) -> DataFrame:
    """with_main() rows with `cell`, the block that a row is in, and `part`, its side there.

    A bucket of up to the block's rows is one block. In a larger one the rows of its main component are never dealt to meet one another: they are
    dealt in parts of about as many rows, and so are all others; each part of the one meets each of the others, and each two parts of the others
    meet. So while the rows outside the main component fit a part, a row of it is in one block, however large the bucket.
    """
    inside = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(inside, F.col("into")).otherwise(F.col("others"))).cast("int")
    at = lambda kind, x, y, part: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), part.cast("int").alias("part"))
    each = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    across = each("into", lambda p: at(1, p, own, F.lit(1)))
    among = each("others", lambda p: at(2, F.least(own, p), F.greatest(own, p), own > p))
    cells = F.when(F.col("main").isNull(), F.array(at(0, F.lit(0), F.lit(0), F.lit(0))))
    cells = cells.when(inside, each("others", lambda p: at(1, own, p, F.lit(0)))).when(F.col("comps") > 2, F.concat(across, among)).otherwise(across)
    dealt = dealt.withColumn("to", F.explode(cells)).withColumn("cell", F.xxhash64("bucket", "to.kind", "to.x", "to.y")).withColumn("part", F.col("to.part"))
    return dealt.drop("to", "comps", "main", "into", "others")


def by_block(rows: DataFrame, block: int, work: Callable[[pa.Table], pa.RecordBatch], schema: str, beside: DataFrame | None = None) -> DataFrame:
    """What work() makes of each block of rows(bucket, id, comp), none of them twice, with the columns of beside(id, ...), if any, and `buckets`, all
    of the id's. Blocks are those of in_cells(): each is bounded, and each two rows of a bucket that are of unlike components meet in one. work() gets the
    rows with their part in the block. An id is joined once, then dealt to its buckets and blocks."""
    placed = F.struct("bucket", "comps", "main", "into", "others")
    of = with_main(rows, block).groupBy("id", "comp").agg(F.collect_set("bucket").alias("buckets"), F.collect_list(placed).alias("at"))  # bounded: the values of an id's texts
    both = (of if beside is None else of.join(beside, "id")).withColumn("at", F.explode("at"))
    dealt = in_cells(both.select(*[c for c in both.columns if c != "at"], "at.*"))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def made(t: pa.Table, edges: np.ndarray):
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = t.slice(lo, hi - lo)
                comp = own.column("comp").to_numpy()
                if (comp != comp[0]).any():
                    yield work(own)

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([*held, batch]).combine_chunks()
                cells = t.column("cell").to_numpy()
                # The last cell may go on in the next batch.
                edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1]).astype(int)
                yield from made(t, edges)
                held = t.slice(int(edges[-1])).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from made(t, np.array([0, t.num_rows]))

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def large_links(rows: DataFrame, bags: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all components which pairs in the told() buckets of more than PAIRED rows join.

    Two steps, each over blocks of the merged() buckets and each looking at a pair that shares a bucket in the least merged one that both are in:
    rows with a pair that may be similar are told, not pairs; then links, by the words of those rows.
    """

    def numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
        return [t.column(n).to_numpy() for n in names]

    def left(t: pa.Table) -> np.ndarray:
        """Pairs that meet in a lesser merged bucket, or share none of those before merging."""
        buckets, held = ([np.array(x, np.int64) for x in t.column(n).to_pylist()] for n in ("buckets", "held"))
        return met_before(t.column("bucket")[0].as_py(), buckets) | ~sharing(held)

    def concerned(t: pa.Table) -> pa.RecordBatch:
        ids, comp, size, part = numbers(t, "id", "comp", "size", "part")
        bag = np.frombuffer(b"".join(t.column("bag").to_pylist()), np.uint8).reshape(-1, 2 * DIMS)
        x, y, _ = met(ids, comp, size, bag, part, similarity, left(t))
        at = np.unique(np.concatenate([x, y]))
        return pa.RecordBatch.from_arrays([pa.array(v[at], pa.int64()) for v in (*numbers(t, "bucket"), ids, comp)], names=["bucket", "id", "comp"])

    def linked(t: pa.Table) -> pa.RecordBatch:
        ids, comp, part = numbers(t, "id", "comp", "part")
        out = links_in(ids, comp, [unpack(w) for w in t.column("words").to_pylist()], part, left(t), similarity)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    many = cut(rows.filter(F.col("n") > PAIRED).select("bucket", "id", "comp").distinct())
    held = cut(many.groupBy("id").agg(F.collect_set("bucket").alias("held")))  # bounded: the values of an id's texts
    some = cut(by_block(cut(merged(many, BLOCK)), BLOCK, concerned, "bucket bigint, id bigint, comp bigint", bags.join(held, "id")).distinct())
    release(docs.sparkSession)
    # A pair is told in its least bucket only, so that is also the least of those that its rows are told in.
    words = words_of(docs, small(cut(some.select("id").distinct()), MOST_IDS))
    found = cut(by_block(some, ALIGNED, linked, "a bigint, b bigint", words.join(held, "id")).distinct())
    del many, held, some, words
    release(docs.sparkSession)
    return found


def with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(id, ...) with comp, the component of each id by the links so far."""
    roots = small(components(links).select(F.col("node").alias("id"), "root"), MOST_IDS)
    return rows.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def short_buckets(nodes: DataFrame, similarity: float) -> DataFrame:
    """(bucket, id, size) of nodes(id, size, short) of texts of up to SHORT words: two of them that are similar share a bucket."""
    short = nodes.filter(F.col("size") <= SHORT).select("id", "size", F.col("short").alias("words"))

    def count(batches):
        n = np.zeros(COUNTED, np.int64)
        for batch in batches:
            n += np.bincount((unpack(b"".join(batch.column(0).to_pylist())) % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["h", "n"])

    # bounded: COUNTED rows. Any order finds all pairs; this one keeps buckets small.
    often = np.zeros(COUNTED, np.int64)
    for r in short.select("words").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).collect():
        often[r["h"]] = r["n"]

    def run(batches):
        for batch in batches:
            ids, keys, sizes = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = np.sort(unpack(x))
                run = np.maximum.accumulate(np.where(np.concatenate([[True], w[1:] != w[:-1]]), np.arange(len(w)), 0)) if len(w) else np.zeros(0, np.int64)
                label = (np.arange(len(w)) - run).astype(np.uint64)
                first = np.lexsort((label, w, often[(w % np.uint64(COUNTED)).astype(np.int64)]))[: int((1 - similarity) * len(w) + 1e-9) + 1]
                own = mixed(mixed(w[first] + _GOLD) + label[first] * _GOLD)
                ids.append(np.full(len(own), i))
                sizes.append(np.full(len(own), len(w)))
                keys.append(own.view(np.int64))
            flat = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (keys, ids, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in flat], names=["bucket", "id", "size"])

    return short.mapInArrow(run, "bucket bigint, id bigint, size bigint").select("bucket", "id", F.col("size").cast("int"))


def nodes_of(signed: DataFrame) -> DataFrame:
    """(key, n, id, sketch, size, short, bag): texts with the same words once, by their least id, with their number."""
    least = F.min(F.struct("doc_id", "sketch", "size", "short", "bag")).alias("x")
    return cut(signed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), least).select("key", "n", F.col("x.doc_id").alias("id"), "x.sketch", "x.size", "x.short", "x.bag"))


def shared_buckets(nodes: DataFrame, similarity: float) -> DataFrame:
    """(bucket, id, size) of the buckets of two nodes or more. An id with several texts is several nodes of one id."""
    rows = nodes.select("id", "size", F.explode("sketch").alias("bucket")).select("bucket", "id", "size").unionByName(short_buckets(nodes, similarity))
    sizes = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    release(nodes.sparkSession)
    return cut(dealt_join(rows, sizes).select("bucket", "id", "size").distinct())


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the least id of the near-duplicate class.

    A row with a null text is a class of its own; a null id gets a null class. Empty and wordless
    texts are in one class with equal texts only. An id on several rows counts as one document with
    all their texts, so its rows share a class. An empty table gives no rows.
    """
    docs = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = cut(keyed(docs))
    known = signed.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    nodes = nodes_of(signatures(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")))
    release(df.sparkSession)
    sketched = nodes.filter(F.size("sketch") > 0)
    shared = shared_buckets(sketched.select("id", "sketch", "size", "short"), similarity)
    bags = sketched.select("id", "size", "bag")
    release(df.sparkSession)

    # A part of the buckets links most classes; after that only pairs of unlike classes are looked at.
    first = told(shared.filter(F.pmod("bucket", F.lit(FIRST)) == 0).withColumn("comp", F.col("id")))
    done = cut(screened(small_pairs(first, similarity).unionByName(star_pairs(first, similarity)).distinct(), bags, similarity))
    near = verified(done, docs, similarity)
    del first
    release(df.sparkSession)
    rows = told(with_roots(shared, near))
    pairs = cut(screened(small_pairs(rows, similarity).join(done, ["a", "b"], "left_anti"), bags, similarity))
    near = near.unionByName(verified(pairs, docs, similarity)).unionByName(large_links(rows, bags, docs, similarity))
    del rows, pairs, shared, bags, sketched
    release(df.sparkSession)
    # Copies: each id hangs on its key's least id. These links need no check.
    copied = nodes.filter("n > 1").select(F.col("key").alias("bucket"), "n", F.col("id").alias("head"))
    copies = dealt_join(known.select(F.col("key").alias("bucket"), F.col("doc_id").alias("id")), copied).filter("head <> id")
    roots = components(copies.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct().unionByName(near))
    out = signed.select("doc_id").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, all columns: that of the class's least id. Of rows with the same id
    and text one is kept; an id with several texts is one document, so its texts all stay. Rows with a
    null id or a null text stay; an empty table gives no rows."""
    found = classes(docs, similarity=similarity)
    heads = found.filter("doc_id = class_id").select(F.col("doc_id").alias(free_name(docs.columns, "head"))).distinct()
    kept = docs.join(heads, F.col("doc_id").cast("bigint") == F.col(heads.columns[0]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id IS NULL"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
