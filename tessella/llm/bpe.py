"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled, one merge gadget after another, into a
deterministic automaton whose arcs are labelled with tokens and whose paths are exactly the
token sequences that the merges produce. A text's pre-split words are encoded by table-driven
transitions, one a byte, and a sequence of ids is decoded by emitting its arcs' labels.

Gadgets. At first one state has an arc to itself for each byte. The state after a token is one
that depends on the token alone, so an arc v out of the state after u is a pair (u, v). The
gadget of merge number r, which joins (u, v) into the new token w:
  * cuts the arc v out of the state after u;
  * gives every state that (still) has an arc u an arc w;
  * adds a state after w, with the arcs that the state after v had before the cut.
The arcs of 50,000 states would fill gigabytes, so a state's row holds only what its gadget changed:
the arcs cut from it, with the gadget's number, and a failure link to the state that it is a copy
of, as of that number; likewise an arc w links to the arc u that it was given beside.

Bytes. Labels are spelled by a second table: the automaton of all labels over bytes, with failure
links, tells after each byte the longest label that ends there and, from it, the shorter ones. Of
these exactly one is an arc out of the state that the path had before it, as every prefix of a word
has exactly one path. So a walk goes forward only; the path is read off from its end.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_text, table

#: The split of byte-level BPE, and what it calls white space (the Unicode property, which differs from Python's \s).
SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!\P{{White_Space}})|{SPACE}+"
#: The same split in the standard library's faster syntax, for texts of ASCII and Latin letters only, whose classes are plain ranges.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_TEXT = re.compile(f"[\\x00-\\x7f{LATIN}]*")
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words kept with their tokens in each Python worker: so many of the latest, and as many from before them, each of up to KEPT_LETTERS letters.
CACHE_WORDS, KEPT_LETTERS = 100_000, 60
#: Arcs kept once read from the tables.
KEPT_ARCS = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tables:
    """The compiled automaton as arrays: what is broadcast."""

    #: By state (token): the gadget that added it (0 for a byte), the tail that its failure link leads to, the head that its arcs were given beside.
    made: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    #: Arcs that were cut, as state * len(made) + arc, and the gadget that did.
    cut: np.ndarray
    cut_by: np.ndarray
    #: Over bytes: transitions as place * 256 + byte and the place they lead to, failure links, and the longest label that ends at a place.
    step: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    longest: np.ndarray
    #: By token: the longest shorter label that its label ends with (-1 if none).
    shorter: np.ndarray
    labels: list[bytes]
    special: dict[str, int]
    #: Whether a word that is a token's label is that token, whatever the merges make of it.
    whole: bool = False

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + sum(map(len, self.labels))

    @cached_property
    def digest(self) -> str:
        told = hashlib.sha256(repr((self.labels, self.special, self.whole)).encode())
        for x in vars(self).values():
            if isinstance(x, np.ndarray):
                told.update(x.tobytes())
        return told.hexdigest()

    @property
    def automaton(self) -> Automaton:
        """That of these tables; the process holds the latest one, so that a Python worker's next tasks and queries neither build nor keep another."""
        if self.digest not in _held:
            _held.clear()
            _held[self.digest] = Automaton(self)
            gc.collect()
            gc.freeze()  # the tables hold no cycles; without this, collections walk them again and again
        return _held[self.digest]


def build(tokens: dict[bytes, int], merges: list[tuple[int, int, int]], special: dict[str, int], whole: bool = False) -> Tables:
    """Gadget after gadget. tokens: bytes to id; merges: pairs of ids with the id they make, in order."""
    n = max([*tokens.values(), *special.values()], default=0) + 1
    made, tail, head = (np.zeros(n, np.int32) for _ in range(3))
    cuts: dict[int, int] = {}
    for r, (u, v, w) in enumerate(merges, 1):
        if made[w] or u == w or v == w:
            raise ValueError(f"merge {r} makes a token again")
        cuts.setdefault(u * n + v, r)
        made[w], tail[w], head[w] = r, v, u
    # Only bytes and what merges make are arcs.
    reached = {b: i for b, i in tokens.items() if len(b) == 1 or made[i]}
    step: dict[int, int] = {}
    ends, place_of = [-1], {}
    parent, letter = [0], [0]
    for b, i in sorted(reached.items()):
        at = 0
        for x in b:
            after = step.get(at << 8 | x)
            if after is None:
                after = step[at << 8 | x] = len(ends)
                ends.append(-1)
                parent.append(at)
                letter.append(x)
            at = after
        ends[at], place_of[i] = i, at
    depth = np.zeros(len(ends), np.int32)
    for at in range(1, len(ends)):
        depth[at] = depth[parent[at]] + 1  # a place comes after the one it is reached from
    fail, longest = [0] * len(ends), list(ends)
    for at in np.argsort(depth, kind="stable")[1:].tolist():
        if parent[at]:
            back = fail[parent[at]]
            while back and back << 8 | letter[at] not in step:
                back = fail[back]
            fail[at] = step.get(back << 8 | letter[at], 0)
        if longest[at] < 0:
            longest[at] = longest[fail[at]]
    shorter = np.full(n, -1, np.int32)
    for i, at in place_of.items():
        shorter[i] = longest[fail[at]]
    labels = [b""] * n
    for b, i in [*tokens.items(), *((s.encode(), i) for s, i in special.items())]:
        labels[i] = b
    ordered = lambda d, kind: (np.fromiter(d, np.int64, len(d)), np.fromiter(d.values(), kind, len(d)))
    whole32 = lambda x: np.array(x, np.int32)
    return Tables(made, tail, head, *ordered(cuts, np.int32), *ordered(step, np.int32), whole32(fail), whole32(longest), shorter, labels, special, whole)


#: The process's automaton by the digest of its tables. Nothing refers back to it: what is frozen goes by its count of references only.
_held: dict[str, Automaton] = {}


class Automaton:
    """Walks the tables. Words met before are kept with their tokens."""

    def __init__(self, t: Tables):
        self.tables, self.labels, self.special, self.size = t, t.labels, t.special, len(t.made)
        self.made, self.tail, self.head, self.fail, self.longest, self.shorter = (x.tolist() for x in (t.made, t.tail, t.head, t.fail, t.longest, t.shorter))
        self.length = [len(b) for b in t.labels]
        self.step = dict(zip(t.step.tolist(), t.to.tolist(), strict=True))
        self.cut_by = dict(zip(t.cut.tolist(), t.cut_by.tolist(), strict=True))
        self.ids = {b: i for i, b in enumerate(t.labels) if b} if t.whole else {}
        self.arcs: dict[int, bool] = {}
        split = "|".join(map(regex.escape, sorted(t.special, key=len, reverse=True)))
        self.specials = regex.compile(f"({split})") if split else None
        self.words, self.latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def arc(self, u: int, v: int) -> bool:
        """Whether the state after u has an arc v: its row, then the rows that failure links lead to, each as of a gadget."""
        made, n, until = self.made, self.size, 1 << 60  # gadgets before `until` are built
        while True:
            if self.cut_by.get(u * n + v, until) < until:
                return False
            a, b = made[u], made[v]
            if not a and not b:
                return True
            if a >= b:  # u's state is the one after its tail, as it was before gadget a
                v = self.head[v] if a == b else v  # which has just been given the arc v by its arc to v's head
                u, until = self.tail[u], a
            else:  # the arc v was given to the states that had an arc to v's head after gadget b's cut
                v, until = self.head[v], b + 1

    def walk(self, word: bytes) -> tuple[int, ...]:
        """The one path that spells a word: a transition a byte, the arc that ends there, and at the end the path back."""
        if word in self.ids:
            return (self.ids[word],)
        step, fail, longest, shorter, length, arcs, n = self.step, self.fail, self.longest, self.shorter, self.length, self.arcs, self.size
        if len(arcs) > KEPT_ARCS:
            arcs.clear()
        last: list[int] = [-1]
        place = 0
        for i, x in enumerate(word, 1):
            after = step.get(place << 8 | x)
            while after is None:
                if not place:
                    raise ValueError("a byte is missing from the vocabulary")
                place = fail[place]
                after = step.get(place << 8 | x)
            place = after
            t = longest[place]
            while True:
                before = last[i - length[t]]
                if before < 0:
                    break
                key = before * n + t
                there = arcs.get(key)
                if there is None:
                    there = arcs[key] = self.arc(before, t)
                if there:
                    break
                t = shorter[t]
            last.append(t)
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at -= length[last[at]]
        return tuple(path[::-1])

    def spelled(self, ids) -> bytes:
        """Decode: emit the labels of a path."""
        labels = self.labels
        return b"".join([labels[i] for i in ids])

    def piece(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(word) > KEPT_LETTERS:
                return self.walk(word.encode())
            if len(self.cache) >= CACHE_WORDS:
                self.cache, self.older = {}, self.cache
            found = self.cache[word] = self.older.get(word) or self.walk(word.encode())
        return found

    def split(self, text: str) -> list[str]:
        return (self.latin if LATIN_TEXT.fullmatch(text) else self.words).findall(text)

    def pieces(self, text: str | None) -> list[tuple[int, ...]]:
        if not text:
            return []
        piece = self.piece
        if self.specials is None or not any(s in text for s in self.special):
            get = self.cache.get
            return [get(w) or piece(w) for w in self.split(text)]
        out = []
        for part in self.specials.split(text):
            out += [(self.special[part],)] if part in self.special else [piece(w) for w in self.split(part)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def decode(self, ids) -> str:
        return self.spelled(ids).decode("utf-8", "replace")


def compile_tables(spec: bytes) -> Tables:
    """From a tokenizers JSON file of a byte-level BPE."""
    told = json.loads(spec)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    vocab = told["model"]["vocab"]
    special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
    tokens = {raw(s): i for s, i in vocab.items() if s not in special}
    merges = []
    for pair in told["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return build(tokens, merges, special, bool(told["model"].get("ignore_merges")))


@lru_cache(maxsize=2)
def compile_automaton(spec: bytes) -> Automaton:
    return compile_tables(spec).automaton


def shared_tables(df: DataFrame, spec: bytes) -> Broadcast:
    tables = compile_automaton(spec).tables
    tables.digest  # noqa: B018  worked out here, once
    return df.sparkSession.sparkContext.broadcast(tables)


def tokenize(df: DataFrame, spec: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with ids array<int> and decoded string (what the ids decode to).

    Null and empty texts have no ids and decode to an empty text. Rows are never merged, so
    repeated rows stay. spec: bytes of a tokenizers JSON file, compiled on the driver; its tables
    (Tables.nbytes, about 5 MB for 50,000 tokens) are broadcast.
    """
    sent = shared_tables(df, spec)

    def make():
        auto = sent.value.automaton
        gc.set_threshold(200_000, 50, 100)

        def work(texts: list) -> dict:
            ids, ends, decoded = [], [0], []
            for t in texts:
                own = auto.encode(t)
                ids.append(np.array(own, np.int32))
                ends.append(ends[-1] + len(own))
                decoded.append(auto.decode(own))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), "decoded": decoded}

        return work

    return map_text(df, make, "ids array<int>, decoded string", text, keep)


def decode(df: DataFrame, spec: bytes, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with `text`, what an array<int> column decodes to. Null ids: null text."""
    sent = shared_tables(df, spec)

    @F.pandas_udf("string")
    def spelled(column):
        auto = sent.value.automaton
        return column.map(lambda x: None if x is None else auto.decode(x)).astype(object)

    return df.select(*keep, spelled(F.col(ids)).alias("text"))


def tokenizer_file(path: str | None = None) -> bytes:
    """Bytes of a public tokenizer's JSON file, read on the driver; the default is the installed byte_bpe_50k."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op8_bpe_automaton(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return digests(tokenize(table(spark, sf_dir, "documents"), tokenizer_file(tokenizer)))
