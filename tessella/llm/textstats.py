"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Odd multipliers of a window's eight word hashes.
MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(WINDOW)], np.uint64)

#: Classes of characters.
SPACE, LOWER, UPPER, DIGIT, STOP, SHOUT, SYMBOL, OTHER = range(8)
_classes = None


def class_table() -> np.ndarray:
    """By code point: its class."""
    global _classes
    if _classes is None:
        t = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isupper():
                t[c] = UPPER
            elif s.isalpha():
                t[c] = LOWER
            elif s.isdigit():
                t[c] = DIGIT
            elif s.isspace():
                t[c] = SPACE
        t[[ord(x) for x in ".,;:"]] = STOP
        t[[ord(x) for x in "!?"]] = SHOUT
        t[[ord(x) for x in "#*$%&|<>~^=_{}[]@\\"]] = SYMBOL
        _classes = t
    return _classes


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)


def repeated(hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h += (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(31))) * MIX[i]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> dict:
    """Exact counts of a text (of an empty one where null); words are runs of anything but ASCII white space."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    hashes = word_hashes(words)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    n = len(words)
    return {
        "n_words": n,
        "word_chars": len(text or "") - (len(raw) - len(raw.translate(None, WHITE))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": repeated(hashes),
        "distinct": window_distinct(hashes),
        "n_stutter": int((hashes[1:] == hashes[:-1]).sum()),
    }


def window_distinct(hashes: np.ndarray, size: int = 50) -> float:
    """The mean share of distinct words in consecutive windows of so many words, so that a long text is no poorer than a short one; 0 without words."""
    n = len(hashes)
    if not n:
        return 0.0
    at = np.minimum(np.arange(n) // size, max(n // size - 1, 0))  # what is left over belongs to the last window
    order = np.lexsort((hashes, at))
    h, w = hashes[order], at[order]
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return float((np.bincount(w, new) / np.bincount(w)).mean())


def gaps(hashes: np.ndarray) -> np.ndarray:
    """By word: how far back the same word stood last, as 1 + the whole part of its binary logarithm, at most 11; 0 for a word that is new."""
    out = np.zeros(len(hashes), np.int64)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out[order[1:][same]] = np.minimum(1 + np.floor(np.log2(np.diff(order)[same])).astype(np.int64), 11)
    return out


def shares(own: np.ndarray) -> dict:
    """Shares of a text's classes of characters: letters and odd characters of all but white space, capitals of letters, runs of capitals of
    letters that follow one, and the number of symbols that end a word."""
    n = np.bincount(own, minlength=8)
    letters, full = n[UPPER] + n[LOWER], max(len(own) - n[SPACE], 1)
    letter = (own == UPPER) | (own == LOWER)
    upper = own == UPPER
    ends = np.append(own[1:] == SPACE, True)[: len(own)]
    return {
        "letters": letters / full,
        "odd": (n[SYMBOL] + n[OTHER]) / full,
        "upper": n[UPPER] / max(letters, 1),
        "runs": int((upper[1:] & upper[:-1]).sum()) / max(int((letter[1:] & letter[:-1]).sum()), 1),
        "shouts": int(n[SHOUT]),
        "marked": int(((own == SYMBOL) & ends).sum()),
    }


def classes(text: str | None) -> np.ndarray:
    return class_table()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
