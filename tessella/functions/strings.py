"""String functions. What Spark has no function for (Unicode normal forms) runs as Arrow-batched pandas functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def nfc_text(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def search_fold_text(s: str) -> str:
    """NFC, lower case, sharp s as ss, no combining marks, everything but letters and digits as one space."""
    s = unicodedata.normalize("NFC", s).lower().replace("ß", "ss")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in s).split())


@F.pandas_udf(StringType())
def nfc(column: pd.Series) -> pd.Series:
    return column.astype(object).map(lambda s: nfc_text(s) if isinstance(s, str) else None).astype(object)


@F.pandas_udf(StringType())
def search_fold(column: pd.Series) -> pd.Series:
    return column.astype(object).map(lambda s: search_fold_text(s) if isinstance(s, str) else None).astype(object)


def tag_fold(c: Column) -> Column:
    """Trimmed, NFC, lower case."""
    return F.lower(nfc(F.trim(c)))


def plain_fold(c: Column) -> Column:
    """search_fold for text of ASCII and Latin letters in composed form, within the JVM."""
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    bare = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def repair_sharp_s(c: Column) -> Column:
    """A capital B after a lower-case letter is a misread sharp s."""
    return F.regexp_replace(c, r"(?<=\p{Ll})B", "ß")


def index_form(c: Column) -> Column:
    """Folded text as read and as repaired, where they differ."""
    a, b = search_fold(c), search_fold(repair_sharp_s(c))
    return F.when(a == b, a).otherwise(F.concat_ws(" ", a, b))


def clean_line(c: Column) -> Column:
    """A recognised line: beta as sharp s, characters outside Latin text dropped; null if fewer than 2 letters or digits are left."""
    kept = F.trim(F.regexp_replace(F.translate(c, "β", "ß"), r"[^\p{IsLatin}\p{N}\p{P}\p{Sc}+=<>%°|~^ ]", ""))
    return F.when(F.length(F.regexp_replace(kept, r"[^\p{L}\p{N}]", "")) >= 2, kept)


def keep_line(text: Column, score: Column, height: Column) -> Column:
    return (score >= 0.5) & (height >= 0.004) & clean_line(text).isNotNull()


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(name: Column) -> Column:
    return F.when(F.instr(F.substring(name, 2, 100_000), ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))


def version_token(key: Column, quarters: Column) -> Column:
    return F.concat(F.substring(key, 1, 7), F.coalesce(quarters, F.lit(0)).cast("string"))


def valid_name(c: Column, longest: int = 100) -> Column:
    """Not empty once trimmed, not too long, no control characters."""
    t = F.trim(c)
    return F.coalesce((F.length(t) > 0) & (F.char_length(t) <= longest) & ~t.rlike(r"\p{Cntrl}"), F.lit(False))


def word_is(words: Column, *names: str, least: int = 3) -> Column:
    """Whether some word is a beginning, of `least` letters or more, of one of the names."""
    return F.exists(words, lambda w: (F.length(w) >= least) & F.greatest(F.lit(False), F.lit(False), *[F.lit(n).startswith(w) for n in names]))


#: Names that a file must not have on some systems.
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])


def safe_file_name(name: str) -> str:
    """A name that every file system takes: no separators or control characters, no trailing dots or spaces, no reserved name."""
    s = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).rstrip(". ") or "_"
    return f"_{s}" if s.split(".")[0].upper() in RESERVED else s


def numbered_prefix(i: Column, total: int) -> Column:
    return F.lpad(i.cast("string"), max(3, len(str(total))), "0")


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1000**power, F.concat(F.format_number(n / 1000**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out
