"""Reading a tree of media files: listing, kinds, contents, hashes, metadata."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import strings
from ..functions.boxes import valid_position

#: Extensions by kind.
KINDS = {
    "jpeg": ("jpg", "jpeg"),
    "png": ("png",),
    "heic": ("heic", "heif"),
    "raw": ("cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "pef", "srw"),
    "video": ("mov", "mp4", "m4v", "3gp", "avi", "mts", "m2ts", "mkv", "mpg"),
}
#: Names that systems leave in folders.
IGNORED = (".DS_Store", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", "System Volume Information", "$RECYCLE.BIN", "Thumbs.db")
SAMPLE = 64 * 1024


def kind_of(path: Column) -> Column:
    """jpeg, png, heic, raw or video by the extension; null for anything else."""
    ext = strings.extension(strings.file_name(path))
    out = F.when(F.lit(False), "")
    for kind, names in KINDS.items():
        out = out.when(ext.isin(*names), kind)
    return out


def is_ignored(name: Column, own: str = ".tessella") -> Column:
    return name.startswith("._") | name.isin(*IGNORED, own)


def content_kind(head: Column) -> Column:
    """The kind that a file's first bytes show."""
    hexed = F.hex(F.substring(head, 1, 12))
    brand = F.substring(hexed, 17, 8)
    boxed = F.substring(hexed, 9, 8) == "66747970"  # ftyp
    heif = brand.isin("68656963", "68656978", "6D696631", "68657663")
    return F.when(hexed.startswith("FFD8FF"), "jpeg").when(hexed.startswith("89504E47"), "png").when(boxed & heif, "heic").when(boxed, "video").when(hexed.startswith("1A45DFA3"), "video").when(hexed.startswith("49492A00") | hexed.startswith("4D4D002A"), "raw")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, size, mtime_ns, kind) of every media file under a folder; paths are relative to it. Files are listed, not opened;
    of paths that are one in composed form the first stays."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), "modificationTime")
    rel = F.regexp_replace("path", "^.*?" + base.replace("\\", "\\\\").replace(".", "\\."), "")
    levels = F.split(rel, "/")
    rows = files.select(rel.alias("path"), "size", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).withColumn("name", strings.file_name(F.col("path"))).withColumn("kind", kind_of(F.col("path")))
    rows = rows.filter(F.col("kind").isNotNull()).filter(~F.exists(levels, lambda x: is_ignored(x)))
    composed = rows.withColumn("path_nfc", strings.nfc(F.col("path")))
    return composed.groupBy("path_nfc").agg(F.min(F.struct("path", "name", "size", "mtime_ns", "kind")).alias("f")).select("f.*", "path_nfc")


def contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def quick_hash(content: Column, size: Column) -> Column:
    """Hash of a file's size and its first and last 64 KiB (all of it up to 128 KiB)."""
    ends = F.when(size <= 2 * SAMPLE, content).otherwise(F.concat(F.substring(content, 1, SAMPLE), F.substring(content, -SAMPLE, SAMPLE)))
    return F.sha2(F.concat(F.encode(F.concat(size.cast("string"), F.lit(":")), "utf-8"), ends), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def unchanged(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files read whose size and time still are what the index says; the rest with an error instead of a content."""
    i = index.select("path", F.col("size").alias("i_size"), F.col("mtime_ns").alias("i_mtime"))
    same = (F.col("size") == F.col("i_size")) & (F.col("mtime_ns") == F.col("i_mtime"))
    return files.join(i, "path").withColumn("error", F.when(same, F.lit(None)).otherwise("changed while it was read")).drop("i_size", "i_mtime")


#: Numbers of the tags that are read.
_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x9003: "taken", 0x9011: "offset", 0xA002: "width", 0xA003: "height", 0x8769: "exif", 0x8825: "gps"}


def read_exif(data: bytes) -> dict:
    """Make, model, taken, offset, width, height, lat and lon of a JPEG's EXIF block; what is missing or damaged is left out."""
    at = data.find(b"Exif\0\0")
    if at < 0:
        return {}
    t = data[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(t[:2])
    if not order:
        return {}
    out: dict = {}

    def values(kind, n, raw):
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 0) * n
        if not size:
            return None
        data = raw[:size] if size <= 4 else t[struct.unpack(order + "I", raw)[0] :][:size]
        if len(data) < size:
            return None
        if kind in (2, 7):
            return data.split(b"\0")[0].decode("latin-1").strip()
        if kind in (5, 10):
            parts = struct.unpack(order + f"{2 * n}" + ("I" if kind == 5 else "i"), data)
            return [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True)]
        got = struct.unpack(order + f"{n}" + {1: "B", 3: "H", 4: "I", 9: "i"}[kind], data)
        return got[0] if n == 1 else list(got)

    def folder(offset, gps=False):
        if not 0 < offset <= len(t) - 2:
            return
        for k in range(min(struct.unpack(order + "H", t[offset : offset + 2])[0], 500)):
            entry = t[offset + 2 + 12 * k :][:12]
            if len(entry) < 12:
                return
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            v = values(kind, n, entry[8:])
            if gps:
                out[f"gps{tag}"] = v
            elif tag in _TAGS and _TAGS[tag] not in out:
                out[_TAGS[tag]] = v
        for name in ("exif", "gps"):
            if isinstance(out.get(name), int):
                folder(out.pop(name), name == "gps")

    try:
        folder(struct.unpack(order + "I", t[4:8])[0])
    except struct.error:
        pass
    degrees = lambda v: sum(x / 60**i for i, x in enumerate(v)) if isinstance(v, list) and len(v) == 3 else None
    lat, lon = degrees(out.get("gps2")), degrees(out.get("gps4"))
    got = {k: out[k] for k in ("make", "model", "offset", "width", "height") if out.get(k)}
    if isinstance(out.get("taken"), str) and len(out["taken"]) == 19:
        got["taken"] = out["taken"][:10].replace(":", "-") + "T" + out["taken"][11:]
    if lat is not None and lon is not None:
        got |= {"lat": -lat if out.get("gps1") == "S" else lat, "lon": -lon if out.get("gps3") == "W" else lon}
    return got


METADATA = "path string, taken string, taken_offset string, width int, height int, camera string, lat double, lon double, error string"


def metadata(files: DataFrame) -> DataFrame:
    """METADATA of files(path, content); positions that are none are null, and a file that can't be read is a row with an error."""

    schema = to_arrow_schema(StructType.fromDDL(METADATA))

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    m = read_exif(content[: 256 * 1024] if content else b"")
                    camera = " ".join(x for x in (m.get("make"), m.get("model")) if x) or None
                    rows.append({"path": path, "taken": m.get("taken"), "taken_offset": m.get("offset"), "width": m.get("width"), "height": m.get("height"), "camera": camera, "lat": m.get("lat"), "lon": m.get("lon"), "error": None})
                except Exception as e:  # noqa: BLE001  a damaged file must not end the job
                    rows.append(dict.fromkeys(schema.names) | {"path": path, "error": str(e)[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = files.select("path", "content").mapInArrow(run, METADATA)
    fine = valid_position(F.col("lat"), F.col("lon"))
    return out.withColumn("lat", F.when(fine, F.col("lat"))).withColumn("lon", F.when(fine, F.col("lon")))
