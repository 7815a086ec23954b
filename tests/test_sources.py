import struct
import time

import pytest
from pyspark.sql import functions as F

from tessella.sources import media, recognizer, store
from tessella.streaming import regroup


def exif() -> bytes:
    taken = b"2001:02:03 04:05:06\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    tiff += struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(taken), 44) + struct.pack("<I", 0) + taken
    return b"\xff\xd8\xff\xe1\x00\x00Exif\0\0" + tiff


def test_exif():
    assert media.read_exif(exif()) == {"taken": "2001-02-03T04:05:06"}
    assert media.read_exif(b"nothing") == {} and media.read_exif(exif()[:40]) == {}


def test_listing_and_metadata(spark, tmp_path):
    (tmp_path / "2019-07 Trip").mkdir()
    (tmp_path / "2019-07 Trip/a.JPG").write_bytes(exif())
    (tmp_path / "._b.jpg").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("x")
    got = media.listing(spark, str(tmp_path)).collect()
    assert [(r["path"], r["kind"], r["size"]) for r in got] == [("2019-07 Trip/a.JPG", "jpeg", len(exif()))]
    read = media.contents(spark, str(tmp_path)).filter("path LIKE '%JPG'")
    assert read.select(media.content_kind(F.col("content"))).first()[0] == "jpeg"
    assert media.metadata(read).first()["taken"] == "2001-02-03T04:05:06"
    assert read.select(media.quick_hash(F.col("content"), F.col("length"))).first()[0] != read.select(media.full_hash(F.col("content"))).first()[0]


def test_store_and_user_data(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.write("t", spark.createDataFrame([(1,)], "a int"))
    s.write("t", spark.createDataFrame([(2,)], "a int"))
    assert [r[0] for r in s.read("t").collect()] == [2]
    with pytest.raises(store.Refused):
        s.read("absent")
    rows = spark.createDataFrame([("k", ["a", " ", "b"]), ("l", None)], "key string, tags array<string>")
    store.write_user_data(rows, str(tmp_path / "u"))
    assert sorted((r["key"], r["tags"]) for r in store.read_user_data(spark, str(tmp_path / "u")).collect()) == [("k", ["a", "b"]), ("l", [])]
    with pytest.raises(store.Refused):
        store.read_libraries("{")


def test_recognizer(spark):
    def make():
        def model(content):
            if content == b"bad":
                raise RuntimeError("broken")
            return {"faces": [{"box": [0, 0, 50, 50], "embedding": [1.0, 2.0], "score": 0.5}]}

        return model

    p = spark.createDataFrame([("a", bytearray(b"x"), 100.0, 100.0), ("b", bytearray(b"bad"), 100.0, 100.0)], "key string, content binary, width double, height double")
    got = {r["key"]: r for r in recognizer.recognize(p, make, 2).collect()}
    assert got["a"]["w"] == 0.5 and got["b"]["error"] == "broken"
    with pytest.raises(ValueError):
        recognizer.checked({"faces": [{"box": [0, 0, 1, 1], "embedding": [1.0]}]}, 10, 10, 2)


def test_batch_triggers(spark):
    at = [0, 1, 2, 3, 4, 5, 100]
    got = sorted((r["fired_at"], r["n"]) for r in regroup.batch_triggers(spark.createDataFrame([("a", t) for t in at], "drive string, at bigint")).collect())
    assert got == [(4, 5), (35, 1), (130, 1)]


def test_stream_triggers(spark, tmp_path):
    events = spark.createDataFrame([("a", "decision")] * 6 + [("b", "now"), ("c", "left")], "drive string, what string")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = regroup.stream_triggers(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    while time.time() < until and spark.table("fired").count() < 2:
        time.sleep(0.5)
    q.stop()
    assert {("a", "cards", 5), ("b", "now", 0)} <= {tuple(r) for r in spark.table("fired").collect()}


def test_resumable(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    for _ in range(2):
        regroup.resumable(source(), lambda b: b.withColumn("x", F.col("id") + 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
