import datetime

from pyspark.sql import functions as F

from tessella.functions import boxes, dates, strings
from tessella.operators import timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_search_fold():
    assert strings.search_fold_text("  Größe,Ärger—2 ") == "grosse arger 2"
    assert strings.search_fold_text("été") == "ete"


def test_plain_fold_is_search_fold_on_latin_text(spark):
    for s in ("Größe Straße", "a--b__c", "Ñandú 12.3"):
        assert one(spark, strings.plain_fold(F.lit(s))) == strings.search_fold_text(s)


def test_stem_and_extension(spark):
    assert one(spark, strings.stem(F.lit("a.b.jpg"))) == "a.b"
    assert one(spark, strings.stem(F.lit(".hidden"))) == ".hidden"
    assert one(spark, strings.extension(F.lit("a.JPG"))) == "jpg"
    assert one(spark, strings.parent(F.lit("a/b/c"))) == "a/b"


def test_clean_line(spark):
    assert one(spark, strings.clean_line(F.lit("Straβe 中"))) == "Straße"
    assert one(spark, strings.clean_line(F.lit("-a-"))) is None


def test_valid_name_and_safe_name(spark):
    assert one(spark, strings.valid_name(F.lit(" a "))) and not one(spark, strings.valid_name(F.lit("  "))) and not one(spark, strings.valid_name(F.lit("x" * 101)))
    assert strings.safe_file_name("a/b:c. ") == "a_b_c" and strings.safe_file_name("con.txt") == "_con.txt"


def test_event(spark):
    read = lambda s: one(spark, timeline.event(F.lit(s)))
    assert read("2019-07 Summer") == (2019, 7, "Summer")
    assert read("1907") == (2019, 7, "")
    assert read("2019-13 x") is None and read("Summer") is None and read("2019-07-12 trip") is None


def test_valid_estimate(spark):
    check = lambda y, m, d: one(spark, dates.valid_estimate(F.lit(y).cast("int"), F.lit(m).cast("int"), F.lit(d).cast("int"), F.lit(datetime.date(2024, 5, 17))))
    assert check(1987, None, None) and check(1988, 2, 29) and check(2024, 5, 17)
    assert not check(1987, 2, 29) and not check(1799, 1, 1) and not check(2024, 5, 18) and not check(1987, None, 3) and not check(2024, 6, None)


def test_typed_dates():
    assert dates.parse_typed("März 1998") == [dates.Term(1998, 3)]
    assert dates.parse_typed("198") == [dates.Term(year_prefix="198")]
    assert dates.parse_typed("24.12.2001") == [dates.Term(2001, 12, 24)]
    assert dates.parse_typed("holiday") == [] and dates.parse_typed("2001-13") == []
    assert dates.parse_param("2001-02-03") == dates.Term(2001, 2, 3) and dates.parse_param("--12") == dates.Term(month=12) and dates.parse_param("x") is None


def test_term_needs_known_parts(spark):
    m = lambda t, y, mo, d: one(spark, t.matches(F.lit(y), F.lit(mo).cast("int"), F.lit(d).cast("int")))
    assert m(dates.Term(1998), 1998, None, None) and not m(dates.Term(1998, 3), 1998, None, None)
    assert m(dates.Term(month=3), 1998, 3, 1) and m(dates.Term(year_prefix="199"), 1998, None, None)


def test_tz_shift(spark):
    q = 900 * 10**9
    assert one(spark, dates.is_tz_shift(F.lit(4 * q))) and one(spark, dates.is_tz_shift(F.lit(-56 * q)))
    assert not one(spark, dates.is_tz_shift(F.lit(0))) and not one(spark, dates.is_tz_shift(F.lit(57 * q))) and not one(spark, dates.is_tz_shift(F.lit(q + 1)))


def test_boxes(spark):
    b = lambda *v: boxes.box(*[F.lit(x) for x in v])
    assert abs(one(spark, boxes.iou(b(0, 0, 0.5, 0.5), b(0.25, 0, 0.5, 0.5))) - 1 / 3) < 1e-9
    assert one(spark, boxes.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0
    assert one(spark, boxes.share_inside(b(0, 0, 0.5, 0.5), b(0, 0, 1, 1))) == 1
    turned = one(spark, boxes.turn(boxes.turn(b(0.1, 0.2, 0.3, 0.4), F.lit(1)), F.lit(3)))
    assert all(abs(x - y) < 1e-9 for x, y in zip(turned, (0.1, 0.2, 0.3, 0.4), strict=True))
    assert not one(spark, boxes.valid_position(F.lit(0.0), F.lit(0.0))) and not one(spark, boxes.valid_position(F.lit(None).cast("double"), F.lit(1.0)))
