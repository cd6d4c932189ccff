from pyspark.sql import functions as F

from reachlake.functions import bike, geo, text


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_tags(spark):
    def tags(s):
        return one(spark, text.parse_tags(F.lit(s)))[0]

    assert tags("{lanes=2}") == {"lanes": "2"}
    assert tags("{cycleway=left lane, lit=yes, ref=B 7;B 9}") == {"cycleway": "left lane", "lit": "yes", "ref": "B 7;B 9"}
    assert tags("{maxspeed=30, note=mind #4/&?, width=2.75}") == {"maxspeed": "30", "note": "mind #4/&?", "width": "2.75"}
    assert tags("{a=1=2, broken, a=3}") == {"a": "3"}


def test_times(spark):
    t = lambda s: one(spark, text.parse_time(F.lit(s)))[0]
    assert [t("25:10:00"), t("6:05:09"), t("6:5:9"), t("aa:bb:cc")] == [90600, 21909, None, None]
    assert one(spark, text.format_time(F.lit(90600)), text.clock_text(F.lit(45000)), text.clock_text(F.lit(90600))) == (
        "25:10:00", "12:30 pm", "01:10 am (next day)")
    assert one(spark, text.walk_text(F.lit(95.0)), text.walk_text(F.lit(59.4)), text.walk_distance_text(F.lit(134.0))) == (
        "1m35s", "59s", "130 meters")


def test_shades(spark):
    s = lambda t: one(spark, text.shade(F.lit(t), F.lit(0.0), F.lit(70.0)))[0]
    assert [s(-1.0), s(0.0), s(69.0), s(70.0), s(71.0)] == [-1, 0, 6, 6, None]


def test_speed_takes_first_range(spark):
    v = lambda s: one(spark, bike.speed(F.lit(s)))[0]
    assert [v(0.02), v(0.1), v(0.15), v(0.3), v(0.0), v(-0.05), v(-0.2)] == [6.0, 6.0, 4.5, 3.5, 6.26, 6.6, 7.0]


def test_geography(spark):
    d = one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0]
    assert abs(d - 111194.93) < 0.01
    x, y = one(spark, *geo.project(F.lit(43.70), F.lit(-79.40), 43.6532, -79.3832))
    assert abs(x + 1351) < 10 and abs(y - 5204) < 10
    assert one(spark, *geo.tile_of(F.lit(37.8), F.lit(-122.4), 7)) == (20, 49)
