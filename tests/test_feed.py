"""Small feeds written by hand."""

import datetime as dt

import pytest

from conftest import rows
from reachlake.operators import feed_ops
from reachlake.sources import feed as R

BASE = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone\nA,Alpha,http://a,UTC\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type\ns1,One,43.1,-79.1,\ns2,Two,43.2,-79.2,1\ns3,Three,,,9\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type,route_color\nr1,A,1,Long,3,\nr2,A,2,Long,900,aa00FF\n",
    "trips": "route_id,service_id,trip_id,shape_id\nr1,service1,t1,\nr2,service2,t2,sh\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,6:10:00,6:10:00,s1,0\nt1,,,s2,1\nt1,25:10:00,25:10:30,s3,2\nt2,07:00:00,07:00:00,s1,5\n",
}


def write(path, files):
    for name, body in files.items():
        data = body if isinstance(body, bytes) else body.encode()
        (path / f"{name}.txt").write_bytes(data)
    return str(path)


def test_defaults_times_and_codes(spark, tmp_path):
    feed = R.read_feed(spark, write(tmp_path, BASE))
    st = {(r.trip_id, r.stop_sequence): r for r in feed["stop_times"].collect()}
    assert st["t1", 0].arrival_time == 22200
    assert st["t1", 1].arrival_time is None
    assert st["t1", 2].arrival_time == 90600
    assert st["t1", 0].pickup_type == 0 and st["t1", 0].continuous_pickup == 1 and st["t1", 0].timepoint == 1
    r = {x.route_id: x for x in feed["routes"].collect()}
    assert (r["r1"].route_color, r["r1"].route_text_color, r["r2"].route_color) == ("FFFFFF", "000000", "AA00FF")
    s = {x.stop_id: x for x in feed["stops"].collect()}
    assert s["s3"].stop_lat is None and s["s3"].location_type == 9 and s["s1"].location_type == 0
    assert feed["frequencies"].count() == 0
    assert {x.table: x.rows for x in R.statistics(feed).collect()}["stop_times"] == 4
    fixed = R.unknown_to_default(feed)["stops"]
    assert {x.location_type for x in fixed.collect()} == {0, 1}


def test_byte_order_mark_and_spaces(spark, tmp_path):
    files = dict(BASE, agency=b"\xef\xbb\xbf" + b"agency_id , agency_name,agency_url,agency_timezone\n A , Alpha ,u,UTC\n")
    feed = R.read_feed(spark, write(tmp_path, files), ("agency",))
    assert [(r.agency_id, r.agency_name) for r in feed["agency"].collect()] == [("A", "Alpha")]


def test_mandatory_file(spark, tmp_path):
    files = {k: v for k, v in BASE.items() if k != "trips"}
    with pytest.raises(R.MissingFile):
        R.read_feed(spark, write(tmp_path, files))


def test_rejects_name_the_cell(spark, tmp_path):
    files = dict(BASE, stop_times=BASE["stop_times"] + "t2,7:0:0,,s1,x\n")
    path = write(tmp_path, files)
    bad = R.rejects(R.read_raw(spark, path, "stop_times"), "stop_times").select("column", "value")
    assert rows(bad) == [("arrival_time", "7:0:0"), ("stop_sequence", "x")]


def test_service_days(spark, tmp_path):
    days = "monday,tuesday,wednesday,thursday,friday,saturday,sunday"
    files = dict(
        BASE,
        calendar=f"service_id,{days},start_date,end_date\nservice1,0,0,0,0,0,1,1,20170101,20170118\n",
        calendar_dates="service_id,date,exception_type\nservice1,20170101,2\nservice2,20170101,1\n")
    feed = R.read_feed(spark, write(tmp_path, files))
    out = feed_ops.service_days(feed["calendar"], feed["calendar_dates"]).collect()
    start = dt.date(2017, 1, 1)
    by = {s: sorted((r.date - start).days for r in out if r.service_id == s) for s in ("service1", "service2")}
    assert by == {"service1": [6, 7, 13, 14], "service2": [0]}


def test_reversed_range_has_no_days(spark, tmp_path):
    days = "monday,tuesday,wednesday,thursday,friday,saturday,sunday"
    files = dict(BASE, calendar=f"service_id,{days},start_date,end_date\na,1,1,1,1,1,1,1,20170110,20170105\nb,1,1,1,1,1,1,1,20170105,20170105\n")
    feed = R.read_feed(spark, write(tmp_path, files))
    assert rows(feed_ops.service_days(feed["calendar"], feed["calendar_dates"])) == [("b", dt.date(2017, 1, 5))]


def test_quoted_text(spark, tmp_path):
    files = dict(BASE, agency='agency_id,agency_name,agency_url,agency_timezone\nA1,"The ""Big"" Bus, Co","http://x",UTC\nA2,"two\nlines",u,UTC\n')
    feed = R.read_feed(spark, write(tmp_path, files))
    want = [("A1", 'The "Big" Bus, Co', "http://x"), ("A2", "two\nlines", "u")]
    assert rows(feed["agency"].select("agency_id", "agency_name", "agency_url")) == want
    back = str(tmp_path / "back")
    R.write_feed(feed, back)
    assert rows(R.read_feed(spark, back)["agency"].select("agency_id", "agency_name", "agency_url")) == want


def test_routes_without_agency_are_listed(spark, tmp_path):
    files = dict(
        BASE, agency="agency_id,agency_name,agency_url,agency_timezone\nA,Alpha,u,UTC\nB,Beta,u,UTC\n",
        routes="route_id,agency_id,route_short_name,route_long_name,route_type\nr1,A,1,L,3\nr2,,2,L,3\nr3,Z,3,L,3\n")
    out = feed_ops.split_by_agency(R.read_feed(spark, write(tmp_path, files)))
    assert rows(out["unassigned_routes"].select("route_id")) == [("r2",), ("r3",)]


def test_references(spark, tmp_path):
    files = dict(BASE, transfers="from_stop_id,to_stop_id,transfer_type\ns1,nowhere,0\n",
                 frequencies="trip_id,start_time,end_time,headway_secs\nlost,05:30:00,06:30:00,600\n")
    feed = R.read_feed(spark, write(tmp_path, files))
    assert rows(feed_ops.reference_violations(feed).select("child", "missing")) == [("frequencies", "lost"), ("transfers", "nowhere")]
    with pytest.raises(feed_ops.BrokenReference):
        feed_ops.require_references(feed)


def test_split_by_agency(spark, tmp_path):
    files = dict(
        BASE,
        agency="agency_id,agency_name,agency_url,agency_timezone\nA,Alpha,u,UTC\n,Beta,u,UTC\nC,Gamma,u,UTC\n",
        routes="route_id,agency_id,route_short_name,route_long_name,route_type\nr1,A,1,L,3\nr2,Beta,2,L,3\nr3,C,3,L,3\n",
        trips="route_id,service_id,trip_id\nr1,x,t1\nr2,x,t2\nr3,x,t3\n",
        stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,6:10:00,6:10:00,s1,0\nt2,6:20:00,6:20:00,s1,0\nt3,,,s2,0\n")
    out = feed_ops.split_by_agency(R.read_feed(spark, write(tmp_path, files)))
    assert rows(out["trips"].select("agency", "trip_id")) == [("A", "t1"), ("Beta", "t2")]
    assert rows(out["stops"].select("agency", "stop_id")) == [("A", "s1"), ("Beta", "s1")]


def test_write_and_read_again(spark, tmp_path):
    feed = R.read_feed(spark, write(tmp_path, BASE))
    back = str(tmp_path / "back")
    R.write_feed(feed, back)
    again = R.read_feed(spark, back)
    for t in ("stops", "routes", "trips", "stop_times"):
        assert rows(again[t].fillna(-1).fillna("-")) == rows(feed[t].fillna(-1).fillna("-"))


def test_unordered_shape(spark, tmp_path):
    files = dict(BASE, shapes="shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nsh,1,1,11\nsh,2,2,0\nsh,3,3,6\n")
    segs = feed_ops.shape_segments(feed_ops.shape_points(R.read_feed(spark, write(tmp_path, files))))
    assert rows(segs.select("seg", "x1", "x2")) == [(0, 2.0, 3.0), (1, 3.0, 1.0)]
