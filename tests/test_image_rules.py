import json

import pytest

from transectra.operators.image_rules import RULES, image_findings

# (label, changed fields, rule, expected severity)
CASES = [
    ("good", {}, None, None),
    ("other camera", dict(csv_cammake="Nikon", csv_cammodel="D850"), "camera_consistency", "fail"),
    ("camera from the file when the table is blank", dict(csv_cammake="", csv_cammodel=""), "camera_consistency", "ok"),
    ("lower-case make", dict(csv_cammake="canon"), "camera_consistency", "ok"),
    ("artist missing", dict(csv_artist=None, exif_artist=None), "exif_artist", "fail"),
    ("artist from file", dict(csv_artist=""), "exif_artist", "ok"),
    ("copyright wrong", dict(csv_copyright="All rights reserved"), "exif_copyright", "fail"),
    ("xmp unread", dict(xmp_attribution_url=None), "xmp_attribution_url", "unverified"),
    ("xmp elsewhere", dict(xmp_attribution_url="https://example.org"), "xmp_attribution_url", "fail"),
    ("credit absent", dict(iptc_credit=None), "iptc_credit", "warn"),
    ("credit and artist absent", dict(iptc_credit=None, csv_artist=None, exif_artist=""), "iptc_credit", "fail"),
    ("gps outside", dict(csv_lat=26.0), "gps_present", "fail"),
    ("gps from file", dict(csv_lat=None, csv_lon=None), "gps_present", "ok"),
    ("axes fall back independently", dict(csv_lat=None), "gps_present", "ok"),
    ("gps missing", dict(csv_lat=None, csv_lon=None, gps_lat=None), "gps_present", "fail"),
    ("date outside", dict(csv_dtoriginal_utc="2021-01-01T00:00:00+00:00"), "datetime_original", "warn"),
    ("date unreadable", dict(csv_dtoriginal_utc="not-a-date"), "datetime_original", "warn"),
    ("bare year", dict(csv_dtoriginal_utc="2023"), "datetime_original", "warn"),
    ("compact form", dict(csv_dtoriginal_utc="20220715T143200"), "datetime_original", "ok"),
    ("date missing", dict(csv_dtoriginal_utc=None), "datetime_original", "unverified"),
    ("date blank", dict(csv_dtoriginal_utc=""), "datetime_original", "unverified"),
    ("window start", dict(csv_dtoriginal_utc="2022-07-10 00:00:00"), "datetime_original", "ok"),
    ("window end, offset ignored", dict(csv_dtoriginal_utc="2023-07-19T00:00:00+05:00"), "datetime_original", "ok"),
    ("past window end, offset ignored", dict(csv_dtoriginal_utc="2023-07-19T00:00:01+05:00"), "datetime_original", "warn"),
    ("small frame", dict(width=1920, height=1080), "dimensions", "fail"),
    ("portrait", dict(width=3000, height=4000), "dimensions", "ok"),
    ("no size", dict(width=None), "dimensions", "fail"),
    ("not in table", dict(csv_matched=False), "csv_join", "fail"),
    ("viewer software", dict(software="Microsoft Windows Photo Viewer 6"), "software_lineage", "warn"),
    ("other software", dict(software="GIMP 2.10"), "software_lineage", "fail"),
    ("no software", dict(software=None), "software_lineage", "fail"),
    ("column swath", dict(name="20230711_EDR_T8_C2_000001.tif"), "filename_pattern", "ok"),
    ("lower case", dict(name="20230711_edr_t8_c2_000001.TIF"), "filename_pattern", "ok"),
    ("bad swath", dict(name="20230711_EDR_T8_X2_000001.tif"), "filename_pattern", "fail"),
    ("short sequence", dict(name="20230711_EDR_T8_C2_0001.tif"), "filename_pattern", "fail"),
]




def test_every_case(spark, good, table, profile):
    rows, wanted = [], {}
    for i, (label, changes, code, severity) in enumerate(CASES):
        rows.append(good(i, site=label, **changes))
        wanted[label] = (code, severity)
    found = {}
    for r in image_findings(table(rows), profile).collect():
        found.setdefault(r.site, {})[r.code] = r.severity
    for label, (code, severity) in wanted.items():
        assert set(found[label]) == {r.code for r in RULES}, label
        if code is None:
            assert set(found[label].values()) == {"ok"}
        else:
            assert found[label][code] == severity, label


def test_read_error_stands_alone(good, table, profile):
    bad = good(1, read_errors=["open_failed: x"], csv_matched=False)
    rows = image_findings(table([bad]), profile).collect()
    assert [(r.code, r.severity, r.rank) for r in rows] == [("read_errors", "fail", 2)]
    assert json.loads(rows[0].details) == {"errors": ["open_failed: x"]}


def test_details_keep_nulls(good, table, profile):
    rows = image_findings(table([good(1, csv_artist=None, exif_artist=None)]), profile).collect()
    artist = next(json.loads(r.details) for r in rows if r.code == "exif_artist")
    assert artist == {"actual": None, "expected": profile.artist, "source": "EXIF"}
    name = next(json.loads(r.details) for r in rows if r.code == "filename_pattern")
    assert name == {"date": "20230711", "site": "EDR", "transect": "T3", "swath": "C2", "seq": "000001"}


def test_profile_changes_the_rule(good, table, profile):
    other = profile.replace(artist="someone else", dimensions=((10, 20),))
    found = {r.code: r.severity for r in image_findings(table([good()]), other).collect()}
    assert found["exif_artist"] == "fail" and found["dimensions"] == "fail" and found["csv_join"] == "ok"


def test_profile_round_trips_as_json(profile):
    assert type(profile).from_json(profile.to_json()) == profile
    with pytest.raises(ValueError):
        type(profile).from_json('{"nope": 1}')
