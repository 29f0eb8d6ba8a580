"""Ranged reads of image tags against whole-content reads, 64-bit files, and bytes read."""

import hashlib
import random

import pytest

from tests.tiff_bytes import ASCII, LONG, RATIONAL, SHORT, tiff
from transectra.sources import images
from transectra.sources.tiff import TAG_FIELDS

TEXT = [(0x010F, ASCII, "Canon"), (0x0110, ASCII, "Canon PowerShot S120"), (0x0112, SHORT, 1), (0x8298, ASCII, "© someone, a text longer than eight")]
GPS = [(1, ASCII, "N"), (2, RATIONAL, [(24, 1), (30, 1), (0, 1)]), (3, ASCII, "W"), (4, RATIONAL, [(81, 1), (0, 1), (36, 10)])]
EXIF = [(0x9003, ASCII, "2022:07:15 10:11:12")]
PIXELS = bytes(range(256)) * 2000


def files():
    yield "a.tif", tiff(TEXT, EXIF, GPS)
    yield "b.tif", tiff(TEXT, EXIF, GPS, order=">", pixels=PIXELS)
    yield "c.tif", tiff([(0x9003, ASCII, "2000:01:01 00:00:00")], EXIF, pixels=b"")
    yield "d.tif", b"II*\x00\x08\x00"
    yield "e.tif", b"not an image at all, but some text"
    yield "f.tif", tiff(TEXT)[:60]
    yield "h.tif", tiff([(0x8769, LONG, 10_000_000), (0x8825, LONG, 3)])
    yield "i.tif", tiff([(0x010F, ASCII, "x" * 5000), (0x0131, ASCII, "s")], pixels=PIXELS)
    rng = random.Random(6)
    whole = bytearray(tiff(TEXT, EXIF, GPS))
    for k in range(12):
        damaged = bytearray(whole)
        for _ in range(5):
            damaged[rng.randrange(4, len(damaged))] = rng.randrange(256)
        yield f"r{k}.tif", bytes(damaged)


@pytest.fixture
def folder(tmp_path):
    for name, data in files():
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / name).write_bytes(data)
    return str(tmp_path / "s")


def rows(df):
    return {r.name: tuple(r[c] for c in ("sha256", "size_bytes", "site", "relpath", *TAG_FIELDS, "read_errors")) for r in df.collect()}


def test_equal_to_reading_whole_contents(spark, folder):
    ranged = rows(images.catalogue_images(spark, folder, ranged=True))
    assert ranged == rows(images.catalogue_images(spark, folder, ranged=False))
    assert len(ranged) == len(list(files()))
    assert all(ranged[n][0] == hashlib.sha256(d).hexdigest() for n, d in files())


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_with_64_bit_offsets(spark, tmp_path, order):
    (tmp_path / "s").mkdir()
    for name, big in (("small.tif", False), ("large.tif", True)):
        (tmp_path / "s" / name).write_bytes(tiff(TEXT, EXIF, GPS, order=order, big=big, pixels=PIXELS))
    (tmp_path / "s" / "cut.tif").write_bytes(tiff(TEXT, big=True, order=order)[:30])
    got = {r.name: r for r in images.catalogue_images(spark, str(tmp_path / "s")).collect()}
    assert all(got["large.tif"][c] == got["small.tif"][c] for c in TAG_FIELDS) and got["large.tif"].read_errors == []
    assert got["large.tif"].exif_copyright == TEXT[3][2] and got["large.tif"].gps_lon == pytest.approx(-81.001)
    assert got["cut.tif"].read_errors


def test_a_known_hash_saves_the_content(spark, folder):
    known = spark.createDataFrame([("a.tif", "k" * 64), ("b.tif", "b" * 64), ("i.tif", "i" * 64), ("c.tif", ""), ("b.tif", None)], "name string, sha256 string")
    got = {r.name: r for r in images.catalogue_images(spark, folder, known).collect()}
    size = {n: len(d) for n, d in files()}
    assert (got["b.tif"].sha256, got["i.tif"].sha256) == ("b" * 64, "i" * 64)
    # Half a million bytes each: a few KB are read, values included.
    assert size["b.tif"] > 500_000 and got["b.tif"].bytes_read < 2_048 and got["i.tif"].bytes_read < 8_192
    assert got["c.tif"].sha256 == hashlib.sha256(dict(files())["c.tif"]).hexdigest() and got["c.tif"].bytes_read >= size["c.tif"]


def test_a_missing_file_is_an_error_text(spark, folder):
    from pyspark.sql import functions as F

    from transectra.sources.headers import with_entries
    from transectra.sources.tiff import tag_fields

    df = spark.createDataFrame([(folder + "/none.tif", None), (folder + "/a.tif", None)], "path string, sha256 string")
    got = {r.path[-5:]: r for r in tag_fields(with_entries(df)).withColumn("n", F.size("read_errors")).collect()}
    assert got["e.tif"].n == 1 and got["e.tif"].width is None and got["a.tif"].width == 4000


def test_work_is_dealt_by_bytes(spark, folder, monkeypatch):
    monkeypatch.setattr(images, "BYTES_PER_TASK", 200_000)
    df = images.catalogue_images(spark, folder)
    assert df.rdd.getNumPartitions() == 1 + sum(len(d) for _, d in files()) // 200_000
