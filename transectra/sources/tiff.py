"""TIFF tag extraction as native columns over ``binaryFile`` content.

The directory walk is column arithmetic on short hex slices, so the pixel bytes
stay in the JVM and are never sent to a Python worker. Damaged files yield an
error text, never a failed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import dms_to_degrees, ratio
from ..functions.text import tag_text

# TIFF tag numbers.
TAGS = {
    "width": 0x0100, "height": 0x0101, "image_description": 0x010E, "make": 0x010F, "model": 0x0110,
    "orientation": 0x0112, "software": 0x0131, "artist": 0x013B, "copyright": 0x8298,
    "exif_ifd": 0x8769, "gps_ifd": 0x8825, "datetime_original": 0x9003,
}
GPS_TAGS = {"lat_ref": 1, "lat": 2, "lon_ref": 3, "lon": 4}
# Bytes per TIFF field type, by type number (0 is unused).
TYPE_SIZES = (None, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)

#: Directory entries as a column: value as an unsigned number (short or long) and as hex.
ENTRIES = "array<struct<tag: bigint, kind: bigint, n: bigint, number: bigint, hex: string>>"

TAG_FIELDS = (
    "width", "height", "exif_make", "exif_model", "exif_artist", "exif_copyright", "exif_image_description",
    "exif_datetime_original", "gps_lat", "gps_lon", "software", "orientation",
)


def _number(hex_text: Column, little: Column, width: int) -> Column:
    """Unsigned integer from ``width`` bytes of hex; null when the slice is short."""
    swapped = F.concat(*[F.substring(hex_text, 2 * i + 1, 2) for i in reversed(range(width))])
    text = F.when(little, swapped).otherwise(hex_text)
    return F.when(F.length(hex_text) == 2 * width, F.conv(text, 16, 10).cast("bigint"))


def _slice(content: Column, offset: Column, size) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.substring(content, (offset + 1).try_cast("int"), size.try_cast("int"))


def _directory(content: Column, offset: Column, little: Column, wanted: dict[str, int]) -> Column:
    """Wanted entries of one image file directory, or null when it does not fit in the file.

    An entry is ``tag, kind, n, text, number, hex``: its value as text, as an
    unsigned integer (short or long), and as hex.
    """
    count = _number(F.hex(_slice(content, offset, 2)), little, 2)
    block = F.hex(_slice(content, offset + 2, count * 12))
    sizes = F.array(*[F.lit(s).cast("int") for s in TYPE_SIZES])

    def entry(i: Column) -> Column:
        at = lambda pos, n: F.substring(block, (i * 24 + 2 * pos + 1).cast("int"), F.lit(2 * n))
        kind, n = _number(at(2, 2), little, 2), _number(at(4, 4), little, 4)
        return F.struct(
            _number(at(0, 2), little, 2).alias("tag"), kind.alias("kind"), n.alias("n"), at(8, 4).alias("raw"),
            (F.get(sizes, kind.cast("int")) * n).alias("size"), _number(at(8, 4), little, 4).alias("at"),
        )

    def value(e: Column) -> Column:
        inside = F.when(e["at"] + e["size"] <= F.length(content), F.hex(_slice(content, e["at"], e["size"])))
        inline = F.substring(e["raw"], F.lit(1), (e["size"] * 2).try_cast("int"))
        number = F.when(e["kind"] == 3, _number(F.substring(e["raw"], 1, 4), little, 2)).when(e["kind"] == 4, e["at"])
        data = F.when(e["size"] <= 4, inline).otherwise(inside)
        return F.struct(
            e["tag"].alias("tag"), e["kind"].alias("kind"), e["n"].alias("n"), number.alias("number"), data.alias("hex")
        )

    fits = (offset >= 8) & (count >= 1) & (F.length(block) == count * 24)
    entries = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), entry)
    kept = F.filter(entries, lambda e: e["tag"].isin(*wanted.values()))
    return F.when(fits, F.transform(kept, value))


def _find(entries: Column, tag: int) -> Column:
    return F.get(F.filter(entries, lambda e: e["tag"] == tag), F.lit(0))


def _text(entry: Column) -> Column:
    raw = F.unhex(entry["hex"])
    return tag_text(F.when(entry["kind"] == 2, F.decode(raw, "ISO-8859-1")).otherwise(raw.cast("string")))


def _angle(entry: Column, ref: Column, little: Column) -> Column:
    word = lambda i: _number(F.substring(entry["hex"], 8 * i + 1, 8), little, 4)
    d, m, s = (ratio(word(2 * i), word(2 * i + 1)) for i in range(3))
    return F.when((entry["kind"] == 5) & (entry["n"] == 3), dms_to_degrees(d, m, s, ref))


def with_tags(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the tag fields and ``read_errors array<string>``; ``content`` is used up and dropped.

    Staged selects keep each directory parsed once per file. 32-bit files only.
    """
    body, little = F.col(content), F.col("_little")
    mark = F.hex(F.substring(body, 1, 4))
    staged = files.withColumn("_little", F.when(mark == "49492A00", True).when(mark == "4D4D002A", False))
    staged = staged.withColumn("_at", _number(F.hex(_slice(body, F.lit(4), 4)), little, 4))
    staged = staged.withColumn("_root", _directory(body, F.col("_at"), little, TAGS))
    sub = lambda tag, wanted: _directory(body, _find(F.col("_root"), TAGS[tag])["number"], little, wanted)
    staged = staged.withColumns({"_exif": sub("exif_ifd", TAGS), "_gps": sub("gps_ifd", GPS_TAGS)}).drop(content, "_at")
    return tag_fields(staged.withColumn("_failed", F.lit(None).cast("string")))


def tag_fields(staged: DataFrame) -> DataFrame:
    """Typed fields of directory entries (``_little``, ``_root``, ``_exif``, ``_gps``, ``_failed``), which are used up.

    ``DateTimeOriginal`` is looked up in the root directory first, then in the Exif directory.
    """
    little, root, exif, gps = F.col("_little"), F.col("_root"), F.col("_exif"), F.col("_gps")
    picked = {f"_{tag}": _find(root, number) for tag, number in TAGS.items()}
    picked_gps = {f"_{tag}": _find(gps, number) for tag, number in GPS_TAGS.items()}
    staged = staged.withColumns({**picked, "_exif_date": _find(exif, TAGS["datetime_original"]), **picked_gps})

    number = lambda tag: F.col(f"_{tag}")["number"]
    text = lambda tag: _text(F.col(f"_{tag}"))
    problem = (
        F.when(F.col("_failed").isNotNull(), F.col("_failed"))
        .when(little.isNull(), "not_a_valid_image: no TIFF header")
        .when(root.isNull(), "not_a_valid_image: directory outside the file")
        .when(number("width").isNull() | number("height").isNull(), "not_a_valid_image: no image size")
    )
    values = {
        "width": number("width").try_cast("int"),
        "height": number("height").try_cast("int"),
        "exif_make": text("make"),
        "exif_model": text("model"),
        "exif_artist": text("artist"),
        "exif_copyright": text("copyright"),
        "exif_image_description": text("image_description"),
        "exif_datetime_original": F.coalesce(text("datetime_original"), text("exif_date")),
        "gps_lat": _angle(F.col("_lat"), text("lat_ref"), little),
        "gps_lon": _angle(F.col("_lon"), text("lon_ref"), little),
        "software": text("software"),
        "orientation": number("orientation").try_cast("int"),
    }
    helpers = ["_little", "_root", "_exif", "_gps", "_failed", "_exif_date", "_problem", *picked, *picked_gps]
    staged = staged.withColumn("_problem", problem)
    good = F.col("_problem").isNull()
    errors = F.when(good, F.array().cast("array<string>")).otherwise(F.array("_problem"))
    return staged.withColumns(
        {**{k: F.when(good, v) for k, v in values.items()}, "read_errors": errors}
    ).drop(*helpers)
