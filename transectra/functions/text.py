"""String scalars: cleaning, names, labels, details payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts a CSV export means as "no value".
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def strip(c: Column) -> Column:
    """Trim every kind of white space (Spark's ``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_or_null(c: Column) -> Column:
    return blank_to_null(strip(c))


def csv_cell(c: Column) -> Column:
    """Raw CSV cell to text or null: null tokens first, then strip, then blank to null."""
    return strip_or_null(F.when(~c.isin(*CSV_NULL_TOKENS), c))


def csv_number(c: Column) -> Column:
    """Raw CSV cell to double; anything unparseable, and NaN, becomes null."""
    n = strip(c).try_cast("double")
    return F.when(~F.isnan(n), n)


def tag_text(c: Column) -> Column:
    """Tag value (bytes or text) to clean text: valid UTF-8, no outer blanks or NULs."""
    text = F.make_valid_utf8(c.cast("string"))
    return strip_or_null(F.regexp_replace(strip(text), r"^\x00+|\x00+$", ""))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def truthy(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def truthy_source(primary: Column, if_primary: str, otherwise: str) -> Column:
    """Label of where a ``truthy`` value came from; looks at the first candidate only."""
    return F.when(blank_to_null(primary).isNotNull(), F.lit(if_primary)).otherwise(F.lit(otherwise))


def normalize_site(c: Column, aliases: tuple[tuple[str, str], ...]) -> Column:
    """Known spellings to the canonical site; unknown names pass through unchanged."""
    key = F.lower(strip(c))
    out = F
    for alias, canonical in aliases:
        out = out.when(key == alias, F.lit(canonical))
    return c if out is F else out.otherwise(c)


def squash(c: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def looks_like_site(title: Column, site: Column) -> Column:
    return F.contains(squash(title), squash(site))


def has_extension(name: Column, extensions: tuple[str, ...]) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for ext in extensions:
        hit = hit | low.endswith(ext)
    return hit


def has_site_code(name: Column, code: str) -> Column:
    return F.contains(name, F.lit(f"_{code}_"))


def filename_parts(name: Column, pattern: str) -> dict[str, Column]:
    """The five parts of a survey file name; all null when the name does not match."""
    rx = f"(?i){pattern}"
    ok = name.rlike(rx)
    parts = ("date", "site", "transect", "swath", "seq")
    return {p: F.when(ok, F.regexp_extract(name, rx, i)) for i, p in enumerate(parts, start=1)}


def transect_token(name: Column, pattern: str) -> Column:
    return F.upper(blank_to_null(F.regexp_extract(name, f"(?i){pattern}", 1)))


def caption(name: Column, tile_w: int) -> Column:
    """File name cut to what fits under a tile, with an ellipsis."""
    room = max(8, tile_w // 7)
    return F.when(F.length(name) > room, F.concat(F.substring(name, 1, room - 1), F.lit("…"))).otherwise(name)


def details(**fields: Column) -> Column:
    """Finding payload as JSON text; nulls are kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
