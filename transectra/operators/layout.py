"""Contact-sheet layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..functions.text import caption


def contact_sheet_layout(
    images: DataFrame, cols: int = 6, rows: int = 6, tile_w: int = 220, tile_h: int = 165, margin: int = 8,
    caption_h: int = 18, prefix: str = "contact_sheet",
) -> DataFrame:
    """Sheet, cell, pixel offset and caption of every image, in name order; every ``site``, if there is one, has sheets of its own.

    Positions are running counts over range partitions, so a site may span many
    partitions and a partition hold many sites. Runs jobs.
    """
    per_sheet = cols * rows
    sites = [c for c in ("site",) if c in images.columns]
    placed = running_sums(images.select(*sites, "name"), sites, ["name"], {"i": F.lit(1)})
    placed = placed.select(*sites, "name", F.col("i_before").alias("i"), F.col("i_all").alias("n")).withColumns({
        "sheet": F.expr(f"i div {per_sheet}"),
        "_at": F.col("i") % per_sheet,
        "_pad": F.greatest(F.lit(3), F.length(F.expr(f"(n + {per_sheet - 1}) div {per_sheet}").cast("string"))),
    })
    placed = placed.withColumns({"row": F.expr(f"_at div {cols}"), "col": F.col("_at") % cols})
    return placed.select(
        *sites, "name", "i", "sheet", "row", "col",
        (F.lit(margin) + F.col("col") * (tile_w + margin)).alias("x"),
        (F.lit(margin) + F.col("row") * (tile_h + caption_h + margin)).alias("y"),
        F.concat(F.lit(f"{prefix}_"), F.expr("lpad(cast(sheet + 1 as string), _pad, '0')"), F.lit(".jpg")).alias("sheet_name"),
        caption(F.col("name"), tile_w).alias("caption"),
    )
