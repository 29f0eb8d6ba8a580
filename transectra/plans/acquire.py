"""Manifest to download plan, and finished transfer to provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.acquisition import download_plan, in_input_order, provenance_records, size_mismatches
from ..sinks.artefacts import write_provenance


def plan_acquisition(manifest: DataFrame, listing: DataFrame, prior: DataFrame) -> DataFrame:
    """What to fetch, in manifest order. The transfer itself is another tool's work."""
    return in_input_order(download_plan(manifest, listing, prior))


def record_acquisition(plan: DataFrame, written: DataFrame, site: str, doi: str, out_dir: str) -> None:
    """Check declared sizes, then write provenance; raises when a size differs."""
    bad = size_mismatches(plan, written).limit(5).collect()
    if bad:
        raise ValueError("size differs from the manifest: " + ", ".join(r["name"] for r in bad))
    write_provenance(provenance_records(plan, written, site), out_dir, doi)
