"""Writers for the JSON, CSV and Parquet artefacts."""
