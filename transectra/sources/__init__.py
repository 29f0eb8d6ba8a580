"""Readers: image files, CSV/JSON exports, telemetry logs, point tables."""
