"""File-source streams over telemetry logs and image folders."""
