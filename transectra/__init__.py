"""Survey-imagery QC, provenance and reconstruction metrics as Spark DataFrame jobs."""

__version__ = "0.1.0"

from .profile import ReconstructionProfile, SurveyProfile  # noqa: E402

__all__ = ["ReconstructionProfile", "SurveyProfile"]
