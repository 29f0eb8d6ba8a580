"""Survey and reconstruction profiles: every expected value a rule compares against.

Operators take a profile and turn it into literal columns, so another survey is
another profile (``SurveyProfile.from_json``), not another code path.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field


def _tuples(value):
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


class _JsonProfile:
    @classmethod
    def from_json(cls, text: str):
        """Build from a JSON object; missing keys keep their defaults, unknown keys raise."""
        raw = json.loads(text)
        unknown = set(raw) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown profile keys: {sorted(unknown)}")
        return cls(**{k: _tuples(v) for k, v in raw.items()})

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    def replace(self, **changes):
        return dataclasses.replace(self, **changes)


@dataclass(frozen=True)
class SurveyProfile(_JsonProfile):
    # Expectations published with the survey's metadata.
    artist: str = "USGS St. Petersburg Coastal and Marine Science Center"
    copyright: str = "Public Domain"
    attribution_url: str = "https://doi.org/10.5066/P1WHKTRD"
    camera_make_pattern: str = r"^Canon$"
    camera_model_pattern: str = r"PowerShot\s*S120"
    software_ok_prefix: str = "Adobe Photoshop"
    software_warn_prefixes: tuple[str, ...] = ("Microsoft Windows Photo Viewer",)
    date_min: str = "2022-07-10 00:00:00"
    date_max: str = "2023-07-19 00:00:00"
    bbox_west: float = -81.8783
    bbox_east: float = -81.3626
    bbox_south: float = 24.4517
    bbox_north: float = 24.6216
    dimensions: tuple[tuple[int, int], ...] = ((4000, 3000), (3000, 4000))
    filename_pattern: str = r"^(\d{8})_([A-Za-z0-9]+)_(T\d+)_([RC]\d+)_(\d{6})\.(tif)$"
    transect_token_pattern: str = r"(EDR_T\d+)"
    file_count_min: int = 1000
    file_count_max: int = 5000
    size_outlier_fraction: float = 0.4
    size_outlier_min_files: int = 10
    coverage_warn_pct: float = 90.0
    site_aliases: tuple[tuple[str, str], ...] = (
        ("easterndryrocks", "EasternDryRocks"),
        ("eastern dry rocks", "EasternDryRocks"),
        ("eastern_dry_rocks", "EasternDryRocks"),
    )
    image_extensions: tuple[str, ...] = (".tif", ".tiff")
    known_bad_files: tuple[str, ...] = (
        "20230711_EDR_T1_C2_000197.tif",
        "20230711_EDR_T1_C2_000218.tif",
    )
    table_primary_fields: tuple[str, ...] = (
        "cammake", "cammodel", "artist", "copyright", "dtoriginal",
    )
    file_primary_fields: tuple[str, ...] = (
        "width", "height", "sha256", "size_bytes", "software", "orientation",
    )
    tags_absent_by_design: tuple[str, ...] = (
        "ExposureTime", "FNumber", "ISOSpeedRatings", "FocalLength", "DateTimeOriginal",
    )

    def lineage(self) -> dict:
        """Static note carried in every QC report: which source owns which field."""
        return {
            "csv_primary_fields": list(self.table_primary_fields),
            "on_disk_primary_fields": list(self.file_primary_fields),
            "fields_absent_by_design": {
                "reason": "tags dropped when the raw frames were re-encoded to TIFF",
                "missing_exif_tags": list(self.tags_absent_by_design),
            },
        }


@dataclass(frozen=True)
class ReconstructionProfile(_JsonProfile):
    # Processing parameters of the published method.
    image_quality_threshold: float = 0.50
    align_accuracy: str = "High"
    generic_preselection: bool = True
    reference_preselection: bool = False
    keypoint_limit: int = 60_000
    tiepoint_limit: int = 0
    exclude_stationary_tie_points: bool = True
    marker_type: str = "Circular12bit"
    marker_tolerance: int = 20
    scalebar_length_m: float = 0.25
    reconstruction_uncertainty: float = 30.0
    projection_accuracy: float = 3.5
    reprojection_error: float = 0.3
    fit_additional_after_reduction: bool = True
    dense_quality: str = "High"
    depth_filtering: str = "Mild"
    point_colors: bool = True
    tiepoint_covariance: bool = True
    noise_confidence_threshold: int = 2
    dsm_resolution_m: float = 0.01
    ortho_blend: str = "Mosaic"
    ortho_hole_filling: bool = True
    # Alarm thresholds.
    alarm_max_disabled: int = 200
    alarm_min_align_rate: float = 0.70
    alarm_max_dsm_cells: int = 100_000_000
    # Focal-length decision margins and published envelopes.
    rms_margin: float = 0.02
    align_margin_pct: float = 2.0
    rms_envelope_lo: float = 0.27
    rms_envelope_hi: float = 0.52
    max_horizontal_mm: float = 3.41
    scalebar_target_mm: float = 1.0
    # Telemetry hint thresholds.
    vram_warn_pct: float = 80.0
    gpu_bound_mean_pct: float = 90.0
    gpu_light_peak_pct: float = 50.0
    ram_warn_pct: float = 85.0
    swap_warn_mb: float = 100.0
    # Confidence sweep and A/B arms.
    sweep_thresholds: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50, 100, 200, 256)
    ab_arms: tuple[tuple[str, float], ...] = field(default=(("q050", 0.50), ("q030", 0.30)))
    quality_bands: tuple[float, float] = (0.30, 0.50)
