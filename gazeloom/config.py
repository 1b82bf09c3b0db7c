"""Thresholds, passed explicitly to operators. Fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Thresholds:
    idle_downtime_seconds: float = 30.0
    segment_fps: float = 1.0
    min_segment_seconds: float = 1.5
    hand_fps: float = 10.0
    max_fill_gap_seconds: float = 0.3
    filled_confidence: float = 0.2
    min_cutoff: float = 1.5
    beta: float = 0.04
    derivative_cutoff: float = 1.0
    confirm_mediapipe: float = 0.74
    confirm_yunet: float = 0.80
    match_iou: float = 0.1
    center_factor: float = 0.6
    dilation: float = 0.06
    most_dilation: float = 0.5
    orientation_min_score: float = 1.0
    text_nms: float = 0.4
    text_min_fraction: float = 0.03
    text_max_fraction: float = 0.55
    similar_jaccard: float = 0.34
    similar_shared: int = 2
    camera_fov_degrees: float = 90.0
    mount_height_fraction: float = 0.22
    mount_forward_fraction: float = 0.10
    mount_pitch_degrees: float = 12.0
    arm_reach_fraction: float = 0.30
    height_cm: float = 170.0
    chat_max_segments: int = 400
    overlay_tolerance_ms: float = 150.0
    chunk_size: int = 1000


def overlay(base: Thresholds, overrides: dict) -> Thresholds:
    """Known, non-null overrides over the defaults; others are ignored."""
    known = {f.name for f in fields(base)}
    return replace(base, **{k: v for k, v in overrides.items() if k in known and v is not None})
