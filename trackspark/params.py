"""Parameters of an analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    px_scale: float = 96.0  # nm per pixel
    frame_rate: float = 5.0  # Hz
    w: int = 5  # half width of rolling windows, frames
    max_lag: int = 4
    min_track_len: int = 5
    track_buffer: int = 2
    mem_param: int = 1
    link_dist: float = 7.0  # pixels
    classes: int = 3
    window: int = 20  # rows of a scoring window


DEFAULT = Params()
