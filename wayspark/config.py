"""Thresholds of the trajectory analytics, all in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: study area, sampling and cleaning limits
    min_lng: float = -8.75
    max_lng: float = -8.45
    min_lat: float = 41.05
    max_lat: float = 41.25
    sample_sec: int = 15
    max_speed_kmh: float = 200.0
    min_points: int = 2
    max_points: int = 5760
    min_km: float = 0.2
    max_km: float = 100.0
    earth_km: float = 6371.0
    # planar hexagons: edge length in km by resolution, km a degree at the origin
    origin_lng: float = -8.6
    origin_lat: float = 41.15
    km_per_lng: float = 83.8287
    km_per_lat: float = 111.1949
    edge_km: tuple[tuple[int, float], ...] = ((8, 0.461), (9, 0.174), (10, 0.066))
    # resolution 11, of ridges only
    ridge_edge_km: float = 0.025
    # mining
    max_gap: int = 8
    max_tortuosity: float = 2.5

    def edge(self, res: int) -> float:
        return dict(self.edge_km)[res]

    @property
    def max_step_km(self) -> float:
        return self.max_speed_kmh * self.sample_sec / 3600


DEFAULT = Params()
