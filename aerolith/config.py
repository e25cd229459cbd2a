"""Thresholds of the detectors.  The defaults are fixed values: the documented ones, which findings depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


def _positive(obj, *names: str) -> None:
    for n in names:
        if not getattr(obj, n) > 0:
            raise ValueError(f"{n} must be positive, is {getattr(obj, n)}")


@dataclass(frozen=True)
class Altitude:
    floor_ft: float = 500.0
    ceiling_ft: float = 60_000.0

    def __post_init__(self) -> None:
        if self.floor_ft >= self.ceiling_ft:
            raise ValueError("the floor must be below the ceiling")


@dataclass(frozen=True)
class Spoofing:
    teleport_kt: float = 1000.0
    turn_rate_dps: float = 10.0
    turn_rate_min_speed_kt: float = 150.0
    speed_delta_kt: float = 50.0
    speed_delta_frac: float = 0.30
    position_error_m: float = 30.0
    timing_error_s: float = 0.25
    vrate_delta_fpm: float = 2000.0
    vrate_max_plausible_fpm: float = 6000.0
    altitude_quantum_min_samples: int = 4
    altitude_quantum_max_ft: float = 100.0
    altitude_quantum_ft: float = 25.0
    nic_floor: int = 1
    nic_min_duration_s: float = 30.0
    max_gap_s: float = 60.0
    min_dt_s: float = 0.5
    score_margin_frac: float = 1.0
    episode_gap_s: float = 60.0
    severity_high_at: float = 0.6
    severity_medium_at: float = 0.35
    min_confidence: float = 0.35
    min_segment_observations: int = 3
    pingpong_speed_mps: float = 450.0
    pingpong_min_hops: int = 3
    pingpong_reversal_cos: float = 0.7071067811865476
    reappear_speed_mps: float = 450.0
    coexistence_window_s: float = 30.0
    coexistence_slack_km: float = 0.5
    registry_over_kt: float = 350.0
    registry_ratio: float = 2.0
    registry_over_ft: float = 1000.0

    def __post_init__(self) -> None:
        _positive(self, "teleport_kt", "turn_rate_dps", "max_gap_s", "min_dt_s", "coexistence_window_s", "score_margin_frac")


@dataclass(frozen=True)
class Tier:
    severity: str
    max_horizontal_nm: float
    max_vertical_ft: float


@dataclass(frozen=True)
class Proximity:
    grid_step_s: float = 1.0
    max_gap_s: float = 30.0
    cell_size_deg: float = 0.5
    max_vertical_prefilter_ft: float = 2000.0
    ground_altitude_ft: float = 3000.0
    ground_speed_kt: float = 50.0
    max_tcpa_s: float = 120.0
    max_current_separation_nm: float = 10.0
    min_altitude_ft: float = 5000.0
    alert_cooldown_s: float = 60.0
    tiers: tuple[Tier, ...] = (Tier("HIGH", 0.5, 400), Tier("MEDIUM", 1.5, 700), Tier("LOW", 3.0, 900))

    def __post_init__(self) -> None:
        _positive(self, "grid_step_s", "max_gap_s", "cell_size_deg", "max_tcpa_s")


@dataclass(frozen=True)
class Airspace:
    max_gap_s: float = 30.0
    seen_retention_s: float = 3600.0
    feed_lateness_s: float = 120.0
    default_uncertainty_m: float = 185.0
    off_grid_terrain_ft: tuple[float, float] | None = (0.0, 5800.0)
    drop_on_ground: bool = True
    include_types: tuple[str, ...] | None = ("PROHIBITED", "RESTRICTED", "TFR", "WARNING", "ALERT", "MOA")
    military_ranges: tuple[tuple[str, str], ...] = (("AE0000", "AFFFFF"),)
    lifeguard_prefixes: tuple[str, ...] = ("LIFEGUARD", "MEDEVAC", "AIREVAC", "HOSP")
    base: dict = field(default_factory=lambda: {"PROHIBITED": 0.9, "RESTRICTED": 0.7, "TFR": 0.7, "WARNING": 0.3, "ALERT": 0.3, "MOA": 0.2})
    depth_bump_per_nm: float = 0.01
    depth_bump_max: float = 0.1
    unknown_activation_factor: float = 0.6
    strict_position_min_factor: float = 0.5
    buffered_position_factor: float = 0.35
    fallback_altitude_factor: float = 0.8
    persistence_min_factor: float = 0.3
    persistence_saturation_s: float = 15.0
    context_weights: dict = field(default_factory=lambda: {"atc_discrete_squawk": 0.4, "military_hex": 0.3, "lifeguard_callsign": 0.3, "emergency_squawk": 0.2})
    unknown_activation_cap: str = "LOW"
    buffered_only: str = "INFO"
    zone_type_cap: dict = field(default_factory=lambda: {"MOA": "LOW"})
    clear_observations_to_close: int = 2

    def __post_init__(self) -> None:
        _positive(self, "max_gap_s", "persistence_saturation_s", "clear_observations_to_close")


#: window length and step in seconds of the live detectors
CADENCE = {"spoofing": (3600, 300), "proximity": (120, 30), "no_fly_zone": (300, 30)}
