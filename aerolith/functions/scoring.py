"""Scores, confidences and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.config import Airspace, Altitude, Proximity, Spoofing
from aerolith.functions.tables import GATE_WEIGHT, NACP_RADIUS_NM, SEVERITY_RANK, lookup


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round3(c: Column) -> Column:
    """To three decimals, halves to even, in binary."""
    return F.rint(c * 1000.0) / 1000.0


def altitude_reason(altitude: Column, cfg: Altitude) -> Column:
    return F.when(altitude < cfg.floor_ft, "BELOW_FLOOR").when(altitude > cfg.ceiling_ft, "ABOVE_CEILING")


def altitude_excess(altitude: Column, cfg: Altitude) -> Column:
    return F.greatest(F.lit(cfg.floor_ft) - altitude, altitude - cfg.ceiling_ft)


def altitude_confidence(excess: Column) -> Column:
    return round3(F.least(F.lit(1.0), F.least(excess, F.lit(2000.0)) * 0.5 / 2000.0 + 0.5))


def altitude_severity(excess: Column) -> Column:
    return F.when(excess >= 1000, "HIGH").otherwise("MEDIUM")


def spoof_score(measured: Column, threshold: Column, cfg: Spoofing) -> Column:
    over, span = F.abs(measured) - F.abs(threshold), F.abs(threshold) * cfg.score_margin_frac
    scaled = round3(F.least(F.lit(1.0), F.least(over, span) * 0.5 / span + 0.5))
    return F.when(measured.isNull() | threshold.isNull(), 0.6).when((over <= 0) | (span <= 0), 0.5).otherwise(scaled)


def spoof_confidence(dt: Column, observations: Column, measured: Column, quality: Column) -> Column:
    """dt null: the finding rests on no pair of reports."""
    out = F.lit(1.0)
    out = out - F.when(dt.isNull(), 0.3).when(dt < 1.0, 0.3).when(dt < 2.0, 0.1).otherwise(0.0)
    out = out - F.when(observations < 3, 0.3).otherwise(0.0) - F.when(measured.isNull(), 0.2).otherwise(0.0)
    return round3(clamp(out * F.coalesce(quality, F.lit(1.0))))


def spoof_severity(gate: Column, score: Column, cfg: Spoofing) -> Column:
    weighed = F.coalesce(lookup(gate, GATE_WEIGHT), F.lit(0.5)) * score
    return F.when(weighed >= cfg.severity_high_at, "HIGH").when(weighed >= cfg.severity_medium_at, "MEDIUM").otherwise("LOW")


def fix_quality(*stated: Column) -> Column:
    """Of stated categories 0 to 11; unstated ones do not count."""
    return F.coalesce(F.greatest(F.lit(0.3), F.least(*stated) / 11.0), F.lit(1.0))


def proximity_tier(horizontal: Column, vertical: Column, cfg: Proximity) -> Column:
    out = F.lit(None).cast("string")
    for tier in reversed(cfg.tiers):
        out = F.when((horizontal < tier.max_horizontal_nm) & (vertical < tier.max_vertical_ft), tier.severity).otherwise(out)
    return out


def proximity_raw_confidence(t: Column, cfg: Proximity) -> Column:
    return round3(F.lit(1.0) - clamp(t / cfg.max_tcpa_s) * 0.5)


def position_quality(nacp_a: Column, nacp_b: Column, cfg: Proximity) -> Column:
    def radius(c: Column) -> Column:
        return F.coalesce(lookup(c, NACP_RADIUS_NM), F.lit(0.3))

    tightest = min((t.max_horizontal_nm for t in cfg.tiers), default=1.0)
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.lit(1.0) - F.greatest(radius(nacp_a), radius(nacp_b)) / tightest))


def proximity_score(horizontal: Column, vertical: Column, cfg: Proximity) -> Column:
    widest_h, widest_v = max((t.max_horizontal_nm for t in cfg.tiers), default=1.0), max((t.max_vertical_ft for t in cfg.tiers), default=1.0)
    return round3(clamp(F.lit(1.0) - F.greatest(horizontal / widest_h, vertical / widest_v)))


def incursion_score(zone_type: Column, depth_nm: Column, context: Column, cfg: Airspace) -> Column:
    """context: the sum of the weights of the signals found."""
    return clamp(lookup(zone_type, cfg.base) + F.least(F.coalesce(depth_nm, F.lit(0.0)) * cfg.depth_bump_per_nm, F.lit(cfg.depth_bump_max)) - context)


def incursion_confidence(activation: Column, strict: Column, depth_nm: Column, uncertainty_nm: Column, preferred: Column, cfg: Airspace) -> Column:
    active = F.when(activation == "ACTIVE", 1.0).otherwise(cfg.unknown_activation_factor)
    low = cfg.strict_position_min_factor
    position = F.when(strict, F.least(depth_nm / uncertainty_nm, F.lit(1.0)) * (1 - low) + low).otherwise(cfg.buffered_position_factor)
    return active * position * F.when(preferred, 1.0).otherwise(cfg.fallback_altitude_factor)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK)


def incursion_severity(activation: Column, strict: Column, zone_type: Column, cfg: Airspace) -> Column:
    """HIGH, or the lowest cap that applies."""
    caps = [F.when(activation != "ACTIVE", SEVERITY_RANK[cfg.unknown_activation_cap]), F.when(~strict, SEVERITY_RANK[cfg.buffered_only])]
    caps += [F.when(zone_type == k, SEVERITY_RANK[v]) for k, v in cfg.zone_type_cap.items()]
    rank = F.least(F.lit(SEVERITY_RANK["HIGH"]), *caps)
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()})
