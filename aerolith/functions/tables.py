"""Published lookup tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# containment radius in metres up to which a category holds
RC_TO_NIC = [(7.5, 11), (25.0, 10), (75.0, 9), (186.0, 8), (371.0, 7), (1112.0, 6), (1852.0, 5), (3704.0, 4), (7408.0, 3), (14816.0, 2), (37040.0, 1)]

# navigation integrity category -> containment radius in metres
NIC_RADIUS_M = {1: 37040.0, 2: 14816.0, 3: 7408.0, 4: 3704.0, 5: 1852.0, 6: 1111.2, 7: 370.4, 8: 185.2, 9: 75.0, 10: 25.0, 11: 7.5}

# navigation accuracy category -> estimated position uncertainty in metres
NACP_EPU_M = {1: 18520.0, 2: 7408.0, 3: 3704.0, 4: 1852.0, 5: 926.0, 6: 556.0, 7: 185.0, 8: 93.0, 9: 30.0, 10: 10.0, 11: 3.0}

# the same in nautical miles, as pair quality uses it
NACP_RADIUS_NM = {1: 10.0, 2: 4.0, 3: 2.0, 4: 1.0, 5: 0.5, 6: 0.3, 7: 0.1, 8: 0.05, 9: 0.016, 10: 0.005, 11: 0.002}

# fixed values: rule -> weight of its severity; any other rule weighs 0.5
GATE_WEIGHT = {
    "teleport_v1": 1.0, "coexistence_v1": 0.95, "subterrain_v1": 0.9, "pingpong_v1": 0.85, "registry_mismatch_v1": 0.8, "impersonation_v1": 0.8, "turn_rate_v1": 0.7,
    "reappear_v1": 0.55, "speed_delta_v1": 0.5, "vrate_delta_v1": 0.5, "nic_floor_v1": 0.3, "identity_drift_v1": 0.3,
}

# fixed values: rule -> detection type
GATE_TYPE = {
    "teleport_v1": "position_jump", "reappear_v1": "position_jump", "turn_rate_v1": "kinematic_inconsistency", "speed_delta_v1": "kinematic_inconsistency",
    "vrate_delta_v1": "kinematic_inconsistency", "nic_floor_v1": "integrity_degraded", "coexistence_v1": "identity_coexistence", "pingpong_v1": "identity_coexistence",
    "registry_mismatch_v1": "identity_mismatch", "identity_drift_v1": "identity_mismatch",
}

SEVERITY_RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
EXIT_DEPTH = {"on_ground": 0, "no_candidate": 1, "horizontal_clear": 2, "bad_input": 3, "vertical_clear": 4, "zone_inactive": 5, "detection": 6}


def _literal(x) -> str:
    return f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)


def lookup(key: Column, table: dict) -> Column:
    """The table's value, or null: one constant map, whatever its length."""
    pairs = ", ".join(f"{_literal(k)}, {_literal(x)}" for k, x in table.items())
    whole = all(isinstance(k, int) for k in table)
    return F.try_element_at(F.expr(f"map({pairs})"), key.cast("int") if whole else key)


def rc_to_nic(rc: Column) -> Column:
    """Null for an unknown radius (null, 0 or less); 0 beyond the table."""
    out = F.lit(0)
    for most, nic in reversed(RC_TO_NIC):
        out = F.when(rc <= most, nic).otherwise(out)
    return F.when(rc > 0, out)
