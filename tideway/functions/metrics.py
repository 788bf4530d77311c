"""Scalar metric expressions: classification, speed, density, storage, signals, demand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideway.params import MODEL, STATES


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def load_class(pcu: Column, medium: float = 15.0, high: float = 35.0) -> Column:
    """LOW, MEDIUM or HIGH; whatever lies in no bin, negatives too, is HIGH; null counts as 0."""
    x = F.coalesce(pcu, F.lit(0.0))
    return F.when((x >= 0) & (x < medium), "LOW").when((x >= medium) & (x < high), "MEDIUM").otherwise("HIGH")


def node_load_class(pcu: Column) -> Column:
    return load_class(pcu, 50.0, 140.0)


def traffic_status(load: Column) -> Column:
    return F.when(load == "LOW", "LIGHT").when(load == "HIGH", "HEAVY").otherwise("MODERATE")


def frequent_congestion(status: Column) -> Column:
    return status.isin("HEAVY", "CONGESTED")


def traffic_state(pcu: Column, queue_m: Column) -> Column:
    return F.when((pcu >= 55) | (queue_m > 70), "OVERSATURATED").when((pcu >= 35) | (queue_m > 40), "CONGESTED").when((pcu >= 15) | (queue_m > 15), "BUSY").when(pcu >= 5, "STABLE").otherwise("FREE_FLOW")


def severity(state: Column) -> Column:
    """0 for FREE_FLOW up to 4 for OVERSATURATED."""
    return reduce(lambda c, kv: c.when(state == kv[1], kv[0]), enumerate(STATES), F.when(F.lit(False), 0))


def density_pcu_km(pcu: Column, length_m: Column) -> Column:
    return F.when(length_m > 0, pcu / length_m * 1000).otherwise(F.lit(0.0))


def greenshields(density: Column, free: float = MODEL.free_kmh, jam: float = MODEL.jam_pcu_km) -> Column:
    if jam <= 0:
        return F.lit(free)
    return F.greatest(F.lit(0.0), F.lit(free) * (1 - clamp(density / jam)))


def storage_utilisation(jam_m: Column, length_m: Column) -> Column:
    return F.when(length_m > 0, clamp(jam_m / length_m)).otherwise(F.lit(0.0))


def storage_utilisation_pcu(pcu: Column, storage: Column) -> Column:
    return F.when(storage > 0, clamp(pcu / storage)).otherwise(F.lit(0.0))


def queue_vehicles(jam_m: Column, waiting: Column, space: float = MODEL.storage_m) -> Column:
    q = F.bround(F.greatest(F.lit(0.0), jam_m) / space, 2)
    return F.when((waiting > 0) & (q <= 0), waiting.cast("double")).otherwise(q)


def drop_ratio(recent: Column, baseline: Column) -> Column:
    return F.when(baseline > 1e-9, F.greatest(F.lit(0.0), 1 - recent / baseline))


def occupancy_percent(raw: Column, unit: str = "auto") -> Column:
    """Occupancy in percent; ``auto`` reads values up to 1 as a fraction, like the detectors' readers do."""
    scaled = {"auto": F.when(raw <= 1, raw * 100).otherwise(raw), "percent": raw, "ratio": raw * 100}[unit]
    return clamp(scaled, 0.0, 100.0)


def pressure_ratio(raw: Column, unit: str = "auto") -> Column:
    return {"auto": F.when(raw > 1, raw / 100).otherwise(raw), "percent": raw / 100, "ratio": raw}[unit]


def position_ratio_at_least(pos_m: Column, length_m: Column, ratio: float) -> Column:
    return F.when(length_m > 0, pos_m / length_m >= ratio).otherwise(F.lit(False))


def phase_at(t: Column, offset: Column, green: Column | int = 42, yellow: int = 3) -> Column:
    """Phase name of a fixed-time signal at second t; a green time of one's own, a number or a column, lies within 10 and 120 s."""
    green = F.least(F.lit(120), F.greatest(F.lit(10), F.lit(green) if isinstance(green, int) else green))
    half = green + yellow
    x = F.pmod(t + offset, (2 * half).cast("double"))
    return F.when(x < green, "NS_GREEN").when(x < half, "NS_YELLOW").when(x < half + green, "EW_GREEN").otherwise("EW_YELLOW")


def spawn_multiplier(t: Column, length_s: float = 300.0, low: float = 0.3, ramp: float = 0.15, peak: Column | None = None) -> Column:
    """Demand over a peak: up from ``low`` in the first part, down in the last, ``low`` after it; 1 where ``peak`` is false."""
    r = ramp * length_s
    return F.when(F.lit(False) if peak is None else ~peak, F.lit(1.0)).when(t < r, low + (1 - low) * t / r).when(t < length_s - r, F.lit(1.0)).when(t < length_s, 1 - (1 - low) * (t - (length_s - r)) / r).otherwise(F.lit(low))


def min_gap_m(length_m: Column, own_kmh: Column, ahead_kmh: Column, headway_s: float = 1.5, weather: float = 1.0, scale: float = 1.0, gap: float = MODEL.gap_m) -> Column:
    """Room to the vehicle ahead: a fixed gap where both stand (under 1 km/h), else the headway at the faster one's speed, 5 km/h at least."""
    top = F.greatest(own_kmh, ahead_kmh, F.lit(5.0))
    return F.when((own_kmh < 1.0) & (ahead_kmh < 1.0), length_m + gap).otherwise(length_m + top / 3.6 * headway_s * weather) / max(scale, 1.0)


def effective_kmh(density: Column, green: Column, weather: float = 1.0, agility: float = 1.0, capacity: float = 1.0) -> Column:
    return F.when(green, greenshields(density) * weather * agility * capacity).otherwise(F.lit(0.0))


def ideal_arrival_on_green(free_flow_s: Column, green: float = 42.0) -> Column:
    return F.greatest(F.lit(0.0), (green - free_flow_s) / green)


def phenomena(pressure: Column, detected: Column, box_blocked: Column, edge_full: Column, risk: float = MODEL.risk_pressure) -> dict[str, Column]:
    return {"spillback_active": detected, "spillback_risk": ~detected & (pressure >= risk), "box_blocked": box_blocked | edge_full}
