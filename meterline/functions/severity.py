"""Severity zones of the gauges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gauge, caution from, danger from; the charge gauge alarms downwards.
ZONES = {
    "window": (0.50, 0.80),
    "load": (0.70, 0.90),
    "disk": (0.80, 0.92),
}
CHARGE_CAUTION, CHARGE_DANGER = 0.35, 0.15


def zone(gauge: str, fraction: Column) -> Column:
    if gauge == "charge":
        return (F.when(fraction <= CHARGE_DANGER, "red").when(fraction <= CHARGE_CAUTION, "amber")
                .otherwise("green"))
    caution, danger = ZONES[gauge]
    return F.when(fraction >= danger, "red").when(fraction >= caution, "amber").otherwise("green")


def load_warning(memory_pressure: Column, cpu_fraction: Column) -> Column:
    return F.coalesce(memory_pressure == "critical", F.lit(False)) | F.coalesce(
        cpu_fraction >= 0.9, F.lit(False))


def battery_warning(charging: Column, charge: Column) -> Column:
    return F.coalesce(~charging & (charge <= 0.15), F.lit(False))
